"""Validation and min/max profile of stored sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from netsieve.schemas import KNOWN_CLASSES, MAX_BYTES, MAX_PACKETS

TOLERANCE = 1e-6
RAW_RANGE = (0.0, 255.0)
ENTROPY_RANGE = (0.0, 8.0)


def _bad_number(x: Column) -> Column:
    return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))


def outside(x: Column, bounds: tuple[float, float], tolerance: float = TOLERANCE) -> Column:
    return (x < bounds[0] - tolerance) | (x > bounds[1] + tolerance)


def first_reason(checks: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first failing check, null for a sound row."""
    return F.coalesce(*[F.when(failed, F.lit(name)) for name, failed in checks])


def session_reason(allowed: Sequence[str] = tuple(KNOWN_CLASSES)) -> Column:
    packets = F.col("packets")
    return first_reason(
        [
            ("tensor missing", packets.isNull()),
            (
                "wrong shape",
                (F.size(packets) > MAX_PACKETS)
                | (F.size(packets) != F.col("captured_packets"))
                | F.exists(packets, lambda p: F.length(p["bytes"]) > MAX_BYTES),
            ),
            ("not finite", F.exists(packets, lambda p: _bad_number(p["delta_enc"]) | _bad_number(p["entropy"]))),
            ("label not allowed", ~F.coalesce(F.col("label").isin(*allowed), F.lit(False))),
            ("directional value out of range", F.exists(packets, lambda p: outside(p["delta_enc"], RAW_RANGE))),
            ("entropy out of range", F.exists(packets, lambda p: outside(p["entropy"], ENTROPY_RANGE))),
        ]
    )


def validate_rows(df: DataFrame, reason: Column, file_column: str, id_column: str, examples: int = 5) -> DataFrame:
    """Invalid rows per file and reason, with a few example ids each.

    The examples are the smallest ids, found by a bounded per-group rank that trims before the shuffle.
    """
    marked = df.select(F.col(file_column).alias("file"), F.col(id_column).alias("id"), reason.alias("reason")).where(
        "reason is not null"
    )
    counts = marked.groupBy("file", "reason").agg(F.count(F.lit(1)).alias("invalid"))
    rank = F.row_number().over(Window.partitionBy("file", "reason").orderBy("id"))
    shown = (
        marked.withColumn("_r", rank)
        .where(F.col("_r") <= examples)
        .groupBy("file", "reason")
        .agg(F.sort_array(F.collect_list("id")).alias("examples"))
    )
    return counts.join(shown, ["file", "reason"])


def profile_bounds(sessions: DataFrame) -> DataFrame:
    """One row of global bounds over the tensors the sessions stand for.

    A packet fills one of the two directional channels, so the other holds zeros and every directional
    minimum includes 0. Entropy is zero on the padding rows of sessions shorter than the cap.
    """
    deltas = F.transform("packets", lambda p: p["delta_enc"].cast("double"))
    entropies = F.transform("packets", lambda p: p["entropy"].cast("double"))
    top_byte = F.array_max(F.transform("packets", lambda p: _max_byte(p["bytes"])))
    row = sessions.select(
        F.array_max(deltas).alias("max_delta"),
        top_byte.alias("max_packet"),
        F.when(F.size("packets") < MAX_PACKETS, F.least(F.array_min(entropies), F.lit(0.0)))
        .otherwise(F.array_min(entropies))
        .alias("min_entropy"),
        F.greatest(
            F.array_max(entropies), F.when(F.size("packets") < MAX_PACKETS, F.lit(0.0)).otherwise(F.array_max(entropies))
        ).alias("max_entropy"),
        F.least(F.array_min(deltas), F.lit(0.0)).alias("min_delta"),
    )
    return row.agg(
        F.count(F.lit(1)).alias("valid_sessions"),
        F.least(F.min("min_delta"), F.lit(0.0)).alias("min_raw"),
        F.greatest(F.max("max_delta"), F.max("max_packet"), F.lit(0.0)).alias("max_raw"),
        F.min("min_delta").alias("min_delta"),
        F.greatest(F.max("max_delta"), F.lit(0.0)).alias("max_delta"),
        F.lit(0.0).alias("min_packet"),
        F.greatest(F.max("max_packet"), F.lit(0.0)).alias("max_packet"),
        F.min("min_entropy").alias("min_entropy"),
        F.max("max_entropy").alias("max_entropy"),
    )


def _max_byte(raw: Column) -> Column:
    # Hex text compares like the bytes, so the largest byte is the largest two-digit pair.
    pairs = F.regexp_extract_all(F.hex(raw), F.lit("(..)"), F.lit(1))
    return F.coalesce(F.conv(F.array_max(pairs), 16, 10).cast("double"), F.lit(0.0))


def value_bounds(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long form of min, max and count for plain numeric columns, in one aggregate."""
    wide = df.agg(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.min(c).cast("double").alias("min_value"),
                F.max(c).cast("double").alias("max_value"),
                F.count(c).alias("n"),
            ).alias(f"s_{i}")
            for i, c in enumerate(columns)
        ]
    )
    return wide.select(F.inline(F.array(*[f"s_{i}" for i in range(len(columns))])))


def check_bounds(bounds: DataFrame, pairs: Sequence[tuple[str, str, tuple[float, float]]]) -> DataFrame:
    """Stop the query unless each (min, max) pair is finite, ordered and inside its theoretical range."""
    sound = F.lit(True)
    for low, high, limits in pairs:
        lo, hi = F.col(low), F.col(high)
        bad = _bad_number(lo) | _bad_number(hi) | (lo > hi) | outside(lo, limits) | outside(hi, limits)
        sound = sound & F.when(
            bad, F.raise_error(F.format_string(f"bad bounds {low}/{high}: %s %s", lo, hi)).cast("boolean")
        ).otherwise(True)
    return bounds.where(sound)


SESSION_BOUND_CHECKS = (
    ("min_raw", "max_raw", RAW_RANGE),
    ("min_delta", "max_delta", RAW_RANGE),
    ("min_packet", "max_packet", RAW_RANGE),
    ("min_entropy", "max_entropy", ENTROPY_RANGE),
)


def check_counts(actual: DataFrame, expected: DataFrame, taxonomy: Sequence[str]) -> DataFrame:
    """Compare class counts: per label expected, actual and a status."""
    both = expected.select("label", F.col("n").alias("expected")).join(
        actual.select("label", F.col("n").alias("actual")), "label", "full_outer"
    )
    filled = both.na.fill(0, ["expected", "actual"])
    status = (
        F.when(~F.col("label").isin(*taxonomy), "unexpected_label")
        .when(F.col("actual") == 0, "missing_class")
        .when(F.col("actual") != F.col("expected"), "count_mismatch")
        .otherwise("ok")
    )
    return filled.withColumn("status", status)


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def class_weights(df: DataFrame, classes: Sequence[int], label: str = "label") -> DataFrame:
    """Balanced weight total / (present classes x class count) per class; 0 for an absent one."""
    counts = class_counts(df, label)
    whole = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("present"))
    every = df.sparkSession.createDataFrame([(int(c),) for c in classes], "label int")
    joined = every.join(counts, "label", "left").join(F.broadcast(whole))
    n = F.coalesce("n", F.lit(0))
    return joined.select(
        "label",
        n.alias("n"),
        F.when(n > 0, F.col("total") / (F.col("present") * n)).otherwise(0.0).alias("weight"),
    )
