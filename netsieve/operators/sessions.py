"""Session boundaries and session records over packet tables.

A flooding endpoint pair may hold a large share of all packets, so windows must not cover a whole key.
Packets are cut into segments that grow with the packet order; windows run inside (key, segment), and
one summary row per (key, segment) carries the open session across the cut. Tables checked to have no
large key skip the cut and need one shuffle for windows and aggregation together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from netsieve.functions import hashing
from netsieve.functions.packets import encode_delta
from netsieve.operators.ordered import split_points, with_bucket
from netsieve.schemas import (
    KNOWN_ATTACKS,
    MAX_PACKETS,
    RETENTION_RATES,
    SESSION_TIMEOUT_S,
    SPLIT_RATIOS,
    UNKNOWN_ATTACKS,
)

SESSION_KEYS = ("source_capture", "canonical_tuple")
PACKET_ORDER = ("chunk_index", "packet_no")
SEGMENT_PACKETS = 1 << 18
KEY_ROWS = 1 << 20


def packet_segment(size: int = SEGMENT_PACKETS) -> Column:
    """Segments of a bounded number of packets of one capture: chunk, then packet number range."""
    return F.col("chunk_index").cast("long") * F.lit(1 << 32) + F.floor(F.col("packet_no") / F.lit(size))


def time_segments(df: DataFrame, ts: str = "ts_us", name: str = "segment") -> DataFrame:
    """Add segments of about equal row count, for tables ordered by time first."""
    return with_bucket(df, ts, split_points(df, ts), name)


def skew_segments(
    df: DataFrame, keys: Sequence[str] = SESSION_KEYS, ts: str = "ts_us", limit: int = KEY_ROWS
) -> tuple[DataFrame, Column | None]:
    """(table, segment) for `sessionize`: no segment if every key fits one task, else time segments.

    The check counts rows per key, combined before the shuffle. It suits tables whose keys are cheap to
    read; decoded captures use `packet_segment` instead, which needs no look at the data.
    """
    largest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    if largest is None or largest <= limit:
        return df, None
    return time_segments(df, ts, "_time_segment"), F.col("_time_segment")


def sessionize(
    df: DataFrame,
    segment: Column | None,
    keys: Sequence[str] = SESSION_KEYS,
    order: Sequence[str] = PACKET_ORDER,
    timeout_s: float = SESSION_TIMEOUT_S,
    ts: str = "ts_us",
    teardown: str = "is_teardown",
) -> DataFrame:
    """Add `session_instance` (1-based per key) and `packet_rank` (1-based per session).

    A session starts at a key's first packet, after a gap above the timeout to the previous packet in
    order, or after a teardown packet, which itself still belongs to the session it closes.
    `segment` must not fall when `order` grows; None means that whole keys fit one task.
    """
    keys = list(keys)
    limit_us = int(round(timeout_s * 1_000_000))
    cell = keys if segment is None else [*keys, "_segment"]
    w = Window.partitionBy(*cell).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)

    local = (
        (df if segment is None else df.withColumn("_segment", segment))
        .select(
            "*",
            F.lag(ts).over(w).alias("_prev_ts"),
            F.lag(teardown).over(w).alias("_prev_td"),
            F.row_number().over(w).alias("_pos"),
        )
        .withColumn(
            "_new",
            F.coalesce(F.col("_prev_td") | (F.col(ts) - F.col("_prev_ts") > limit_us), F.lit(False)),
        )
        .drop("_prev_ts", "_prev_td")
        .select(
            "*",
            F.sum(F.col("_new").cast("int")).over(upto).alias("_inst"),
            F.max(F.when(F.col("_new"), F.col("_pos"))).over(upto).alias("_start"),
        )
        .withColumn("_rank", F.col("_pos") - F.coalesce("_start", F.lit(1)) + 1)
        .drop("_new", "_start")
    )

    if segment is None:
        return (
            local.withColumn("session_instance", (F.col("_inst") + 1).cast("int"))
            .withColumn("packet_rank", F.col("_rank").cast("long"))
            .drop("_pos", "_inst", "_rank")
        )

    summary = local.groupBy(*cell).agg(
        F.max("_inst").alias("inner_starts"),
        F.max("_pos").alias("rows"),
        F.min_by(ts, "_pos").alias("first_ts"),
        F.max_by(ts, "_pos").alias("last_ts"),
        F.max_by(teardown, "_pos").alias("last_td"),
        F.max_by("_rank", "_pos").alias("tail"),
    )
    k = Window.partitionBy(*keys).orderBy("_segment")
    k_upto = k.rowsBetween(Window.unboundedPreceding, 0)
    opened = summary.withColumn(
        "starts",
        F.coalesce(
            F.lag("last_td").over(k) | (F.col("first_ts") - F.lag("last_ts").over(k) > limit_us), F.lit(True)
        ),
    )
    # Rows of the session still open at the end of each segment: its tail plus whole segments before it.
    blocks = opened.select(
        *cell,
        "starts",
        (F.sum(F.col("inner_starts") + F.col("starts").cast("int")).over(k_upto) - F.col("inner_starts")).alias(
            "_base"
        ),
        F.when(F.col("inner_starts") > 0, F.col("tail")).otherwise(F.col("rows")).alias("open_rows"),
        F.sum(((F.col("inner_starts") > 0) | F.col("starts")).cast("int")).over(k_upto).alias("block"),
    )
    in_block = Window.partitionBy(*keys, "block").orderBy("_segment").rowsBetween(Window.unboundedPreceding, 0)
    carry = blocks.withColumn("open_upto", F.sum("open_rows").over(in_block)).select(
        *cell,
        "_base",
        F.when(F.col("starts"), F.lit(0)).otherwise(F.lag("open_upto").over(k)).alias("_carried"),
    )
    return (
        local.join(carry, cell)
        .withColumn("session_instance", (F.col("_base") + F.col("_inst")).cast("int"))
        .withColumn("packet_rank", F.col("_rank") + F.when(F.col("_inst") == 0, F.col("_carried")).otherwise(0))
        .drop("_segment", "_time_segment", "_pos", "_inst", "_rank", "_base", "_carried")
    )


def promoted_label(
    known: Sequence[str] = KNOWN_ATTACKS, unknown: Sequence[str] = UNKNOWN_ATTACKS, rank: str = "packet_rank"
) -> dict[str, Column]:
    """Aggregates that decide a session's label from all of its packets, for `resolve_label`.

    Any unknown-class packet wins with the last such packet's label; otherwise the first known attack
    label with the last subtype seen under that label; otherwise Benign. The state is a fixed handful
    of values, so it combines before the shuffle.
    """
    label, order = F.col("label"), F.col(rank)
    aggs = {
        "_unknown": F.max_by(
            F.struct("label", "attack_subtype"), F.when(label.isin(*unknown), order)
        ),
        "_stray": F.max(F.when(~label.isin("Benign", *known, *unknown), label)),
    }
    for i, name in enumerate(known):
        mine = label == name
        aggs[f"_first_{i}"] = F.min(F.when(mine, order))
        aggs[f"_subtype_{i}"] = F.max_by("attack_subtype", F.when(mine & (F.col("attack_subtype") != "Benign"), order))
    return aggs


def resolve_label(df: DataFrame, known: Sequence[str] = KNOWN_ATTACKS) -> DataFrame:
    """Turn the `promoted_label` aggregates into label, attack_subtype and an `is_unknown` flag."""
    first = F.array_min(
        F.filter(
            F.array(
                *[
                    F.when(
                        F.col(f"_first_{i}").isNotNull(),
                        F.struct(
                            F.col(f"_first_{i}").alias("at"),
                            F.lit(name).alias("label"),
                            F.coalesce(F.col(f"_subtype_{i}"), F.lit("Benign")).alias("attack_subtype"),
                        ),
                    )
                    for i, name in enumerate(known)
                ]
            ),
            lambda s: s.isNotNull(),
        )
    )
    stray = F.when(
        F.col("_stray").isNotNull(), F.raise_error(F.concat(F.lit("label outside the taxonomy: "), "_stray"))
    )
    return (
        df.withColumn("_attack", first)
        .withColumn("is_unknown", F.col("_unknown").isNotNull())
        .withColumn(
            "label",
            F.coalesce(stray.cast("string"), F.col("_unknown.label"), F.col("_attack.label"), F.lit("Benign")),
        )
        .withColumn(
            "attack_subtype",
            F.coalesce(F.col("_unknown.attack_subtype"), F.col("_attack.attack_subtype"), F.lit("Benign")),
        )
        .drop("_attack", "_unknown", "_stray", *[f"_{p}_{i}" for i in range(len(known)) for p in ("first", "subtype")])
    )


def build_sessions(
    packets: DataFrame,
    keys: Sequence[str] = SESSION_KEYS,
    timeout_s: float = SESSION_TIMEOUT_S,
    max_packets: int = MAX_PACKETS,
    with_packets: bool = True,
) -> DataFrame:
    """One row per session from sessionized, labelled packets.

    Only the first `max_packets` packets are kept; the rest are counted. Needs ts_us, src_ip, sport,
    label, attack_subtype and, for `with_packets`, entropy and bytes.
    """
    rank = F.col("packet_rank")
    aggs: dict[str, Column] = {
        "start_ts_us": F.min_by("ts_us", rank),
        "end_ts_us": F.max_by("ts_us", rank),
        "observed_packets": F.count(F.lit(1)),
        **promoted_label(),
    }
    if with_packets:
        kept = F.struct(
            rank.cast("int").alias("pos"), "ts_us", "src_ip", "sport", F.col("entropy").cast("float").alias("entropy"), "bytes"
        )
        aggs["_kept"] = F.sort_array(F.collect_list(F.when(rank <= max_packets, kept)))
    grouped = packets.groupBy(*keys, "session_instance").agg(*[c.alias(n) for n, c in aggs.items()])
    return finish_sessions(grouped, timeout_s, max_packets, with_packets)


def finish_sessions(
    grouped: DataFrame, timeout_s: float = SESSION_TIMEOUT_S, max_packets: int = MAX_PACKETS, with_packets: bool = True
) -> DataFrame:
    """Session records from the aggregates of `build_sessions`, which a stream may have gathered as well."""
    out = resolve_label(grouped).withColumn(
        "captured_packets", F.least(F.col("observed_packets"), F.lit(max_packets)).cast("int")
    )
    if with_packets:
        first = F.get("_kept", F.lit(0))

        def stored(p: Column, i: Column) -> Column:
            gap = (p["ts_us"] - F.get(F.col("_kept"), i - 1)["ts_us"]) / F.lit(1_000_000.0)
            delta = F.when(i == 0, F.lit(0.0)).otherwise(F.greatest(gap, F.lit(0.0)))
            return F.struct(
                p["pos"].alias("pos"),
                ((p["src_ip"] == first["src_ip"]) & (p["sport"] == first["sport"])).alias("is_forward"),
                encode_delta(delta, timeout_s).cast("float").alias("delta_enc"),
                p["entropy"].alias("entropy"),
                p["bytes"].alias("bytes"),
            )

        out = out.withColumn("packets", F.transform("_kept", stored)).drop("_kept")
    return out


def identify(sessions: DataFrame, ratios: dict[str, float] = SPLIT_RATIOS) -> DataFrame:
    """Add capture, group and session identifiers and the split of each session."""
    named = sessions.withColumn("capture_id", hashing.capture_id(F.col("source_capture"))).withColumn(
        "capture_day", hashing.capture_day(F.col("source_capture"))
    )
    keyed = named.withColumn(
        "split_group_key", hashing.split_group_key(F.col("capture_day"), F.col("canonical_tuple"))
    ).withColumn(
        "session_id",
        hashing.session_id(
            F.col("source_capture"), F.col("canonical_tuple"), F.col("start_ts_us"), F.col("session_instance")
        ),
    )
    folder = F.when(F.col("is_unknown"), "test_ood").otherwise("stratified_split")
    return keyed.withColumn("split", hashing.route_split(F.col("split_group_key"), folder, ratios)).drop("is_unknown")


def retain(sessions: DataFrame, rates: dict[str, dict[str, float]] = RETENTION_RATES) -> DataFrame:
    """Add `kept`: the deterministic per-group sampling decision."""
    decision = hashing.is_retained(F.col("split"), F.col("label"), F.col("split_group_key"), rates)
    return sessions.withColumn("kept", decision)


def duplicate_session_ids(sessions: DataFrame) -> DataFrame:
    """Identifiers that occur more than once; empty on sound data."""
    return sessions.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def ingestion_report(sessions: DataFrame) -> DataFrame:
    """Generated and discarded sessions by split and label with subtotals (nulls mark the total rows)."""
    kept = F.col("kept").cast("long")
    return sessions.rollup("split", "label").agg(
        F.sum(kept).alias("generated"), F.sum(1 - kept).alias("discarded")
    )


def subtype_report(sessions: DataFrame) -> DataFrame:
    return sessions.where("kept").groupBy("attack_subtype").agg(F.count(F.lit(1)).alias("generated"))
