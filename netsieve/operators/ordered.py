"""Order-dependent work without a single-task window.

A running total or a rank over a whole column would put every row into one task, and over a skewed
group a third of them. Here the ordering column is first cut into buckets of about equal row count
(approximate quantiles, a bounded sketch), windows run inside a bucket, and the few bucket totals carry
the sums across. The split points only balance the work: results are exact for any points.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from netsieve.session import shuffle_width

SMALL_SIDE_ROWS = 100_000
MAX_BUCKETS = 4096


def small_rows(df: DataFrame, limit: int = SMALL_SIDE_ROWS) -> DataFrame | None:
    """`df` as a broadcast local table if it has at most `limit` rows, else None."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        return None
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def broadcast_if_small(df: DataFrame, limit: int = SMALL_SIDE_ROWS, weight: Column | None = None) -> DataFrame:
    """A checked broadcast; beyond the limit the plain table, joined by shuffle with skew handling.

    `weight` counts a row with a long list as more than one.
    """
    if weight is not None and (df.agg(F.sum(weight)).first()[0] or 0) > limit:
        return df
    small = small_rows(df, limit)
    return df if small is None else small


def split_points(df: DataFrame, value: str, buckets: int | None = None) -> list[float]:
    """Ascending cut points that share the rows of `value` out about equally."""
    buckets = min(buckets or shuffle_width(df.sparkSession), MAX_BUCKETS)
    shares = [i / buckets for i in range(1, buckets)]
    numeric = df.select(F.col(value).cast("double").alias("v"))
    return sorted(set(numeric.approxQuantile("v", shares, 1.0 / (4 * buckets)))) if shares else []


def with_bucket(df: DataFrame, value: str, points: Sequence[float], name: str = "_bucket") -> DataFrame:
    """Add the index of the interval of `points` that holds `value`."""
    if not points:
        return df.withColumn(name, F.lit(0))
    edges = [float("-inf"), *points, float("inf")]
    cut = Bucketizer(splits=edges, inputCol="_cut", outputCol=name, handleInvalid="keep")
    cut_column = df.withColumn("_cut", F.col(value).cast("double"))
    bucketed = cut.transform(cut_column).drop("_cut")
    # Never null, or joins on it would filter by the bucket function all the way down at the scan.
    return bucketed.withColumn(name, F.coalesce(F.col(name).cast("int"), F.lit(-1)))


def running_totals(
    df: DataFrame,
    order: str,
    sums: Sequence[str],
    group: Sequence[str] = (),
    points: Sequence[float] | None = None,
    bucket: Column | None = None,
) -> DataFrame:
    """Add `cum_<s>` (inclusive running sum) and `total_<s>` for each of `sums`, per `group`, ascending `order`.

    `order` must be unique within `group`: collapse ties by a groupBy beforehand. A `bucket` column
    that grows with `order` replaces the sampled split points.
    """
    group = list(group)
    if bucket is not None:
        cut = df.withColumn("_bucket", bucket)
    else:
        cut = with_bucket(df, order, split_points(df, order) if points is None else points)
    keys = [*group, "_bucket"]
    totals = cut.groupBy(*keys).agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums],
        *[F.sum(f"_t_{s}").over(whole).alias(f"total_{s}") for s in sums],
    )
    inside = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.select("*", *[F.sum(s).over(inside).alias(f"_c_{s}") for s in sums])
    joined = local.join(offsets, keys)
    out = joined.select(
        "*", *[(F.col(f"_c_{s}") + F.col(f"_o_{s}")).alias(f"cum_{s}") for s in sums]
    )
    return out.drop("_bucket", *[f"_{p}_{s}" for s in sums for p in ("c", "o")])


def group_medians(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Exact count `n`, lower median and midpoint median of the non-null values of each group.

    The built-in percentiles keep every distinct value of a group in one task, so they serve tables counted to be small.
    Else bucket counts locate the one or two buckets that hold the middle ranks, and only their rows are shuffled and
    ordered. Both ways give the same rows. Groups of nulls have no row.
    """
    group = list(group)
    rows = df.select(*group, value).where(F.col(value).isNotNull())
    if rows.count() <= SMALL_SIDE_ROWS:
        number = F.col(value).cast("double")
        lower = F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY cast(`{value}` AS double))")
        return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), lower.alias("lower_median"), F.median(number).alias("median"))
    return _bucketed_medians(rows, group, value)


def _bucketed_medians(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    points = split_points(rows, value)
    cut = with_bucket(rows, value, points)
    counts = cut.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*group)
    running = counts.select(
        "*",
        F.sum("_n").over(whole).alias("n"),
        F.sum("_n").over(whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"),
    )
    wanted = running.withColumn(
        "_rank",
        F.explode(
            F.array_distinct(
                F.array(F.floor((F.col("n") - 1) / 2) + 1, F.floor(F.col("n") / 2) + 1)
            )
        ),
    ).where((F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_n")))
    targets = wanted.select(
        *group, "_bucket", "n", "_rank", (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_residual")
    )
    candidates = cut.join(broadcast_if_small(targets), [*group, "_bucket"])
    tied = candidates.groupBy(*group, "n", "_rank", "_residual", value).agg(F.count(F.lit(1)).alias("_n"))
    inside = Window.partitionBy(*group, "n", "_rank", "_residual").orderBy(value)
    reached = tied.withColumn("_c", F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    picked = reached.where(F.col("_c") >= F.col("_residual")).groupBy(*group, "n", "_rank").agg(
        F.min(value).cast("double").alias("_v")
    )
    return picked.groupBy(*group, "n").agg(
        F.min("_v").alias("lower_median"), ((F.min("_v") + F.max("_v")) / 2).alias("median")
    )
