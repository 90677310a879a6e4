"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def text_digest(text: Column) -> Column:
    """64 bits that name a text; a null text has a digest of its own."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def prefix_sums(totals: DataFrame, group: list[str], order: str, value: str, name: str) -> DataFrame:
    """Adds to each row the sum of `value` over the rows of its group that stand before it.

    Meant for tables of totals (one row per group and bucket), so a window holds at most as many rows as there
    are buckets.
    """
    before = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn(name, F.coalesce(F.sum(value).over(before), F.lit(0)).cast("long"))


BATCH_ROWS = 1000


def short_batches(spark: SparkSession) -> None:
    """Lets Arrow batches hold few rows, for these are whole texts. The setting is read when a plan runs, so it stays."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
