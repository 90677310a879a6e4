"""The log of ingested captures: rows are only ever added, and the newest row of a capture counts.

A run adds its rows in one job, after its sessions are in the store. A run that breaks before that leaves no row, so the next one
takes its captures again, and the store replaces whatever partitions were already there.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

_LOG = (
    "run string, number bigint, capture_id string, source_capture string, status string, sessions bigint, kept bigint, "
    "packet_errors bigint, source_truncated boolean, missing_chunks array<int>"
)
#: Captures with these states are not taken again.
DONE = ("OK", "PARTIAL")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All rows; none where no log is."""
    try:
        return spark.read.schema(_LOG).parquet(path)
    except AnalysisException as absent:
        if "PATH_NOT_FOUND" not in str(absent):
            raise
        return spark.createDataFrame([], _LOG)


def append_completion(completion: DataFrame, path: str, run: str) -> int:
    """Add the rows of a run, which appear together; the number of the entry."""
    spark = completion.sparkSession
    last = read_log(spark, path).agg(F.max("number")).first()[0]
    number = (last or 0) + 1
    named = completion.withColumns({"run": F.lit(run), "number": F.lit(number).cast("long")})
    columns = [f.split(" ")[0] for f in _LOG.split(", ")]
    named.select(*columns).coalesce(1).write.mode("append").parquet(path)  # a row for each capture of the run
    return number


def latest(log: DataFrame) -> DataFrame:
    """The newest row of each capture."""
    others = [c for c in log.columns if c != "capture_id"]
    newest = F.max_by(F.struct(*others), F.struct("number", "run")).alias("x")
    return log.groupBy("capture_id").agg(newest).select("capture_id", "x.*").select(*log.columns)


def done_captures(log: DataFrame, statuses: tuple[str, ...] = DONE) -> DataFrame:
    """(capture_id) of captures whose newest row has one of the states."""
    return latest(log).where(F.col("status").isin(*statuses)).select("capture_id")


def failed_captures(log: DataFrame) -> DataFrame:
    """(capture_id, source_capture, missing_chunks, packet_errors) of captures whose newest row is FAILED."""
    return latest(log).where("status = 'FAILED'").select("capture_id", "source_capture", "missing_chunks", "packet_errors")
