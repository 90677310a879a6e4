"""Session tables in Parquet, replaced capture by capture without a moment in which rows are gone.

A write puts its rows into a folder of its own, `data/generation=<id>/split=/capture_day=/capture_id=`, and then adds one small
file to `commits`: which partitions this generation now holds, and which partitions are withdrawn. The newest commit of a partition
decides; readers join with these decisions. Rows of a write that fails, at any point, are never decided for, and the rows before
it stay as they were. `remove_replaced` frees the space of generations that nothing refers to any more.
"""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from netsieve.operators.ordered import broadcast_if_small
from netsieve.schemas import SESSIONS

PARTITIONS = ("split", "capture_day", "capture_id")
#: A null generation withdraws the partition.
_COMMIT = "number bigint, split string, capture_day string, capture_id string, generation string"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as absent:
        if "PATH_NOT_FOUND" not in str(absent):
            raise
        return spark.createDataFrame([], schema)


def _decisions(spark: SparkSession, path: str) -> DataFrame:
    """(split, capture_day, capture_id, number, generation): the newest commit of each partition."""
    newest = F.max(F.struct("number", "generation")).alias("x")
    return _read(spark, f"{path}/commits", _COMMIT).groupBy(*PARTITIONS).agg(newest).select(*PARTITIONS, "x.number", "x.generation")


def _commit(spark: SparkSession, path: str, decided: DataFrame) -> int:
    """Add decisions (partition, generation) as one file, which appears as a whole; the number of the commit."""
    last = _read(spark, f"{path}/commits", _COMMIT).agg(F.max("number")).first()[0]
    number = (last or 0) + 1
    rows = decided.select(F.lit(number).cast("long").alias("number"), *PARTITIONS, "generation")
    rows.coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return number


def _live_partitions(spark: SparkSession, path: str, captures: DataFrame) -> DataFrame:
    """Partitions with rows of the captures (capture_id), whatever split they were routed to."""
    wanted = broadcast_if_small(captures.select("capture_id").distinct())
    return _decisions(spark, path).where("generation IS NOT NULL").join(wanted, "capture_id", "left_semi").select(*PARTITIONS)


def withdraw_captures(spark: SparkSession, path: str, captures: DataFrame) -> int:
    """Withdraw every partition of the captures (capture_id), as for those that have failed; the number of partitions."""
    live = _live_partitions(spark, path, captures).withColumn("generation", F.lit(None).cast("string"))
    count = live.count()
    if count:
        _commit(spark, path, live)
    return count


def write_sessions(sessions: DataFrame, path: str, captures: DataFrame | None = None) -> int | None:
    """Replace the partitions that `sessions` has rows of, all at once; others stay as they are. The number of the commit, None if
    there was nothing to write.

    Routing is deterministic, so a rerun under the same settings meets the same partitions. With `captures`, the list of those
    that were ingested anew, their other partitions are withdrawn in the same commit, so that a capture which now routes
    otherwise, or has no session left, keeps no stale row. Of two writers of one partition the later commit counts.
    """
    spark, generation = sessions.sparkSession, uuid.uuid4().hex
    named = sessions.select(*StructType.fromDDL(SESSIONS).names, F.lit(generation).alias("generation"))
    named.write.mode("append").partitionBy("generation", *PARTITIONS).parquet(f"{path}/data")
    written = _read(spark, f"{path}/data", f"{SESSIONS}, generation string").where(F.col("generation") == generation)
    decided = written.select(*PARTITIONS).distinct().withColumn("generation", F.lit(generation))
    if captures is not None:
        fresh = decided.select(*[F.col(c).alias(f"new_{c}") for c in PARTITIONS])
        again = [F.col(c).eqNullSafe(F.col(f"new_{c}")) for c in PARTITIONS]
        stale = _live_partitions(spark, path, captures).join(fresh, again, "left_anti")
        decided = decided.unionByName(stale.withColumn("generation", F.lit(None).cast("string")))
    if decided.isEmpty():
        return None
    return _commit(spark, path, decided)


def read_sessions(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Sessions with the expected schema, of the newest commit of each partition; a split prunes to its folders."""
    df = _read(spark, f"{path}/data", f"{SESSIONS}, generation string")
    live = _decisions(spark, path).where("generation IS NOT NULL").drop("number")
    if split is not None:
        df, live = df.where(F.col("split") == split), live.where(F.col("split") == split)
    # A row for each partition; partition columns alone are joined, so folders without a live row are not read.
    here = [F.col(c).eqNullSafe(F.col(f"live_{c}")) for c in PARTITIONS] + [F.col("generation") == F.col("live_generation")]
    renamed = broadcast_if_small(live.select(*[F.col(c).alias(f"live_{c}") for c in (*PARTITIONS, "generation")]))
    return df.join(renamed, here, "left_semi").select(*StructType.fromDDL(SESSIONS).names)


def remove_replaced(spark: SparkSession, path: str) -> int:
    """Delete the folders that no commit refers to any more, those of failed writes included; the number of folders.

    Only for times without readers or writers: they may still need what is deleted. The driver sees a name for each partition.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    value = lambda x: "__HIVE_DEFAULT_PARTITION__" if x is None else x
    live = {
        "/".join(f"{c}={value(r[c])}" for c in ("generation", *PARTITIONS))
        for r in _decisions(spark, path).where("generation IS NOT NULL").toLocalIterator()
    }
    fs, removed = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf), 0
    for found in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/data/generation=*/split=*/capture_day=*/capture_id=*")) or []:
        name = "/".join(unquote(found.getPath().toString()).rstrip("/").split("/")[-4:])
        if name not in live:
            removed += fs.delete(found.getPath(), True)
    return removed


def list_capture_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size_bytes) of the capture files below a folder, without reading them."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.pcap")
        .load(path)
        .select("path", F.col("length").alias("size_bytes"))
    )
