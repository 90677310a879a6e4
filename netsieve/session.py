"""Spark session defaults and the lineage-cutting helper."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(app: str, cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benches. Clusters bring their own session."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        **DEFAULTS,
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by the cluster; where none is set, a folder beside the warehouse's tables."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None and spark.sparkContext.getCheckpointDir() is None:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        spark.sparkContext.setCheckpointDir(f"{warehouse}/_scratch")


_STAGED: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    root = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    return path


#: Removes the shuffle files of an execution when it ends.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage_table(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write a table once to Parquet under the checkpoint folder and read it back, column by column. `codec` is for tables of whole
    texts, which take up less space by another than the session's.

    What the write has shuffled is removed when it ends, for nothing reads it any more; else it would take up the executors' disks
    until the driver happens to collect its garbage.
    """
    path, conf = scratch_path(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(RELEASE, "false")
    conf.set(RELEASE, "true")
    try:
        df.write.parquet(path, compression=codec)
    finally:
        conf.set(RELEASE, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def materialize(df: DataFrame) -> DataFrame:
    """`df` written once, so that later stages reuse it and survive executor loss."""
    return stage_table(df, "stage")


def _delete(spark: SparkSession, name: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_table(*tables: DataFrame) -> None:
    """Remove tables that `stage_table` has returned, when everything that was made of them is written."""
    for df in tables:
        _STAGED.remove(df._staged_path)
        _delete(df.sparkSession, df._staged_path)


def drop_staged(spark: SparkSession) -> int:
    """Remove the tables that this program has staged, once their results are written; the number of folders removed."""
    removed = 0
    while _STAGED:
        removed += _delete(spark, _STAGED.pop())
    return removed


def shuffle_width(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
