"""Queries that write and read back: session store, result files, manifests, the stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from netsieve.catalog.base import (
    DAY_S,
    EVENT_ORDER,
    PACKETS_SQL,
    SESSION_ROWS_SQL,
    event_packets,
    query,
    r6,
    table,
)
from netsieve.catalog.ingestion import event_sessions
from netsieve.operators.integrity import build_manifest
from netsieve.session import scratch_path
from netsieve.sources import results, sessions as store
from netsieve.streaming.sessionizer import numbered_sessions, run_available, sessionize_stream

# Fixed list of the tables that come one file each.
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
    "benchmark", "labels", "conversations",
)


@query(
    "stored_sessions",
    f"""
    WITH {PACKETS_SQL}, {SESSION_ROWS_SQL}
    SELECT session_id, capture_day, label, captured_packets, size AS stored_packets FROM
      (SELECT *, captured_packets AS size FROM se WHERE kept AND split = 'train_known')""",
)
def q_stored_sessions(spark, sf_dir):
    kept = event_sessions(spark, sf_dir, with_packets=True).where("kept")
    filled = kept.withColumn("source_files", F.array(F.lit("events"))).withColumn("source_truncated", F.lit(False))
    path = scratch_path(spark, "sessions")
    store.write_sessions(filled, path)
    # A second write of some captures replaces only their partitions.
    store.write_sessions(filled.where("capture_day = 'd1'"), path)
    return store.read_sessions(spark, path, "train_known").select(
        "session_id", "capture_day", "label", "captured_packets", F.size("packets").alias("stored_packets")
    )


@query(
    "result_files",
    """
    SELECT o_orderpriority AS run, 'OK' AS status, CAST(count(*) AS INTEGER) AS known_rejected,
      round(avg(o_totalprice), 4) AS ood_auroc, CASE WHEN o_orderpriority LIKE '1%' THEN NULL ELSE round(max(o_totalprice), 4) END AS binary_mcc
    FROM orders GROUP BY o_orderpriority""",
)
def q_result_files(spark, sf_dir):
    by_priority = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.avg("o_totalprice").alias("ood_auroc"),
        F.when(F.col("o_orderpriority").startswith("1"), F.lit(float("nan"))).otherwise(F.max("o_totalprice")).alias("binary_mcc"),
        F.count(F.lit(1)).alias("known_rejected"),
    )
    documents = by_priority.select(
        F.col("o_orderpriority").alias("run"),
        F.struct(
            F.struct("ood_auroc", "binary_mcc").alias("binary_detection"), F.struct("known_rejected").alias("known_degradation")
        ).alias("metrics"),
    )
    path = scratch_path(spark, "results")
    results.write_results(documents, path, "json")
    lines = spark.read.text(path).withColumn("run", F.get_json_object("value", "$.run"))
    flat = results.flatten_results(lines)
    return flat.select("run", "status", "known_rejected", r6("ood_auroc", 4).alias("ood_auroc"), r6("binary_mcc", 4).alias("binary_mcc"))


@query(
    "file_manifest",
    " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS row_count, true AS hashed FROM {t}" for t in TABLES),
)
def q_file_manifest(spark, sf_dir):
    m = build_manifest(spark, sf_dir)
    name = F.regexp_extract("path", r"([a-z]+)\.parquet", 1)
    return m.groupBy(name.alias("name")).agg(
        F.sum("row_count").alias("row_count"),
        F.bool_and((F.length("sha256") == 64) & (F.col("size_bytes") > 0)).alias("hashed"),
    )


@query(
    "streaming_sessions",
    f"""
    WITH {PACKETS_SQL}, {SESSION_ROWS_SQL}
    SELECT source_capture, canonical_tuple, session_instance, start_ts_us, end_ts_us, observed_packets, captured_packets,
      label, attack_subtype FROM se""",
)
def q_streaming_sessions(spark, sf_dir):
    """All sessions of the table run through the stream: the closed ones, and those still open at its end."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(path + "*")
    packets = event_packets(spark, sf_dir, payload=True, events=source)
    closing = sessionize_stream(packets, "1 hour", DAY_S, order=EVENT_ORDER)
    run = run_available(spark, closing, scratch_path(spark, "stream-out"), scratch_path(spark, "stream-state"))
    return numbered_sessions(run.closed.unionByName(run.open), DAY_S).drop("packets", "is_unknown")
