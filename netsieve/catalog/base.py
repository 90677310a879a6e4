"""Registry of runnable queries, the tables they start from and shared oracle fragments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from netsieve.functions.hashing import route_split
from netsieve.functions.packets import byte_entropy, canonical_tuple
from netsieve.functions.scoring import argmax_class

Runner = Callable[[SparkSession, str], DataFrame]

RUNNERS: dict[str, Runner] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Runner], Runner]:
    """Register a query under `name`, with the SQL that must give the same rows."""

    def add(run: Runner) -> Runner:
        if name in RUNNERS:
            raise ValueError(f"query {name} is registered twice")
        RUNNERS[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(value: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(value) if isinstance(value, str) else value, digits)


# --- events read as packets -------------------------------------------------------------------------

DAY_S = 86_400.0


def event_packets(
    spark: SparkSession,
    sf_dir: str,
    payload: bool = False,
    events: DataFrame | None = None,
    teardown: Column | None = None,
) -> DataFrame:
    """Each event is a packet between a client and a server derived from the user; `view` runs backwards."""
    e = table(spark, sf_dir, "events") if events is None else events
    uid = F.col("user_id")
    # The parts used more than once get columns of their own, so that they are computed once.
    parts = e.select(
        "*",
        F.concat_ws(".", F.lit("10.0"), F.floor(uid / 256), uid % 256).alias("client"),
        F.concat(F.lit("172.16.0."), uid % 7).alias("server"),
        (F.lit(1024) + uid % 1000).cast("int").alias("cport"),
        (F.col("event_type") != "view").alias("up"),
        F.regexp_extract("props", r"(\d+)", 1).cast("int").alias("k"),
    )
    k, up = F.col("k"), F.col("up")
    label = (
        F.when(k < 80, "Benign").when(k < 88, "DoS").when(k < 95, "DDoS").when(k < 98, "Botnet").otherwise("Web_Attack")
    )
    torn = (F.col("event_type") == "purchase") & (k < 25) if teardown is None else teardown
    base = parts.select(
        F.concat(F.lit("d"), uid % 5, F.lit("_link")).alias("source_capture"),
        F.col("event_id").alias("packet_no"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        F.when(up, F.col("client")).otherwise(F.col("server")).alias("src_ip"),
        F.when(up, F.col("server")).otherwise(F.col("client")).alias("dst_ip"),
        F.when(up, F.col("cport")).otherwise(443).alias("sport"),
        F.when(up, F.lit(443)).otherwise(F.col("cport")).alias("dport"),
        F.lit(6).alias("proto"),
        torn.alias("is_teardown"),
        label.alias("label"),
        F.when(k < 80, "Benign").otherwise(F.concat_ws("-", label, k)).alias("attack_subtype"),
        F.encode("props", "UTF-8").alias("payload"),
    ).withColumn("canonical_tuple", canonical_tuple(*[F.col(c) for c in ("src_ip", "sport", "dst_ip", "dport", "proto")]))
    if payload:
        base = base.withColumn("entropy", byte_entropy("payload").cast("float")).withColumn(
            "bytes", F.substring("payload", 1, 128)
        )
    return base.drop("payload")


EVENT_ORDER = ("ts_us", "packet_no")

PACKETS_SQL = """
pk0 AS (
  SELECT event_id, epoch_us(ts) AS ts_us, user_id AS uid, event_type, props,
         CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS k
  FROM events),
pk AS (
  SELECT event_id AS packet_no, ts_us, uid, props, k, event_type,
         'd' || (uid % 5) || '_link' AS source_capture,
         CASE WHEN event_type <> 'view' THEN '10.0.' || (uid // 256) || '.' || (uid % 256)
              ELSE '172.16.0.' || (uid % 7) END AS src_ip,
         CASE WHEN event_type <> 'view' THEN '172.16.0.' || (uid % 7)
              ELSE '10.0.' || (uid // 256) || '.' || (uid % 256) END AS dst_ip,
         event_type <> 'view' AS is_up,
         '10.0.' || (uid // 256) || '.' || (uid % 256) || '-172.16.0.' || (uid % 7) || '-' || (1024 + uid % 1000)
           || '-443-6' AS canonical_tuple,
         (event_type = 'purchase' AND k < 25) AS is_teardown,
         CASE WHEN k < 80 THEN 'Benign' WHEN k < 88 THEN 'DoS' WHEN k < 95 THEN 'DDoS'
              WHEN k < 98 THEN 'Botnet' ELSE 'Web_Attack' END AS label
  FROM pk0),
pl AS (
  SELECT *, CASE WHEN k < 80 THEN 'Benign' ELSE label || '-' || k END AS attack_subtype,
         CASE WHEN k < 80 THEN 0 WHEN k < 95 THEN 1 ELSE 2 END AS pri
  FROM pk)
"""


def sessions_sql(timeout_us: int, source: str = "pl") -> str:
    """Gaps and islands over whole keys: the plain statement of the session rules."""
    return f"""
w1 AS (
  SELECT *, lag(ts_us) OVER w AS p_ts, lag(is_teardown) OVER w AS p_td FROM {source}
  WINDOW w AS (PARTITION BY source_capture, canonical_tuple ORDER BY ts_us, packet_no)),
w2 AS (
  SELECT *, CAST(sum(CASE WHEN p_ts IS NULL OR p_td OR ts_us - p_ts > {timeout_us} THEN 1 ELSE 0 END) OVER (
    PARTITION BY source_capture, canonical_tuple ORDER BY ts_us, packet_no ROWS UNBOUNDED PRECEDING) AS INTEGER)
    AS session_instance
  FROM w1),
w3 AS (
  SELECT *, row_number() OVER (PARTITION BY source_capture, canonical_tuple, session_instance
                               ORDER BY ts_us, packet_no) AS packet_rank
  FROM w2)
"""


DAY_US = int(DAY_S * 1_000_000)

FRACTION = "(('0x' || substr(sha256({0}), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616::DOUBLE)"


def fraction_sql(text: str) -> str:
    return FRACTION.format(text)


def route_sql(key: str, quarantined: str = "false") -> str:
    f = fraction_sql(f"'split|' || {key}")
    return (
        f"CASE WHEN {quarantined} THEN 'test_ood' WHEN {f} < 0.8::DOUBLE THEN 'train_known' "
        f"WHEN {f} < 0.8::DOUBLE + 0.1::DOUBLE THEN 'val_known' ELSE 'test_known' END"
    )


SESSION_ROWS_SQL = (
    sessions_sql(DAY_US)
    + f""",
first_attack AS (
  SELECT source_capture, canonical_tuple, session_instance, arg_min(label, packet_rank) AS known_label
  FROM w3 WHERE pri = 1 GROUP BY ALL),
se0 AS (
  SELECT w3.source_capture, w3.canonical_tuple, w3.session_instance,
         arg_min(ts_us, packet_rank) AS start_ts_us, arg_max(ts_us, packet_rank) AS end_ts_us,
         count(*) AS observed_packets,
         arg_max(label, packet_rank) FILTER (pri = 2) AS unknown_label,
         arg_max(attack_subtype, packet_rank) FILTER (pri = 2) AS unknown_subtype,
         max(known_label) AS known_label,
         arg_max(attack_subtype, packet_rank) FILTER (label = known_label) AS known_subtype
  FROM w3 LEFT JOIN first_attack f ON w3.source_capture = f.source_capture
   AND w3.canonical_tuple = f.canonical_tuple AND w3.session_instance = f.session_instance
  GROUP BY 1, 2, 3),
se1 AS (
  SELECT source_capture, canonical_tuple, session_instance, start_ts_us, end_ts_us, observed_packets,
         CAST(least(observed_packets, 18) AS INTEGER) AS captured_packets,
         coalesce(unknown_label, known_label, 'Benign') AS label,
         CASE WHEN unknown_label IS NOT NULL THEN unknown_subtype
              WHEN known_label IS NOT NULL THEN known_subtype ELSE 'Benign' END AS attack_subtype,
         unknown_label IS NOT NULL AS is_unknown,
         substr(sha256(source_capture), 1, 16) AS capture_id,
         split_part(source_capture, '_', 1) AS capture_day,
         sha256(split_part(source_capture, '_', 1) || '|' || canonical_tuple) AS split_group_key,
         substr(sha256(source_capture || '|' || canonical_tuple || '|' || start_ts_us || '|' || session_instance), 1, 24)
           AS session_id
  FROM se0),
se2 AS (SELECT *, {route_sql('split_group_key', 'is_unknown')} AS split FROM se1),
se AS (
  SELECT *, {fraction_sql("'retention|' || split || '|' || label || '|' || split_group_key")}
    < CASE WHEN split = 'train_known' AND label = 'Benign' THEN 0.5 WHEN split = 'train_known' THEN 0.8
           WHEN split = 'val_known' THEN 0.6 ELSE 1.0 END AS kept
  FROM se2)
"""
)

# Milder than the shipped rates, so that small tables keep some rows of every kind.
RATES = {
    "train_known": {"Benign": 0.5, "DoS": 0.8, "DDoS": 0.8},
    "val_known": {"Benign": 0.6, "DoS": 0.6, "DDoS": 0.6},
}


# --- embeddings read as scored rows -----------------------------------------------------------------

KNOWN = {"Benign": 0, "DoS": 1, "DDoS": 2}
UNKNOWN = {"Botnet": 3, "Web_Attack": 4}


def folded_logits(embedding: Column) -> Column:
    """Three logits from all components: every third one is added to the same logit."""
    third = lambda c: F.filter(embedding, lambda x, i: i % 3 == c)
    return F.array(*[F.aggregate(third(c), F.lit(0.0), lambda a, x: a + x.cast("double")) for c in range(3)])


def scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels 0-6 fold into three known classes, 7-9 into two unknown ones; the split follows the row id."""
    raw = F.col("label")
    known = raw <= 6
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("id"),
        F.when(known, raw % 3).when(raw <= 8, 3).otherwise(4).cast("int").alias("label"),
        argmax_class(folded_logits(F.col("embedding"))).alias("pred"),
        "embedding",
        F.concat(F.lit("kind-"), raw).alias("attack_subtype"),
        route_split(
            F.col("vec_id").cast("string"), F.when(known, "stratified_split").otherwise("test_ood")
        ).alias("split"),
    )


_LOGIT = "list_sum(list_transform(range({0} + 1, len(embedding) + 1, 3), lambda i: embedding[i]::DOUBLE))"

SCORED_SQL = f"""
sc0 AS (SELECT *, {_LOGIT.format(0)} AS l0, {_LOGIT.format(1)} AS l1, {_LOGIT.format(2)} AS l2 FROM embeddings),
sc AS (
  SELECT vec_id AS id,
         CAST(CASE WHEN label <= 6 THEN label % 3 WHEN label <= 8 THEN 3 ELSE 4 END AS INTEGER) AS label,
         CASE WHEN l0 >= l1 AND l0 >= l2 THEN 0 WHEN l1 >= l2 THEN 1 ELSE 2 END AS pred, embedding,
         'kind-' || label AS attack_subtype,
         {route_sql('CAST(vec_id AS VARCHAR)', 'label > 6')} AS split
  FROM sc0)
"""
