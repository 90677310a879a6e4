"""Queries over packets, sessions and captures."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from netsieve.catalog.base import (
    DAY_S,
    DAY_US,
    EVENT_ORDER,
    PACKETS_SQL,
    RATES,
    SESSION_ROWS_SQL,
    event_packets,
    fraction_sql,
    query,
    r6,
    route_sql,
    sessions_sql,
    table,
)
from netsieve.functions import hashing
from netsieve.functions.labels import encode_label, long_enough, normalise_label
from netsieve.functions.packets import anonymised_prefix, byte_entropy, canonical_tuple
from netsieve.operators import audit, captures as caps
from netsieve.operators.moments import matrix_of
from netsieve.operators.pca import list_array
from netsieve.operators.schedule import label_packets
from netsieve.operators.sessions import (
    build_sessions,
    duplicate_session_ids,
    identify,
    ingestion_report,
    retain,
    sessionize,
    skew_segments,
    subtype_report,
    time_segments,
)
from netsieve.operators.tensors import to_scaled_image, to_tensor
from netsieve.session import scratch_path, stage_table
from netsieve.sources.completion import append_completion, latest, read_log
from netsieve.sources.headers import decode_headers
from netsieve.sources.pcap import read_captures, write_captures
from netsieve.sources.schedule import schedule_from


# --- scalar functions -------------------------------------------------------------------------------


@query(
    "canonical_tuple",
    """
    WITH e AS (
      SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
        '10.' || (l_suppkey % 3) || '.0.' || (l_partkey % 256) AS src, (l_partkey % 1000) AS sport,
        '10.' || (l_partkey % 3) || '.0.' || (l_suppkey % 256) AS dst, (l_suppkey % 1000) AS dport
      FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
      CASE WHEN src < dst OR (src = dst AND sport <= dport)
           THEN src || '-' || dst || '-' || sport || '-' || dport || '-6'
           ELSE dst || '-' || src || '-' || dport || '-' || sport || '-6' END AS canonical
    FROM e""",
)
def q_canonical_tuple(spark, sf_dir):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    src = F.concat(F.lit("10."), s % 3, F.lit(".0."), p % 256)
    dst = F.concat(F.lit("10."), p % 3, F.lit(".0."), s % 256)
    key = canonical_tuple(src, p % 1000, dst, s % 1000, F.lit(6))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", key.alias("canonical")
    )


@query(
    "stable_fraction",
    f"SELECT o_orderkey, {fraction_sql('CAST(o_orderkey AS VARCHAR)')} AS fraction FROM orders",
)
def q_stable_fraction(spark, sf_dir):
    key = F.col("o_orderkey").cast("string")
    return table(spark, sf_dir, "orders").select("o_orderkey", hashing.stable_fraction(key).alias("fraction"))


@query(
    "split_routing",
    f"""SELECT o_orderkey, {route_sql("CAST(o_orderkey AS VARCHAR)", "o_orderstatus = 'F'")} AS split FROM orders""",
)
def q_split_routing(spark, sf_dir):
    folder = F.when(F.col("o_orderstatus") == "F", "hold_out_test").otherwise("stratified_split")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", hashing.route_split(F.col("o_orderkey").cast("string"), folder).alias("split")
    )


_PRIORITY_LABEL = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'DoS' WHEN '2' THEN 'DDoS' ELSE 'Benign' END"


@query(
    "retention_sampling",
    f"""
    WITH k AS (SELECT o_orderkey, {_PRIORITY_LABEL} AS label, CAST(o_custkey AS VARCHAR) AS g FROM orders),
    r AS (SELECT *, {route_sql('g')} AS split FROM k)
    SELECT o_orderkey, split, label,
      {fraction_sql("'retention|' || split || '|' || label || '|' || g")} <
      CASE WHEN split = 'train_known' AND label = 'Benign' THEN 0.5 WHEN split = 'train_known' THEN 0.8
           WHEN split = 'val_known' THEN 0.6 ELSE 1.0 END AS kept
    FROM r""",
)
def q_retention(spark, sf_dir):
    first = F.substring("o_orderpriority", 1, 1)
    label = F.when(first == "1", "DoS").when(first == "2", "DDoS").otherwise("Benign")
    group = F.col("o_custkey").cast("string")
    keyed = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        label.alias("label"),
        group.alias("split_group_key"),
        hashing.route_split(group, F.lit("stratified_split")).alias("split"),
    )
    return retain(keyed, RATES).select("o_orderkey", "split", "label", "kept")


@query(
    "identifiers",
    f"""
    WITH {PACKETS_SQL}
    SELECT packet_no, substr(sha256(source_capture), 1, 16) AS capture_id,
      split_part(source_capture, '_', 1) AS capture_day,
      sha256(split_part(source_capture, '_', 1) || '|' || canonical_tuple) AS split_group_key,
      substr(sha256(source_capture || '|' || canonical_tuple || '|' || ts_us || '|' || 1), 1, 24) AS session_id
    FROM pl""",
)
def q_identifiers(spark, sf_dir):
    p = event_packets(spark, sf_dir)
    capture, key = F.col("source_capture"), F.col("canonical_tuple")
    day = hashing.capture_day(capture)
    return p.select(
        "packet_no",
        hashing.capture_id(capture).alias("capture_id"),
        day.alias("capture_day"),
        hashing.split_group_key(day, key).alias("split_group_key"),
        hashing.session_id(capture, key, F.col("ts_us"), F.lit(1)).alias("session_id"),
    )


@query(
    "byte_entropy",
    """
    WITH h AS (SELECT doc_id, hex(encode(text)) AS h FROM documents),
    b AS (SELECT doc_id, length(h) // 2 AS n, unnest(regexp_extract_all(h, '..')) AS byte FROM h),
    c AS (SELECT doc_id, n, byte, count(*) AS c FROM b GROUP BY ALL)
    SELECT doc_id, round(-sum(c / n::DOUBLE * log2(c / n::DOUBLE)), 6) AS entropy FROM c GROUP BY doc_id""",
)
def q_byte_entropy(spark, sf_dir):
    payload = F.encode("text", "UTF-8")
    return table(spark, sf_dir, "documents").select("doc_id", r6(byte_entropy(payload)).alias("entropy"))


# --- frames built from lineitem ---------------------------------------------------------------------


def _hex(value, digits: int):
    return F.lpad(F.hex(value.cast("long")), digits, "0")


def lineitem_frames(spark, sf_dir) -> DataFrame:
    """Ethernet frames whose fields encode the row: IPv4 with TCP or UDP, some VLAN-tagged, some IPv6."""
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    tag = F.when(n == 1, F.lit("81000005")).otherwise("")
    payload = F.hex(F.encode(F.repeat(F.concat("l_returnflag", "l_linestatus"), n * 10), "UTF-8"))
    size = n * 20
    flags = F.when(F.col("l_returnflag") == "R", "01").when(F.col("l_returnflag") == "A", "04").otherwise("10")
    sport, dport = _hex(p % 65536, 4), _hex(s % 65536, 4)
    tcp = F.concat(sport, dport, F.lit("000000010000000250"), flags, F.lit("006400000000"))
    udp = F.concat(sport, dport, _hex(size + 8, 4), F.lit("0000"))
    is_udp = n.isin(5, 6)
    l4 = F.when(is_udp, udp).otherwise(tcp)
    l4_size = F.when(is_udp, 8).otherwise(20)
    src, dst = (p * 7919 + s) % 4294967296, (s * 104729) % 4294967296
    v4 = F.concat(
        F.lit("0800"), F.lit("4500"), _hex(size + l4_size + 20, 4), F.lit("0000000040"),
        F.when(is_udp, "11").otherwise("06"), F.lit("0000"), _hex(src, 8), _hex(dst, 8),
    )
    group = F.lit("20010DB8" + "0" * 16)
    v6 = F.concat(
        F.lit("86DD60000000"), _hex(size + 20, 4), F.lit("0640"),
        group, _hex(4096 + p % 1000, 4), _hex(1 + s, 4), group, _hex(4096 + s % 1000, 4), _hex(1 + p % 60000, 4),
    )
    macs = F.concat(F.lit("02"), _hex(s, 10), F.lit("06"), _hex(p, 10))
    frame = F.unhex(F.concat(macs, tag, F.when(n == 7, v6).otherwise(v4), l4, payload, F.lit("0000")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", frame.alias("frame"))


_FRAME_FIELDS_SQL = """
f AS (
  SELECT *, (l_partkey * 7919 + l_suppkey) % 4294967296 AS src, (l_suppkey * 104729) % 4294967296 AS dst,
    CASE WHEN l_linenumber IN (5, 6) THEN 17 ELSE 6 END AS proto,
    CASE l_returnflag WHEN 'R' THEN '01' WHEN 'A' THEN '04' ELSE '10' END AS flags
  FROM lineitem)
"""


_DECODED_SQL = f"""
    WITH {_FRAME_FIELDS_SQL}
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
      CASE WHEN l_linenumber = 7 THEN '2001:db8::' || printf('%x', 4096 + l_partkey % 1000) || ':' || printf('%x', 1 + l_suppkey)
        ELSE (src >> 24) || '.' || ((src >> 16) & 255) || '.' || ((src >> 8) & 255) || '.' || (src & 255) END AS src_ip,
      CASE WHEN l_linenumber = 7 THEN '2001:db8::' || printf('%x', 4096 + l_suppkey % 1000) || ':' || printf('%x', 1 + l_partkey % 60000)
        ELSE (dst >> 24) || '.' || ((dst >> 16) & 255) || '.' || ((dst >> 8) & 255) || '.' || (dst & 255) END AS dst_ip,
      CAST(l_partkey % 65536 AS INTEGER) AS sport, CAST(l_suppkey % 65536 AS INTEGER) AS dport,
      CAST(proto AS INTEGER) AS proto, (proto = 6 AND flags <> '10') AS is_teardown,
      repeat(l_returnflag || l_linestatus, l_linenumber * 10) AS payload
    FROM f"""


@query("decode_headers", _DECODED_SQL)
def q_decode_headers(spark, sf_dir):
    decoded = decode_headers(lineitem_frames(spark, sf_dir))
    return decoded.where("decode_error is null").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "src_ip", "dst_ip", "sport", "dport", "proto",
        "is_teardown", F.decode("payload", "UTF-8").alias("payload"),
    )


@query("capture_files", _DECODED_SQL)
def q_capture_files(spark, sf_dir):
    """The frames written as capture files, the order key as time, and read back in ranges."""
    path = scratch_path(spark, "captures")
    write_captures(lineitem_frames(spark, sf_dir).withColumn("ts_us", F.col("l_orderkey") * 1_000_000 + F.col("l_linenumber")), path)
    row = F.col("ts_us") % 1_000_000
    read = read_captures(spark, path, range_bytes=1 << 20)
    decoded = decode_headers(read, extras=("payload", "head")).where("decode_error is null and read_error is null")
    # The keys come back from the time and from the hardware addresses.
    address = lambda at: F.conv(F.substring(F.hex("head"), at, 10), 16, 10).cast("long")
    return decoded.select(
        F.floor(F.col("ts_us") / 1_000_000).alias("l_orderkey"), row.cast("int").alias("l_linenumber"), address(15).alias("l_partkey"),
        address(3).alias("l_suppkey"), "src_ip", "dst_ip", "sport", "dport", "proto", "is_teardown",
        F.decode("payload", "UTF-8").alias("payload"),
    )


@query(
    "schedule_rows",
    """
    SELECT '10.0.0.' || n_nationkey AS attacker_ip, v AS victim_ip,
      epoch_us(TIMESTAMP '2018-02-14 04:00:00') + (n_nationkey * 60 + w * 600)::BIGINT * 1000000 AS start_us,
      epoch_us(TIMESTAMP '2018-02-14 04:00:00') + (n_nationkey * 60 + w * 600 + 300)::BIGINT * 1000000 AS end_us,
      CASE WHEN n_regionkey = 0 THEN 'Botnet' ELSE 'DoS' END AS label, n_name AS attack_subtype,
      CASE WHEN n_regionkey = 0 THEN 'test_ood' ELSE 'stratified_split' END AS target_folder,
      CASE WHEN n_regionkey = 0 THEN 2 ELSE 1 END AS priority
    FROM nation, (SELECT unnest(['172.16.0.1', '172.16.0.2']) AS v), (SELECT unnest([0, 1]) AS w)""",
)
def q_schedule_rows(spark, sf_dir):
    """A schedule document with an entry per nation: two victims, two windows."""
    nations = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # a fixed table of the data model
    clock = lambda minutes: f"{minutes // 60:02d}:{minutes % 60:02d}"
    attacks = {"zero_day": [], "closed_set": []}
    for n in nations:
        unknown = n.n_regionkey == 0
        windows = [[clock(n.n_nationkey + w * 10), clock(n.n_nationkey + w * 10 + 5)] for w in (0, 1)]
        attacks["zero_day" if unknown else "closed_set"].append(
            {
                "attack_name": f" {n.n_name} ", "date": "2018-02-14", "attacker_ips": [f"10.0.0.{n.n_nationkey} "],
                "victim_ips": ["172.16.0.1", " 172.16.0.2"], "time_windows": windows,
                "target_folder": "test_ood" if unknown else "stratified_split", "label": "Botnet" if unknown else "DoS",
            }
        )
    return schedule_from(spark, {"attacks": attacks}).drop("rule_order")


@query(
    "anonymised_prefix",
    f"""
    WITH {_FRAME_FIELDS_SQL},
    t AS (SELECT *, l_linenumber * 20 AS size, CASE WHEN proto = 17 THEN 8 ELSE 20 END AS l4 FROM f)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, substr(
      repeat('0', 24) || CASE WHEN l_linenumber = 1 THEN '81000005' ELSE '' END ||
      CASE WHEN l_linenumber = 7 THEN '86DD60000000' || printf('%04X', size + 20) || '0640' || repeat('0', 64)
        ELSE '08004500' || printf('%04X', size + l4 + 20) || '0000000040' || CASE WHEN proto = 17 THEN '11' ELSE '06' END
          || '0000' || repeat('0', 16) END
      || printf('%04X', l_partkey % 65536) || printf('%04X', l_suppkey % 65536)
      || CASE WHEN proto = 17 THEN printf('%04X', size + 8) || '0000'
              ELSE '000000010000000250' || flags || '006400000000' END
      || hex(encode(repeat(l_returnflag || l_linestatus, l_linenumber * 10))) || '0000', 1, 256) AS prefix
    FROM t""",
)
def q_anonymised_prefix(spark, sf_dir):
    decoded = decode_headers(lineitem_frames(spark, sf_dir), extras=("head",))
    prefix = anonymised_prefix(F.col("head"), F.col("ip_offset"), F.col("ip_version"))
    return decoded.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.hex(prefix).alias("prefix"))


# --- sessions ---------------------------------------------------------------------------------------


def cut_events(spark, sf_dir, payload: bool = False, timeout_s: float = DAY_S) -> DataFrame:
    p, segment = skew_segments(event_packets(spark, sf_dir, payload))
    return sessionize(p, segment, order=EVENT_ORDER, timeout_s=timeout_s)


def event_sessions(spark, sf_dir, with_packets: bool = False) -> DataFrame:
    cut = cut_events(spark, sf_dir, with_packets)
    return retain(identify(build_sessions(cut, timeout_s=DAY_S, with_packets=with_packets)), RATES)


@query(
    "sessionize",
    f"WITH {PACKETS_SQL}, {sessions_sql(DAY_US)} SELECT packet_no, session_instance, packet_rank FROM w3",
)
def q_sessionize(spark, sf_dir):
    return cut_events(spark, sf_dir).select("packet_no", "session_instance", "packet_rank")


@query(
    "sessionize_segmented",
    f"WITH {PACKETS_SQL}, {sessions_sql(DAY_US)} SELECT packet_no, session_instance, packet_rank FROM w3",
)
def q_sessionize_segmented(spark, sf_dir):
    """The same result by the way that large keys take."""
    p = time_segments(event_packets(spark, sf_dir))
    cut = sessionize(p, F.col("segment"), order=EVENT_ORDER, timeout_s=DAY_S)
    return cut.select("packet_no", "session_instance", "packet_rank")


@query(
    "sessions",
    f"""
    WITH {PACKETS_SQL}, {SESSION_ROWS_SQL}
    SELECT session_id, source_capture, canonical_tuple, session_instance, capture_id, capture_day, split_group_key,
      start_ts_us, end_ts_us, observed_packets, captured_packets, label, attack_subtype, split, kept FROM se""",
)
def q_sessions(spark, sf_dir):
    return event_sessions(spark, sf_dir).select(
        "session_id", "source_capture", "canonical_tuple", "session_instance", "capture_id", "capture_day",
        "split_group_key", "start_ts_us", "end_ts_us", "observed_packets", "captured_packets", "label",
        "attack_subtype", "split", "kept",
    )


CAPTURED_SQL = f"""
cp AS (
  SELECT *, lag(ts_us) OVER w AS prev_ts, first_value(is_up) OVER w AS first_up FROM w3
  WINDOW w AS (PARTITION BY source_capture, canonical_tuple, session_instance ORDER BY packet_rank)),
cq AS (
  SELECT *, CAST(255.0::DOUBLE * ln(1 + least(greatest(coalesce((ts_us - prev_ts) / 1000000.0::DOUBLE, 0), 0), 86400))
      / ln(86401::DOUBLE) AS FLOAT) AS delta_enc
  FROM cp WHERE packet_rank <= 18),
bt AS (
  SELECT packet_no, length(h) // 2 AS n, unnest(regexp_extract_all(h, '..')) AS byte
  FROM (SELECT packet_no, hex(encode(props)) AS h FROM pl)),
en AS (
  SELECT packet_no, CAST(-sum(c / n::DOUBLE * log2(c / n::DOUBLE)) AS FLOAT) AS entropy
  FROM (SELECT packet_no, n, byte, count(*) AS c FROM bt GROUP BY ALL) GROUP BY packet_no)
"""


@query(
    "session_packets",
    f"""
    WITH {PACKETS_SQL}, {sessions_sql(DAY_US)}, {CAPTURED_SQL}
    SELECT source_capture, canonical_tuple, session_instance, CAST(packet_rank AS INTEGER) AS pos,
      (is_up = first_up) AS is_forward, round(delta_enc::DOUBLE, 3) AS delta_enc, round(entropy::DOUBLE, 4) AS entropy,
      props AS content
    FROM cq JOIN en USING (packet_no)""",
)
def q_session_packets(spark, sf_dir):
    sessions = build_sessions(cut_events(spark, sf_dir, True), timeout_s=DAY_S)
    return sessions.select(
        "source_capture", "canonical_tuple", "session_instance", F.inline("packets")
    ).select(
        "source_capture",
        "canonical_tuple",
        "session_instance",
        "pos",
        "is_forward",
        r6(F.col("delta_enc").cast("double"), 3).alias("delta_enc"),
        r6(F.col("entropy").cast("double"), 4).alias("entropy"),
        F.decode("bytes", "UTF-8").alias("content"),
    )


TENSOR_SUMS_SQL = """
ts AS (
  SELECT source_capture, canonical_tuple, session_instance,
    sum(CASE WHEN is_up = first_up THEN 16 * delta_enc::DOUBLE + s ELSE 0 END) AS forward_sum,
    sum(CASE WHEN is_up = first_up THEN 0 ELSE 16 * delta_enc::DOUBLE + s END) AS backward_sum,
    sum(144 * entropy::DOUBLE) AS entropy_sum, count(*) AS packets
  FROM cq JOIN en USING (packet_no)
  JOIN (SELECT packet_no, sum(('0x' || byte)::INTEGER) AS s FROM bt GROUP BY 1) USING (packet_no) GROUP BY 1, 2, 3)
"""


def cell_sums(column: str, shape: tuple[int, int], axis: int):
    """Channel sums of flattened tensors, to compare them without listing thousands of cells."""

    @F.arrow_udf(ArrayType(DoubleType()))
    def run(cells: pa.Array) -> pa.Array:
        flat = matrix_of(cells).reshape(len(cells), *shape)
        return list_array(flat.sum(axis=axis + 1))

    return run(column)


@query(
    "session_tensor",
    f"""
    WITH {PACKETS_SQL}, {sessions_sql(DAY_US)}, {CAPTURED_SQL}, {TENSOR_SUMS_SQL}
    SELECT source_capture, canonical_tuple, session_instance, 7776 AS cells, round(forward_sum, 2) AS forward_sum,
      round(backward_sum, 2) AS backward_sum, round(entropy_sum, 2) AS entropy_sum
    FROM ts""",
)
def q_session_tensor(spark, sf_dir):
    sessions = build_sessions(cut_events(spark, sf_dir, True), timeout_s=DAY_S)
    dense = to_tensor(sessions.select("source_capture", "canonical_tuple", "session_instance", "packets"))

    summed = dense.withColumn("sums", cell_sums("tensor", (-1, 3), 0))
    dense = summed.select("*", *[r6(F.col("sums")[c], 2).alias(f"c{c}") for c in range(3)])
    return dense.select(
        "source_capture", "canonical_tuple", "session_instance", F.size("tensor").alias("cells"),
        F.col("c0").alias("forward_sum"), F.col("c1").alias("backward_sum"), F.col("c2").alias("entropy_sum"),
    )


@query(
    "scaled_image",
    f"""
    WITH {PACKETS_SQL}, {sessions_sql(DAY_US)}, {CAPTURED_SQL},
    c7 AS (SELECT * FROM cq WHERE packet_rank <= 7), cq7 AS (SELECT c7.*, entropy FROM c7 JOIN en USING (packet_no)),
    n AS (SELECT source_capture, canonical_tuple, session_instance FROM w3 GROUP BY ALL HAVING count(*) >= 7)
    SELECT source_capture, canonical_tuple, session_instance, 3024 AS cells,
      round(sum(16 * CAST(delta_enc::DOUBLE / 255.0::DOUBLE AS FLOAT)::DOUBLE + s), 3) AS raw_sum,
      round(sum(144 * entropy::DOUBLE) / 8.0, 3) AS entropy_sum
    FROM cq7 JOIN n USING (source_capture, canonical_tuple, session_instance)
    JOIN (SELECT packet_no, sum(CAST(('0x' || byte)::INTEGER / 255.0::DOUBLE AS FLOAT)::DOUBLE) AS s FROM bt GROUP BY 1) USING (packet_no)
    GROUP BY 1, 2, 3""",
)
def q_scaled_image(spark, sf_dir):
    sessions = build_sessions(cut_events(spark, sf_dir, True), timeout_s=DAY_S)
    chosen = sessions.where(long_enough(F.col("captured_packets"))).select(
        "source_capture", "canonical_tuple", "session_instance", "packets"
    )
    bounds = {"min_raw": 0.0, "max_raw": 255.0, "min_entropy": 0.0, "max_entropy": 8.0}
    images = to_scaled_image(chosen, bounds, 7)

    summed = images.withColumn("sums", cell_sums("image", (3, -1), 1))
    return summed.select(
        "source_capture", "canonical_tuple", "session_instance", F.size("image").alias("cells"),
        r6(F.col("sums")[0] + F.col("sums")[1], 3).alias("raw_sum"), r6(F.col("sums")[2], 3).alias("entropy_sum"),
    )


@query(
    "ingestion_report",
    f"""
    WITH {PACKETS_SQL}, {SESSION_ROWS_SQL}
    SELECT split, label, CAST(sum(kept::INTEGER) AS BIGINT) AS generated, CAST(sum(1 - kept::INTEGER) AS BIGINT) AS discarded
    FROM se GROUP BY ROLLUP (split, label)""",
)
def q_ingestion_report(spark, sf_dir):
    return ingestion_report(event_sessions(spark, sf_dir))


@query(
    "subtype_report",
    f"""
    WITH {PACKETS_SQL}, {SESSION_ROWS_SQL}
    SELECT attack_subtype, count(*) AS generated FROM se WHERE kept GROUP BY 1""",
)
def q_subtype_report(spark, sf_dir):
    return subtype_report(event_sessions(spark, sf_dir))


@query(
    "duplicate_session_ids",
    f"""
    WITH {PACKETS_SQL}, {SESSION_ROWS_SQL},
    twice AS (SELECT session_id, start_ts_us FROM se UNION ALL
              SELECT session_id, start_ts_us FROM se WHERE session_instance % 5 = 0)
    SELECT session_id, count(*) AS n FROM twice GROUP BY 1 HAVING count(*) > 1""",
)
def q_duplicate_ids(spark, sf_dir):
    """Sound data has no duplicates, so every fifth session is doubled to show the check."""
    sessions = event_sessions(spark, sf_dir).select("session_id", "session_instance")
    return duplicate_session_ids(sessions.unionByName(sessions.where("session_instance % 5 = 0")))


_AUDIT_CAP = 3


@query(
    "audit_sessions",
    f"""
    WITH RECURSIVE {PACKETS_SQL},
    a AS (SELECT source_capture, canonical_tuple, ts_us, packet_no, label,
            event_type IN ('purchase', 'signup') AS td,
            row_number() OVER (PARTITION BY source_capture, canonical_tuple ORDER BY ts_us, packet_no) AS i FROM pl),
    st AS (
      SELECT source_capture, canonical_tuple, i, ts_us, label, td, 1 AS s, 1 AS n FROM a WHERE i = 1
      UNION ALL
      SELECT a.source_capture, a.canonical_tuple, a.i, a.ts_us, a.label, a.td,
        CASE WHEN (st.td AND st.n <> {_AUDIT_CAP}) OR a.ts_us - st.ts_us > {DAY_US} THEN st.s + 1 ELSE st.s END,
        CASE WHEN (st.td AND st.n <> {_AUDIT_CAP}) OR a.ts_us - st.ts_us > {DAY_US} THEN 1 ELSE st.n + 1 END
      FROM st JOIN a ON a.source_capture = st.source_capture AND a.canonical_tuple = st.canonical_tuple AND a.i = st.i + 1),
    se AS (SELECT coalesce(arg_max(label, n) FILTER (n <= {_AUDIT_CAP} AND label <> 'Benign'), 'Benign') AS label
           FROM st GROUP BY source_capture, canonical_tuple, s)
    SELECT label, count(*) AS sessions, label <> 'Benign' AS is_attack FROM se GROUP BY label""",
)
def q_audit(spark, sf_dir):
    packets = event_packets(spark, sf_dir, teardown=F.col("event_type").isin("purchase", "signup"))
    packets, segment = skew_segments(packets)
    counted = audit.audit_sessions(
        packets,
        segment,
        keys=("source_capture", "canonical_tuple"),
        order=EVENT_ORDER,
        timeout_s=DAY_S,
        max_packets=_AUDIT_CAP,
    )
    return audit.audit_report(counted)


# --- schedule labelling -----------------------------------------------------------------------------

_RULES_SQL = """
rules AS (
  SELECT CASE WHEN n_nationkey % 4 = 3 THEN '172.16.0.' || (n_nationkey % 7) ELSE '10.0.0.' || n_nationkey END AS a_ip,
         CASE WHEN n_nationkey % 4 = 3 THEN '10.0.0.' || n_nationkey ELSE '172.16.0.' || (n_nationkey % 7) END AS v_ip,
         epoch_us(TIMESTAMP '2024-01-01 00:00:00') + (n_nationkey + j * 3) * 86400000000 AS lo,
         epoch_us(TIMESTAMP '2024-01-01 00:00:00') + (n_nationkey + j * 3 + 6) * 86400000000 AS hi,
         CASE (n_nationkey + j) % 3 WHEN 0 THEN 'Botnet' WHEN 1 THEN 'DoS' ELSE 'DDoS' END AS label,
         'rule-' || n_nationkey || '-' || j AS sub,
         CASE WHEN (n_nationkey + j) % 3 = 0 THEN 2 ELSE 1 END AS priority,
         n_nationkey * 3 + j AS ord
  FROM nation, (SELECT unnest([0, 1, 2]) AS j))
"""


def nation_schedule(spark, sf_dir) -> DataFrame:
    """Three overlapping rules per nation key, a quarter of them with attacker and victim swapped."""
    n, j = F.col("n_nationkey"), F.col("j")
    client = F.concat(F.lit("10.0.0."), n)
    server = F.concat(F.lit("172.16.0."), n % 7)
    start = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    day = F.lit(86_400_000_000)
    kind = (n + j) % 3
    return table(spark, sf_dir, "nation").withColumn("j", F.explode(F.array(*[F.lit(i) for i in range(3)]))).select(
        F.when(n % 4 == 3, server).otherwise(client).alias("attacker_ip"),
        F.when(n % 4 == 3, client).otherwise(server).alias("victim_ip"),
        (start + (n + j * 3) * day).alias("start_us"),
        (start + (n + j * 3 + 6) * day).alias("end_us"),
        F.when(kind == 0, "Botnet").when(kind == 1, "DoS").otherwise("DDoS").alias("label"),
        F.concat_ws("-", F.lit("rule"), n, j).alias("attack_subtype"),
        F.when(kind == 0, "hold_out_test").otherwise("stratified_split").alias("target_folder"),
        F.when(kind == 0, 2).otherwise(1).alias("priority"),
        (n * 3 + j).alias("rule_order"),
    )


def _labelled_sql(order: str) -> str:
    return f"""
    WITH {PACKETS_SQL}, {_RULES_SQL},
    hits AS (
      SELECT packet_no, r.label, r.sub,
        row_number() OVER (PARTITION BY packet_no ORDER BY {order}
                           CASE WHEN src_ip = a_ip AND dst_ip = v_ip THEN 0 ELSE 1 END, ord) AS rn
      FROM pk JOIN rules r ON ((src_ip = a_ip AND dst_ip = v_ip) OR (src_ip = v_ip AND dst_ip = a_ip))
       AND ts_us BETWEEN lo AND hi)
    SELECT pk.packet_no, coalesce(h.label, 'Benign') AS label, coalesce(sub, 'Benign') AS attack_subtype,
      CASE WHEN h.label = 'Botnet' THEN 'hold_out_test' ELSE 'stratified_split' END AS target_folder
    FROM pk LEFT JOIN (SELECT * FROM hits WHERE rn = 1) h ON pk.packet_no = h.packet_no"""


@query("schedule_labels", _labelled_sql("priority DESC,"))
def q_schedule_labels(spark, sf_dir):
    packets = event_packets(spark, sf_dir).drop("label", "attack_subtype")
    return label_packets(packets, nation_schedule(spark, sf_dir)).select(
        "packet_no", "label", "attack_subtype", "target_folder"
    )


@query("audit_labels", _labelled_sql(""))
def q_audit_labels(spark, sf_dir):
    packets = event_packets(spark, sf_dir).drop("label", "attack_subtype")
    return label_packets(packets, nation_schedule(spark, sf_dir), policy="first").select(
        "packet_no", "label", "attack_subtype", "target_folder"
    )


# --- captures ---------------------------------------------------------------------------------------


def order_files(spark, sf_dir) -> DataFrame:
    """A chunk file per order; orders still pending never arrived, which leaves gaps in the numbering."""
    o = F.col("o_orderkey")
    capture = F.concat(F.lit("mon-"), F.floor(o / 1000) % 30, F.lit("_C"), F.floor(o / 1000))
    stamp = F.date_format("o_orderdate", "yyyyMMddHHmmss")
    name = F.concat(capture, F.lit("_chunk_"), F.lpad((o % 1000).cast("string"), 5, "0"), F.lit("_"), stamp)
    arrived = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    return arrived.select(F.concat(F.lit("/in/"), name, F.lit(".pcap")).alias("path"))


_FILES_SQL = """
fl AS (
  SELECT 'mon-' || (o_orderkey // 1000 % 30) || '_C' || (o_orderkey // 1000) AS source_capture, o_orderkey % 1000 AS idx,
    '/in/mon-' || (o_orderkey // 1000 % 30) || '_C' || (o_orderkey // 1000) || '_chunk_' || printf('%05d', o_orderkey % 1000)
      || '_' || strftime(o_orderdate, '%Y%m%d%H%M%S') || '.pcap' AS path
  FROM orders WHERE o_orderstatus <> 'P')
"""


@query(
    "capture_groups",
    f"""
    WITH {_FILES_SQL}
    SELECT source_capture, substr(sha256(source_capture), 1, 16) AS capture_id,
      split_part(source_capture, '_', 1) AS capture_day, count(*) AS files,
      arg_min(path, idx) AS first_file, arg_max(path, idx) AS last_file,
      CAST(max(idx) + 1 - count(*) AS BIGINT) AS missing,
      CAST(max(idx) * (max(idx) + 1) // 2 - sum(idx) AS BIGINT) AS missing_sum
    FROM fl GROUP BY source_capture""",
)
def q_capture_groups(spark, sf_dir):
    grouped = caps.group_captures(caps.name_captures(order_files(spark, sf_dir)))
    return grouped.select(
        "source_capture",
        "capture_id",
        "capture_day",
        F.size("source_files").cast("long").alias("files"),
        F.get("source_files", F.lit(0)).alias("first_file"),
        F.element_at("source_files", -1).alias("last_file"),
        F.size("missing_chunks").cast("long").alias("missing"),
        F.aggregate("missing_chunks", F.lit(0).cast("long"), lambda a, x: a + x).alias("missing_sum"),
    )


@query(
    "capture_names",
    f"WITH {_FILES_SQL} SELECT path, source_capture, CAST(idx AS INTEGER) AS chunk_index FROM fl",
)
def q_capture_names(spark, sf_dir):
    return caps.name_captures(order_files(spark, sf_dir)).select("path", "source_capture", "chunk_index")


@query(
    "pending_captures",
    """
    SELECT c_custkey, substr(sha256('cap' || c_custkey), 1, 16) AS capture_id FROM customer
    WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')""",
)
def q_pending(spark, sf_dir):
    captures = table(spark, sf_dir, "customer").select(
        "c_custkey", hashing.capture_id(F.concat(F.lit("cap"), "c_custkey")).alias("capture_id")
    )
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(
        hashing.capture_id(F.concat(F.lit("cap"), "o_custkey")).alias("capture_id")
    )
    return caps.pending_captures(captures, done).select("c_custkey", "capture_id")


@query(
    "truncated_sessions",
    """
    WITH bad AS (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice < 20000)
    SELECT o_orderkey, coalesce(c_mktsegment = 'MACHINERY' OR c_nationkey = 3 OR bad.o_custkey IS NOT NULL, false)
      AS source_truncated
    FROM orders o LEFT JOIN customer ON c_custkey = o.o_custkey LEFT JOIN bad ON bad.o_custkey = c_custkey""",
)
def q_truncated(spark, sf_dir):
    captures = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("source_capture"),
        F.array().cast("array<string>").alias("source_files"),
        F.when(F.col("c_nationkey") == 3, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).alias("missing_chunks"),
        (F.col("c_mktsegment") == "MACHINERY").alias("known_truncated"),
    )
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "source_capture")
    flags = caps.truncated_captures(captures, orders.where("o_totalprice < 20000"))
    return caps.flag_sessions(orders, flags).select("o_orderkey", "source_truncated")


@query(
    "error_summary",
    """
    SELECT 'd' || (user_id % 5) AS source_capture, (user_id % 3) || '.pcap | ValueError: ' || substr(repeat(props, 30), 1, 160)
      AS error_key, count(*) AS n
    FROM events WHERE event_type = 'error' GROUP BY ALL""",
)
def q_error_summary(spark, sf_dir):
    uid = F.col("user_id")
    file = F.concat(F.lit("/in/"), uid % 3, F.lit(".pcap"))
    errors = table(spark, sf_dir, "events").where("event_type = 'error'").select(
        F.concat(F.lit("d"), uid % 5).alias("source_capture"),
        caps.error_key(file, F.lit("ValueError"), F.repeat("props", F.lit(30))).alias("error_key"),
    )
    return caps.error_summary(errors)


@query(
    "capture_telemetry",
    """
    SELECT 'd' || (user_id % 5) AS source_capture, user_id % 5 = 2 AS source_truncated, count(*) AS packets_read,
      count(*) FILTER (event_type = 'error') AS packet_error_count
    FROM events GROUP BY 1, 2""",
)
def q_telemetry(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("source_capture", F.concat(F.lit("d"), F.col("user_id") % 5))
    flags = e.select("source_capture").distinct().withColumn("source_truncated", F.col("source_capture") == "d2")
    return caps.capture_telemetry(e, e.where("event_type = 'error'"), flags)


# Captures of events miss some of their 13 chunks; one capture for each order status has no session, and its reader may have failed.
_COMPLETION_SQL = f"""
{PACKETS_SQL}, {SESSION_ROWS_SQL},
cp AS (
  SELECT 'd' || (user_id % 5) || '_link' AS source_capture,
    list_filter(range(0, 13), lambda c: NOT list_contains(list(DISTINCT event_id % 13) FILTER ((event_id % 13) % 5 <> user_id % 5), c)) AS missing,
    user_id % 5 = 2 AS known, user_id % 5 = 1 AND count(*) FILTER (event_type = 'error') > 0 AS broken,
    count(*) FILTER (event_type = 'error') AS packet_errors
  FROM events GROUP BY user_id % 5
  UNION ALL
  SELECT 'o' || o_orderstatus || '_link', [], false, o_orderstatus = 'F', CASE WHEN o_orderstatus = 'F' THEN count(*) ELSE 0 END
  FROM orders GROUP BY o_orderstatus),
sc AS (SELECT source_capture, count(*) AS sessions, count(*) FILTER (kept) AS kept FROM se GROUP BY 1),
cc AS (
  SELECT substr(sha256(source_capture), 1, 16) AS capture_id, source_capture,
    CASE WHEN NOT broken THEN 'OK' WHEN sessions IS NULL THEN 'FAILED' ELSE 'PARTIAL' END AS status,
    coalesce(sessions, 0) AS sessions, coalesce(kept, 0) AS kept, packet_errors, known OR len(missing) > 0 OR broken AS source_truncated,
    len(missing) AS n_missing
  FROM cp LEFT JOIN sc USING (source_capture))
"""


def event_completion(spark, sf_dir) -> DataFrame:
    e, orders = table(spark, sf_dir, "events"), table(spark, sf_dir, "orders")
    day, chunk = F.col("user_id") % 5, (F.col("event_id") % 13).cast("int")
    of_events = e.groupBy(day.alias("day")).agg(F.collect_set(F.when(chunk % 5 != day, chunk)).alias("present"))
    captures = of_events.select(
        F.concat(F.lit("d"), "day", F.lit("_link")).alias("source_capture"),
        F.array_except(F.sequence(F.lit(0), F.lit(12)), "present").alias("missing_chunks"),
        (F.col("day") == 2).alias("known_truncated"),
    )
    status = F.concat(F.lit("o"), "o_orderstatus", F.lit("_link")).alias("source_capture")
    empty = orders.select(status).distinct().select("source_capture", F.array().cast("array<int>").alias("missing_chunks"), F.lit(False).alias("known_truncated"))
    every = captures.unionByName(empty).select(
        hashing.capture_id("source_capture").alias("capture_id"), "*", F.array().cast("array<string>").alias("source_files")
    )
    faults = e.where("event_type = 'error'").select(F.concat(F.lit("d"), day, F.lit("_link")).alias("source_capture"), (day == 1).alias("is_read_error"))
    faults = faults.unionByName(orders.where("o_orderstatus = 'F'").select(status, F.lit(True).alias("is_read_error")))
    read = faults.where("is_read_error")
    sessions = caps.flag_sessions(event_sessions(spark, sf_dir), caps.truncated_captures(every, read))
    return caps.capture_completion(every, sessions, faults, read)


@query(
    "capture_completion",
    f"WITH {_COMPLETION_SQL} SELECT * FROM cc",
)
def q_completion(spark, sf_dir):
    """Rows of a run, as the log of ingested captures has them after a second run took the failed ones again."""
    path = scratch_path(spark, "completion")
    made = stage_table(event_completion(spark, sf_dir), "completion")
    append_completion(made, path, "first")
    append_completion(made.where("status = 'FAILED'"), path, "second")
    return latest(read_log(spark, path)).select(
        "capture_id", "source_capture", "status", "sessions", "kept", "packet_errors", "source_truncated", F.size("missing_chunks").cast("long").alias("n_missing")
    )


@query(
    "completion_totals",
    f"""WITH {_COMPLETION_SQL}
    SELECT count(*) AS captures, count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status = 'PARTIAL') AS partial,
      count(*) FILTER (source_truncated) AS truncated, count(*) FILTER (n_missing > 0) AS incomplete, sum(n_missing)::BIGINT AS missing_chunks,
      sum(sessions)::BIGINT AS sessions, sum(kept)::BIGINT AS kept, sum(packet_errors)::BIGINT AS packet_errors FROM cc""",
)
def q_completion_totals(spark, sf_dir):
    return caps.completion_totals(event_completion(spark, sf_dir))


# --- labels and small predicates --------------------------------------------------------------------

SEGMENTS = {"AUTOMOBILE": 0, "BUILDING": 1, "FURNITURE": 2, "HOUSEHOLD": 3, "MACHINERY": 4}


@query(
    "minimum_length",
    "SELECT o_orderkey, CAST(o_custkey % 19 AS INTEGER) AS captured_packets FROM orders WHERE o_custkey % 19 >= 7",
)
def q_minimum_length(spark, sf_dir):
    sessions = table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_custkey") % 19).cast("int").alias("captured_packets")
    )
    return sessions.where(long_enough(F.col("captured_packets")))


@query(
    "label_index",
    """SELECT c_custkey, CAST(list_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'],
       c_mktsegment) - 1 AS INTEGER) AS label FROM customer""",
)
def q_label_index(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        "c_custkey", encode_label(F.col("c_mktsegment"), "customers", SEGMENTS).alias("label")
    )


@query(
    "label_text",
    """
    SELECT coalesce(CASE WHEN value >= 1 THEN event_type END, 'Benign') AS label, count(*) AS n
    FROM events GROUP BY 1""",
)
def q_label_text(spark, sf_dir):
    raw = F.when(F.col("value") >= 1, F.encode(F.concat(F.lit("  "), "event_type", F.lit(" ")), "UTF-8"))
    labels = table(spark, sf_dir, "events").select(normalise_label(raw).alias("label"))
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
