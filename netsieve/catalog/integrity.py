"""Queries over profiles, validation, manifests and result documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from netsieve.catalog.base import DAY_S, DAY_US, PACKETS_SQL, SCORED_SQL, query, r6, scored_rows, sessions_sql, table
from netsieve.catalog.ingestion import CAPTURED_SQL, cut_events
from netsieve.functions.paths import normalise_path, path_split
from netsieve.operators import integrity as it, profile
from netsieve.operators.sessions import build_sessions
from netsieve.operators.tensors import min_max
from netsieve.sources import results

_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "value_bounds",
    " UNION ALL ".join(
        f'SELECT \'{c}\' AS "column", min({c}) AS min_value, max({c}) AS max_value, count({c}) AS n FROM lineitem'
        for c in _COLUMNS
    ),
)
def q_value_bounds(spark, sf_dir):
    return profile.value_bounds(table(spark, sf_dir, "lineitem"), _COLUMNS)


@query(
    "session_bounds",
    f"""
    WITH {PACKETS_SQL}, {sessions_sql(DAY_US)}, {CAPTURED_SQL},
    n AS (SELECT source_capture, canonical_tuple, session_instance, count(*) AS c FROM cq GROUP BY ALL),
    m AS (SELECT max(('0x' || byte)::INTEGER)::DOUBLE AS top FROM bt JOIN cq USING (packet_no)),
    d AS (SELECT max(delta_enc)::DOUBLE AS delta, min(entropy)::DOUBLE AS lo, max(entropy)::DOUBLE AS hi
          FROM cq JOIN en USING (packet_no))
    SELECT (SELECT count(*) FROM n) AS valid_sessions, 0.0::DOUBLE AS min_raw, round(greatest(delta, top), 4) AS max_raw,
      0.0::DOUBLE AS min_delta, round(delta, 4) AS max_delta, 0.0::DOUBLE AS min_packet, top AS max_packet,
      round(CASE WHEN (SELECT min(c) FROM n) < 18 THEN least(lo, 0) ELSE lo END, 4) AS min_entropy, round(hi, 4) AS max_entropy
    FROM m, d""",
)
def q_session_bounds(spark, sf_dir):
    sessions = build_sessions(cut_events(spark, sf_dir, True), timeout_s=DAY_S)
    bounds = profile.check_bounds(profile.profile_bounds(sessions), profile.SESSION_BOUND_CHECKS)
    return bounds.select("valid_sessions", *[r6(c, 4).alias(c) for c in bounds.columns if c != "valid_sessions"])


@query(
    "min_max_scaled",
    """
    WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_extendedprice - lo) / (hi - lo), 6) AS scaled
    FROM lineitem, b""",
)
def q_min_max(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    # One row of bounds, known small by construction.
    b = df.agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))
    scaled = min_max(F.col("l_extendedprice"), F.col("lo"), F.col("hi"))
    return df.join(F.broadcast(b)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6(scaled).alias("scaled"))


@query(
    "row_validation",
    """
    WITH v AS (
      SELECT l_returnflag AS file, l_orderkey * 10 + l_linenumber AS id,
        CASE WHEN l_linenumber > 6 THEN 'wrong shape' WHEN l_linestatus = 'X' THEN 'label not allowed'
             WHEN l_quantity < 2 - 1e-6 OR l_quantity > 49 + 1e-6 THEN 'quantity out of range'
             WHEN l_discount > 0.09 + 1e-6 THEN 'discount out of range' END AS reason
      FROM lineitem),
    k AS (SELECT *, row_number() OVER (PARTITION BY file, reason ORDER BY id) AS rn FROM v WHERE reason IS NOT NULL)
    SELECT file, reason, count(*) AS invalid, CAST(sum(id) FILTER (rn <= 5) AS BIGINT) AS example_sum
    FROM k GROUP BY 1, 2""",
)
def q_row_validation(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    reason = profile.first_reason(
        [
            ("wrong shape", F.col("l_linenumber") > 6),
            ("label not allowed", F.col("l_linestatus") == "X"),
            ("quantity out of range", profile.outside(F.col("l_quantity"), (2.0, 49.0))),
            ("discount out of range", F.col("l_discount") > 0.09 + profile.TOLERANCE),
        ]
    )
    out = profile.validate_rows(df, reason, "l_returnflag", "id")
    total = F.aggregate("examples", F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select("file", "reason", "invalid", total.alias("example_sum"))


@query(
    "session_validation",
    f"""
    WITH {PACKETS_SQL}, {sessions_sql(DAY_US)},
    u AS (SELECT source_capture, canonical_tuple, session_instance, bool_or(pri = 2) AS bad FROM w3 GROUP BY ALL)
    SELECT source_capture AS file, 'label not allowed' AS reason, count(*) AS invalid FROM u WHERE bad GROUP BY 1""",
)
def q_session_validation(spark, sf_dir):
    sessions = build_sessions(cut_events(spark, sf_dir, True), timeout_s=DAY_S).withColumn(
        "session_id", F.concat_ws("/", "canonical_tuple", "session_instance")
    )
    out = profile.validate_rows(sessions, profile.session_reason(), "source_capture", "session_id")
    return out.select("file", "reason", "invalid")


@query(
    "split_violations",
    f"""
    WITH {SCORED_SQL}, v AS (
      SELECT CASE WHEN split <> 'test_ood' THEN 'wrong_split' WHEN label <> 3 THEN 'label_not_allowed' END AS reason FROM sc)
    SELECT reason, count(*) AS n FROM v WHERE reason IS NOT NULL GROUP BY 1""",
)
def q_split_violations(spark, sf_dir):
    return it.split_violations(scored_rows(spark, sf_dir), "test_ood", [3])


# --- manifests --------------------------------------------------------------------------------------


@query(
    "manifest_reconciliation",
    """
    WITH e AS (SELECT doc_id, n_chars % 2 AS sha256, 0 AS size_bytes FROM documents WHERE doc_id % 10 <> 9),
    a AS (SELECT doc_id, quality AS sha256, toxic AS size_bytes FROM labels)
    SELECT doc_id AS path, CASE WHEN a.sha256 IS NULL THEN 'missing' WHEN e.sha256 IS NULL THEN 'unexpected'
      WHEN e.sha256 <> a.sha256 THEN 'hash_mismatch' WHEN e.size_bytes <> a.size_bytes THEN 'size_mismatch' ELSE 'ok' END AS status
    FROM e FULL JOIN a USING (doc_id)""",
)
def q_reconcile(spark, sf_dir):
    return document_manifests(spark, sf_dir).select("path", "status")


def document_manifests(spark, sf_dir) -> DataFrame:
    expected = table(spark, sf_dir, "documents").where("doc_id % 10 <> 9").select(
        F.col("doc_id").alias("path"), (F.col("n_chars") % 2).alias("sha256"), F.lit(0).alias("size_bytes")
    )
    actual = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("path"), F.col("quality").alias("sha256"), F.col("toxic").alias("size_bytes")
    )
    return it.reconcile(expected, actual, [("sha256", "hash_mismatch"), ("size_bytes", "size_mismatch")])


_SUMMARY_SQL = """
e AS (SELECT doc_id, n_chars % 2 AS h, 0 AS z FROM documents WHERE doc_id % 10 <> 9),
a AS (SELECT doc_id, quality AS h, toxic AS z FROM labels),
st AS (
  SELECT 's' || (doc_id % 4) AS split, CASE WHEN a.h IS NULL THEN 'missing' WHEN e.h IS NULL THEN 'unexpected'
      WHEN e.h <> a.h OR e.z <> a.z THEN 'mismatch' ELSE 'ok' END AS status
  FROM e FULL JOIN a USING (doc_id)),
su AS (
  SELECT sp AS split, count(*) FILTER (status <> 'unexpected') AS expected, count(*) FILTER (status <> 'missing') AS actual,
    count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'unexpected') AS unexpected,
    count(*) FILTER (status = 'mismatch') AS mismatched,
    (SELECT count(*) FROM documents WHERE n_chars < 100 AND 's' || (doc_id % 4) = sp) AS read_errors
  FROM (SELECT unnest(['s0', 's1', 's2', 's3', 's4']) AS sp) LEFT JOIN st ON st.split = sp GROUP BY 1)
"""


def document_summary(spark, sf_dir) -> DataFrame:
    errors = table(spark, sf_dir, "documents").where("n_chars < 100").select(F.col("doc_id").alias("path"))
    split = F.concat(F.lit("s"), F.col("path") % 4)
    return it.integrity_summary(document_manifests(spark, sf_dir), errors, [f"s{i}" for i in range(5)], split)


@query(
    "integrity_summary",
    f"""WITH {_SUMMARY_SQL} SELECT *, missing + unexpected + mismatched + read_errors = 0 AND expected > 0 AS integrity_ok FROM su""",
)
def q_integrity_summary(spark, sf_dir):
    return document_summary(spark, sf_dir)


@query(
    "integrity_status",
    f"""WITH {_SUMMARY_SQL}
    SELECT CASE WHEN sum(missing + unexpected + mismatched + read_errors) = 0 AND sum(expected) > 0 THEN 'PASS' ELSE 'FAIL' END AS status,
      sum(expected)::BIGINT AS expected_files, sum(actual)::BIGINT AS actual_files, sum(missing)::BIGINT AS missing_files,
      sum(unexpected)::BIGINT AS unexpected_files, sum(mismatched)::BIGINT AS mismatched_files, sum(read_errors)::BIGINT AS read_errors
    FROM su""",
)
def q_integrity_status(spark, sf_dir):
    return it.integrity_status(document_summary(spark, sf_dir))


@query(
    "manifest_lines",
    """
    WITH l AS (
      SELECT doc_id AS line_no, doc_id % 7 AS m, sha256(text) AS h,
        'data/processed/train_known/' || (doc_id % 97) || '.hdf5' AS p FROM documents),
    o AS (SELECT line_no, row_number() OVER (PARTITION BY p ORDER BY line_no) AS rn FROM l WHERE m > 3)
    SELECT line_no, CASE WHEN m = 2 THEN NULL WHEN m = 3 THEN 'other/' || line_no ELSE p END AS path,
      CASE WHEN m > 2 THEN h END AS sha256,
      CASE WHEN m = 2 THEN 'bad_format' WHEN m = 3 THEN 'other_path' WHEN rn = 1 THEN 'ok' ELSE 'duplicate' END AS status
    FROM l LEFT JOIN o USING (line_no) WHERE m > 1""",
)
def q_manifest_lines(spark, sf_dir):
    m, digest = F.col("doc_id") % 7, F.sha2(F.encode("text", "UTF-8"), 256)
    path = F.concat(F.lit("./.\\data\\processed/train_known/"), F.col("doc_id") % 97, F.lit(".hdf5"))
    line = (
        F.when(m == 0, F.concat(F.lit("# "), digest))
        .when(m == 1, "   ")
        .when(m == 2, F.concat(F.lit("zz"), digest))
        .when(m == 3, F.concat(F.upper(digest), F.lit(" *./other/"), "doc_id"))
        .otherwise(F.concat(digest, F.lit("  "), path))
    )
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("line_no"), line.alias("line"))
    return it.parse_manifest(lines)


@query(
    "path_splits",
    """
    SELECT page_id, 'data/processed/' || (CASE page_id % 5 WHEN 0 THEN 'train_known' WHEN 1 THEN 'val_known'
        WHEN 2 THEN 'test_known' WHEN 3 THEN 'test_ood' ELSE 'elsewhere' END) || '/' || url AS path,
      CASE page_id % 5 WHEN 0 THEN 'train_known' WHEN 1 THEN 'val_known' WHEN 2 THEN 'test_known' WHEN 3 THEN 'test_ood'
        ELSE 'unknown' END AS split
    FROM pages""",
)
def q_path_splits(spark, sf_dir):
    m = F.col("page_id") % 5
    folder = (
        F.when(m == 0, "train_known").when(m == 1, "val_known").when(m == 2, "test_known").when(m == 3, "test_ood")
    ).otherwise("elsewhere")
    raw = F.concat(F.lit("./././data\\processed\\"), folder, F.lit("\\"), F.translate("url", "/", "\\"))
    path = normalise_path(raw)
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"), path_split(path).alias("split"))


_FINGERPRINTED = ("doc_id", "text", "lang", "source", "n_chars")
_MARKED_SQL = " || ".join(
    f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in _FINGERPRINTED
)
_PARTS_SQL = " || '|' || ".join(
    f"coalesce(sum(('0x' || substr(h, {1 + 16 * i}, 16))::UBIGINT::HUGEINT), 0)::VARCHAR" for i in range(4)
)


@query(
    "table_fingerprint",
    f"""
    WITH r AS (SELECT sha256({_MARKED_SQL}) AS h FROM documents)
    SELECT sha256(count(*)::VARCHAR || '|' || {_PARTS_SQL}) AS fingerprint, count(*) AS rows FROM r""",
)
def q_fingerprint(spark, sf_dir):
    return it.fingerprint(table(spark, sf_dir, "documents"), list(_FINGERPRINTED))


# --- result documents -------------------------------------------------------------------------------


def order_documents(spark, sf_dir) -> DataFrame:
    """A metric document per order: some without metrics, some broken, some with a text instead of a number."""
    k = F.col("o_orderkey")
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    full = F.concat(
        F.lit('{"osr_configuration": {"pca_components": '), F.col("o_custkey"), F.lit(', "selected_lambda_mad": 1.25}, "metrics": {"binary_detection": {"ood_auroc": '),
        F.when(k % 5 == 1, F.lit('"NaN"')).otherwise(price), F.lit("}}}"),
    )
    text = F.when(k % 11 == 0, F.lit(None)).when(k % 7 == 0, "{broken").when(k % 3 == 0, '{"metrics": {}}').otherwise(full)
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("value"))


@query(
    "result_documents",
    """
    SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'MISSING_JSON' WHEN o_orderkey % 7 = 0 THEN 'JSON_READ_ERROR' ELSE 'OK' END AS status,
      CASE WHEN f THEN CAST(o_custkey AS INTEGER) END AS pca_components_real, CASE WHEN f THEN 1.25::DOUBLE END AS selected_lambda_mad,
      CASE WHEN f AND o_orderkey % 5 <> 1 THEN o_totalprice END AS ood_auroc, NULL::DOUBLE AS binary_mcc
    FROM (SELECT *, o_orderkey % 11 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 3 <> 0 AS f FROM orders)""",
)
def q_result_documents(spark, sf_dir):
    return results.flatten_results(order_documents(spark, sf_dir)).select(
        "o_orderkey", "status", "pca_components_real", "selected_lambda_mad", "ood_auroc", "binary_mcc"
    )


@query(
    "markdown_table",
    """
    WITH c AS (SELECT l_returnflag, string_agg('"' || l_linestatus || '":' || n, ',' ORDER BY l_linestatus) AS j, sum(n) AS n
               FROM (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1)
    SELECT '| ' || l_returnflag || ' | ' || n || ' | {' || j || '} |' AS line FROM c""",
)
def q_markdown(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    rows = cells.groupBy("l_returnflag").agg(
        F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("l_linestatus", "n"))).alias("by_status")
    )
    return results.markdown_rows(rows)
