"""The registered queries of the corpus operators, with SQL where it can state their result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from netsieve.llm.alignment import align_documents
from netsieve.llm.common import table
from netsieve.llm.decontaminate import contamination_report, names_digest
from netsieve.llm.language import identify_languages
from netsieve.llm.licenses import license_report
from netsieve.llm.mixing import mix_sources
from netsieve.llm.negatives import mine
from netsieve.llm.neighbours import search
from netsieve.llm.quality import score_quality
from netsieve.llm.repeats import repeat_report
from netsieve.llm.simhash import near_duplicates
from netsieve.llm.token_counts import DEFAULT_RANKS, masking_edits, read_ranks, with_edited_counts
from netsieve.llm.toxicity import score_documents
from netsieve.llm.url_filter import judge_urls

Runner = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Runner] = {}
SQL: dict[str, str] = {}

URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def query(name: str, sql: str | None = None) -> Callable[[Runner], Runner]:
    def add(run: Runner) -> Runner:
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return add


@query(
    "op1_url_filter",
    r"""
WITH p AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(h, p, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                            ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
f AS (
  SELECT page_id, host, path,
         (SELECT max_by(r.h || r.p, length(r.h || r.p)) FROM r
          WHERE (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p)) AS rule
  FROM p)
SELECT page_id, host, path, rule, coalesce(r.verdict, 'allow') AS verdict
FROM f LEFT JOIN r ON f.rule = r.h || r.p
""",
)
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


@query(
    "op2_benchmark_decontamination",
    r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(words), 10) AS n, array_to_string(words[i : i + least(len(words), 10) - 1], ' ') AS win
  FROM (SELECT item, words, unnest(range(1, greatest(len(words) - 8, 2))) AS i FROM b WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT r, i, n, array_to_string(words[i : i + n - 1], ' ') AS win
  FROM (SELECT r, words, unnest(range(1, len(words) + 1)) AS i FROM w) d JOIN sizes ON d.i + n - 1 <= len(d.words)),
hits AS (SELECT r, i, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
hw AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hits) GROUP BY r),
hi AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)
""",
)
def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)
    return report.select("doc_id", "n_words", "n_hit", "n_items", names_digest(F.col("items")).alias("items_sha256"), "contaminated")


@query("op3_suffix_array_dedup")
def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = repeat_report(table(spark, sf_dir, "documents"), length=200, keep="none")
    return report.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query(
    "op5_source_mix",
    r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
s1 AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w,
         row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s0),
s2 AS (
  SELECT *, sum(source_size) OVER () AS total,
         coalesce(sum(3 * source_size) OVER (ORDER BY (3 * source_size)::DOUBLE / w, place
                                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(w) OVER (ORDER BY (3 * source_size)::DOUBLE / w, place
                      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS onward
  FROM s1),
s3 AS (SELECT *, (3 * source_size)::DOUBLE <= (total - before)::DOUBLE * w::DOUBLE / onward::DOUBLE AS is_full FROM s2),
s4 AS (
  SELECT *, coalesce(sum(w) FILTER (NOT is_full) OVER (), 1) AS open_w,
         coalesce(sum(3 * source_size) FILTER (is_full) OVER (), 0) AS full_size FROM s3),
s AS (
  SELECT source, source_size, CASE WHEN is_full THEN (3 * source_size)::DOUBLE
           ELSE (total - full_size)::DOUBLE * w::DOUBLE / open_w::DOUBLE END AS target FROM s4),
l AS (
  SELECT d.*, s.source_size, s.target, floor(s.target)::BIGINT AS quota,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN size = 0 THEN 0 ELSE (quota // source_size) * size
         + greatest(0, least(size, quota % source_size - start)) END::BIGINT AS taken
FROM l
""",
)
def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, _, _ = mix_sources(table(spark, sf_dir, "documents"))
    return documents.select("doc_id", "size", "source_size", "target", "taken")


@query("op6_simhash_near_dedup")
def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), width=4, radius=4)
    return found.select("doc_id", "fingerprint", "component_id")


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return score_documents(table(spark, sf_dir, "documents"), labels)


@query("op10_language_id")
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


@query("op4_nearest_neighbours")
def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return search(vectors, F.col("vec_id") % 100 == 0, k=10)


#: What personal data look like, and what takes its place: addresses of mail and hosts, long numbers.
MASKS = [(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", "<mail>"), (r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "<host>"), (r"\d{7,}", "<number>")]


@query("op7_edited_token_counts")
def op7_edited_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document before and after personal data in it are masked."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = with_edited_counts(docs, masking_edits(MASKS)("text"), read_ranks(DEFAULT_RANKS))
    return counted.select("doc_id", "counts.*")


@query("op9_license_scan")
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(table(spark, sf_dir, "documents"))


@query("op13_quality")
def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return score_quality(table(spark, sf_dir, "documents"), labels)


@query(
    "op11_hard_negatives",
    r"""
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r AS a, b.r AS b, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         list_inner_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.r <> b.r),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, b) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
       row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.vec_id, n.b)::INTEGER AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON p.a = n.a AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY rank <= 10
""",
)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), F.col("embedding").alias("vector"))
    return mine(rows, F.col("vec_id") % 100 == 0)


@query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned, _ = align_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))
