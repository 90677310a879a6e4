"""Queries over classifier outputs, detection scores and run tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from netsieve.catalog.base import SCORED_SQL, query, r6, scored_rows, table
from netsieve.functions.scoring import argmax_class, focal_loss
from netsieve.operators import classification as cls, detection as det, geometry, profile, runs, sampling

CLASSES = (0, 1, 2, 3)


def lineitem_predictions(spark, sf_dir) -> DataFrame:
    """Return flag as true class, line number mod 3 as prediction; class 3 never occurs."""
    flag = F.col("l_returnflag")
    label = F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2)
    return table(spark, sf_dir, "lineitem").select(label.alias("label"), (F.col("l_linenumber") % 3).cast("int").alias("pred"))


_CONF_SQL = """
lp AS (
  SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label, CAST(l_linenumber % 3 AS INTEGER) AS pred
  FROM lineitem),
cl AS (SELECT unnest([0, 1, 2, 3]) AS label),
pc AS (
  SELECT cl.label, (SELECT count(*) FROM lp WHERE lp.label = cl.label)::DOUBLE AS s,
    (SELECT count(*) FROM lp WHERE lp.pred = cl.label)::DOUBLE AS p,
    (SELECT count(*) FROM lp WHERE lp.pred = cl.label AND lp.label = cl.label)::DOUBLE AS tp,
    (SELECT count(*) FROM lp)::DOUBLE AS t
  FROM cl),
rp AS (
  SELECT *, CASE WHEN p > 0 THEN tp / p ELSE 0 END AS pr, CASE WHEN s > 0 THEN tp / s ELSE 0 END AS rc,
    CASE WHEN s > 0 THEN (s - tp) / s ELSE 0 END AS fnr, CASE WHEN t - s > 0 THEN (p - tp) / (t - s) ELSE 0 END AS fpr
  FROM pc),
rf AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END AS f1 FROM rp)
"""


@query(
    "confusion_matrix",
    f"""WITH {_CONF_SQL} SELECT a.label, b.label AS pred,
        (SELECT count(*) FROM lp WHERE lp.label = a.label AND lp.pred = b.label) AS n FROM cl a, cl b""",
)
def q_confusion(spark, sf_dir):
    return cls.dense_confusion(cls.confusion(lineitem_predictions(spark, sf_dir)), CLASSES)


def _report(spark, sf_dir, **kw):
    return cls.classification_report(cls.confusion(lineitem_predictions(spark, sf_dir)), CLASSES, **kw)


def _report_columns(report: DataFrame) -> DataFrame:
    rates = ("precision", "recall", "fnr", "fpr", "f1")
    return report.select("label", *[r6(c).alias(c) for c in rates], "support", "predicted")


@query(
    "classification_report",
    f"""WITH {_CONF_SQL} SELECT label, round(pr, 6) AS precision, round(rc, 6) AS recall, round(fnr, 6) AS fnr,
        round(fpr, 6) AS fpr, round(f1, 6) AS f1, s::BIGINT AS support, p::BIGINT AS predicted FROM rf""",
)
def q_report(spark, sf_dir):
    return _report_columns(_report(spark, sf_dir))


@query(
    "validation_report",
    f"""WITH {_CONF_SQL} SELECT label, round(pr, 6) AS precision, round(rc, 6) AS recall, round(1 - rc, 6) AS fnr,
        round(fpr, 6) AS fpr, round(f1, 6) AS f1, s::BIGINT AS support, p::BIGINT AS predicted FROM rf""",
)
def q_validation_report(spark, sf_dir):
    return _report_columns(_report(spark, sf_dir, fnr_from_recall=True))


@query(
    "classification_summary",
    f"""WITH {_CONF_SQL}
    SELECT max(t)::BIGINT AS total_samples, round(sum(tp) / max(t), 6) AS accuracy, round(avg(pr), 6) AS macro_precision,
      round(avg(rc), 6) AS macro_recall, round(avg(rc) FILTER (s > 0), 6) AS present_recall, round(avg(f1), 6) AS macro_f1,
      round(sum(f1 * s) / sum(s), 6) AS weighted_f1,
      round((sum(tp) * max(t) - sum(s * p)) / sqrt((max(t) * max(t) - sum(p * p)) * (max(t) * max(t) - sum(s * s))), 6) AS mcc
    FROM rf""",
)
def q_summary(spark, sf_dir):
    s = cls.classification_summary(_report(spark, sf_dir))
    return s.select("total_samples", *[r6(c).alias(c) for c in s.columns if c != "total_samples"])


@query(
    "argmax_prediction",
    """SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS pred FROM embeddings""",
)
def q_argmax(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", argmax_class(F.col("embedding")).alias("pred"))


@query(
    "focal_loss",
    """
    WITH l AS (
      SELECT vec_id, label % 3 AS y, ln(list_sum(list_transform(embedding, lambda v: exp(v::DOUBLE)))) - embedding[label + 1]::DOUBLE AS ce
      FROM embeddings)
    SELECT vec_id, round(pow(1 - exp(-ce), 2) * CASE y WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 ELSE 2.0 END * ce, 6) AS loss FROM l""",
)
def q_focal(spark, sf_dir):
    loss = focal_loss(F.col("embedding"), F.col("label"), [(0.5, 1.0, 2.0)[i % 3] for i in range(64)])
    return table(spark, sf_dir, "embeddings").select("vec_id", r6(loss).alias("loss"))


@query(
    "class_weights",
    """
    WITH c AS (SELECT label % 4 AS label, count(*) AS n FROM embeddings GROUP BY 1),
    t AS (SELECT sum(n) AS total, count(*) AS present FROM c)
    SELECT CAST(cl AS INTEGER) AS label, coalesce(n, 0) AS n, round(coalesce(total / (present * n)::DOUBLE, 0), 6) AS weight
    FROM (SELECT unnest([0, 1, 2, 3, 4]) AS cl) LEFT JOIN c ON c.label = cl, t""",
)
def q_class_weights(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").withColumn("label", F.col("label") % 4)
    return profile.class_weights(df, range(5)).withColumn("weight", r6("weight"))


@query(
    "class_count_check",
    """
    WITH a AS (SELECT 'c' || label AS label, count(*) AS actual FROM embeddings WHERE label <> 4 GROUP BY 1),
    e AS (SELECT 'c' || label AS label, count(*) AS expected FROM embeddings
          WHERE label NOT IN (2, 9) OR embedding[1] > 0 GROUP BY 1)
    SELECT label, coalesce(expected, 0) AS expected, coalesce(actual, 0) AS actual,
      CASE WHEN label = 'c9' THEN 'unexpected_label' WHEN actual IS NULL THEN 'missing_class'
           WHEN actual <> coalesce(expected, 0) THEN 'count_mismatch' ELSE 'ok' END AS status
    FROM e FULL JOIN a USING (label)""",
)
def q_count_check(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("name", F.concat(F.lit("c"), "label"))
    actual = profile.class_counts(e.where("label <> 4"), "name")
    expected = profile.class_counts(e.where("label not in (2, 9) or embedding[0] > 0"), "name")
    return profile.check_counts(actual, expected, [f"c{i}" for i in range(9)])


_GEOMETRY_SQL = """
d AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM {src}),
cs AS (SELECT label, dim, sum(x) AS s, sum(x * x) AS q, count(*) AS n FROM d GROUP BY 1, 2),
gd AS (SELECT dim, sum(q) AS q, sum(s * s / n) AS own, sum(s) * sum(s) / sum(n) AS common, sum(n) AS n FROM cs GROUP BY 1),
gg AS (SELECT (sum(q) - sum(own)) / max(n) AS intra, (sum(own) - sum(common)) / max(n) AS inter FROM gd)
"""


@query(
    "class_geometry",
    f"""WITH {_GEOMETRY_SQL.format(src='embeddings')}
    SELECT round(intra, 6) AS intra_class_scatter, round(inter, 6) AS inter_class_scatter,
      round(intra / (inter + 1e-6), 5) AS intra_inter_ratio FROM gg""",
)
def q_geometry(spark, sf_dir):
    g = geometry.class_geometry(table(spark, sf_dir, "embeddings"), "embedding")
    return g.select(
        r6("intra_class_scatter").alias("intra_class_scatter"),
        r6("inter_class_scatter").alias("inter_class_scatter"),
        r6("intra_inter_ratio", 5).alias("intra_inter_ratio"),
    )


@query(
    "fisher_ratio",
    f"""WITH {SCORED_SQL}, ok AS (SELECT id AS vec_id, label, embedding FROM sc WHERE label = pred),
    {_GEOMETRY_SQL.format(src='ok')} SELECT round(intra / (inter + 1e-6), 5) AS fisher_ratio FROM gg""",
)
def q_fisher(spark, sf_dir):
    return geometry.fisher_ratio(scored_rows(spark, sf_dir), "embedding").select(
        r6("fisher_ratio", 5).alias("fisher_ratio")
    )


# --- detection --------------------------------------------------------------------------------------


@query(
    "binary_report",
    """
    WITH b AS (SELECT toxic AS y, 1 - quality AS p FROM labels),
    c AS (SELECT count(*) FILTER (y = 0 AND p = 0) AS tn, count(*) FILTER (y = 0 AND p = 1) AS fp,
                 count(*) FILTER (y = 1 AND p = 0) AS fn, count(*) FILTER (y = 1 AND p = 1) AS tp FROM b)
    SELECT tn, fp, fn, tp, round(tp / (tp + fp)::DOUBLE, 6) AS ood_precision, round(tp / (tp + fn)::DOUBLE, 6) AS ood_recall,
      round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS ood_f1, round(fn / (tp + fn)::DOUBLE, 6) AS ood_fnr,
      round(fp / (fp + tn)::DOUBLE, 6) AS known_false_rejection_rate,
      round((tp / (tp + fn)::DOUBLE + tn / (tn + fp)::DOUBLE) / 2, 6) AS balanced_accuracy,
      round((tp * tn - fp * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS binary_mcc
    FROM c""",
)
def q_binary(spark, sf_dir):
    df = table(spark, sf_dir, "labels").withColumn("pred", 1 - F.col("quality"))
    r = det.binary_report(df, "toxic", "pred")
    counts = ("tn", "fp", "fn", "tp")
    return r.select(*counts, *[r6(c).alias(c) for c in r.columns if c not in counts])


def event_scores(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        (F.col("event_type") == "error").cast("int").alias("truth"), F.col("value").alias("score")
    )


_RANKED_SQL = """
sv AS (SELECT value AS score, count(*) FILTER (event_type = 'error') AS pos, count(*) FILTER (event_type <> 'error') AS neg
       FROM events GROUP BY 1),
rk AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS np, sum(neg) OVER () AS nn,
              row_number() OVER w AS point_no, count(*) OVER () AS points
       FROM sv WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
"""


@query(
    "ranking_metrics",
    f"""WITH {_RANKED_SQL}
    SELECT round(sum(neg * (tp - pos / 2.0::DOUBLE)) / (max(np)::DOUBLE * max(nn)), 6) AS auroc,
      round(sum(pos * tp / (tp + fp)::DOUBLE) / max(np), 6) AS average_precision,
      round(min(fp / nn::DOUBLE) FILTER (tp / np::DOUBLE >= 0.95::DOUBLE), 6) AS fpr_at_tpr FROM rk""",
)
def q_ranking(spark, sf_dir):
    points = det.roc_points(event_scores(spark, sf_dir), "truth", "score")
    m = det.ranking_metrics(points)
    return m.select(*[r6(c).alias(c) for c in m.columns])


@query(
    "roc_points",
    f"""WITH {_RANKED_SQL} SELECT score AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp FROM rk""",
)
def q_roc_points(spark, sf_dir):
    return det.roc_points(event_scores(spark, sf_dir), "truth", "score").select("threshold", "tp", "fp")


@query(
    "roc_curve",
    f"""WITH {_RANKED_SQL},
    al AS (SELECT point_no, fp / nn::DOUBLE AS fpr, tp / np::DOUBLE AS tpr, score AS threshold, points FROM rk
           UNION ALL SELECT 0, 0, 0, NULL, (SELECT count(*) FROM sv)),
    pick AS (SELECT DISTINCT CAST(floor(i * ((SELECT count(*) FROM sv)::DOUBLE / 499)) AS BIGINT) AS point_no
             FROM range(0, 499) t(i) UNION SELECT count(*) FROM sv)
    SELECT point_no, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr, threshold FROM al SEMI JOIN pick USING (point_no)""",
)
def q_roc_curve(spark, sf_dir):
    points = det.roc_points(event_scores(spark, sf_dir), "truth", "score")
    curve = det.roc_curve(points, 500)
    return curve.select("point_no", r6("fpr").alias("fpr"), r6("tpr").alias("tpr"), "threshold")


@query(
    "unknown_breakdown",
    """
    SELECT event_type, count(*) AS support, count(*) FILTER (value >= 100) AS detected_as_ood,
      round(avg((value >= 100)::INTEGER), 6) AS ood_recall, round(avg(value), 6) AS score_mean,
      round(median(value), 6) AS score_median, min(value) AS score_min, max(value) AS score_max
    FROM events GROUP BY 1""",
)
def q_breakdown(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("rejected", F.col("value") >= 100)
    b = det.unknown_breakdown(df, "event_type", "value")
    return b.select(
        "event_type", "support", "detected_as_ood", r6("ood_recall").alias("ood_recall"),
        r6("score_mean").alias("score_mean"), r6("score_median").alias("score_median"), "score_min", "score_max",
    )


@query(
    "subtype_lookup",
    """
    SELECT d.source AS attack_subtype, count(*) AS support, count(*) FILTER (toxic = 1) AS detected
    FROM labels l JOIN documents d USING (doc_id) GROUP BY 1""",
)
def q_subtypes(spark, sf_dir):
    scored = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "session_id")
    sessions = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("session_id"), F.col("source").alias("attack_subtype")
    )
    joined = det.attach_subtypes(scored, sessions)
    return joined.groupBy("attack_subtype").agg(
        F.count(F.lit(1)).alias("support"), F.count_if(F.col("toxic") == 1).alias("detected")
    )


# --- sampling ---------------------------------------------------------------------------------------


@query(
    "balanced_sample",
    """
    WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY sha256('42|' || vec_id), vec_id) AS rn
               FROM embeddings WHERE label < 8)
    SELECT vec_id, label, CAST((rn - 1) * 8 + label AS INTEGER) AS sample_index FROM r WHERE rn <= 32""",
)
def q_balanced(spark, sf_dir):
    return sampling.balanced_sample(
        table(spark, sf_dir, "embeddings"), "label", list(range(8)), 32, "vec_id"
    ).select("vec_id", "label", "sample_index")


@query(
    "quota_cap",
    """
    WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn,
                 300 // (SELECT count(DISTINCT label) FROM embeddings) AS quota FROM embeddings),
    o AS (SELECT *, row_number() OVER (ORDER BY rn > quota, CASE WHEN rn <= quota THEN label END, vec_id) AS place FROM r)
    SELECT vec_id, label FROM o WHERE place <= 300""",
)
def q_quota(spark, sf_dir):
    return sampling.quota_cap(table(spark, sf_dir, "embeddings"), "label", ["vec_id"], 300).select("vec_id", "label")


@query(
    "stratified_batches",
    """
    WITH n AS (SELECT count(*) AS rows, count(DISTINCT label) AS classes FROM embeddings),
    b AS (SELECT unnest(range(0, CAST(ceil(rows / 32.0) AS BIGINT))) AS batch, rows, classes FROM n)
    SELECT batch, least(32, rows - batch * 32) AS size FROM b""",
)
def q_batches(spark, sf_dir):
    """Batch sizes; that each batch holds every remaining class is checked in the tests."""
    out = sampling.assign_batches(table(spark, sf_dir, "embeddings"), "label", 32, "vec_id")
    return out.groupBy("batch").agg(F.count(F.lit(1)).alias("size"))


@query(
    "batch_class_cover",
    """
    WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1),
    b AS (SELECT CAST(ceil(count(*) / 32.0) AS BIGINT) AS batches FROM embeddings)
    SELECT label, least(n, batches - 1) AS full_batches_with_class, n AS rows FROM c, b""",
)
def q_batch_cover(spark, sf_dir):
    """In how many full batches each class occurs: all of them, or one per row for a rare class."""
    out = sampling.assign_batches(table(spark, sf_dir, "embeddings"), "label", 32, "vec_id")
    last = out.agg(F.max("batch").alias("last"))
    cells = out.groupBy("label", "batch").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(last))
    return cells.groupBy("label").agg(
        F.count_if(F.col("batch") < F.col("last")).alias("full_batches_with_class"), F.sum("n").alias("rows")
    )


# --- runs -------------------------------------------------------------------------------------------


@query(
    "best_epoch",
    """
    SELECT o_orderkey, (o_custkey % 100) / 100.0::DOUBLE AS mcc, o_totalprice AS loss FROM orders
    ORDER BY o_custkey % 100 DESC, o_totalprice LIMIT 1""",
)
def q_best_epoch(spark, sf_dir):
    history = table(spark, sf_dir, "orders").select(
        "o_orderkey", ((F.col("o_custkey") % 100) / F.lit(100.0)).alias("mcc"), F.col("o_totalprice").alias("loss")
    )
    return runs.pick_best(history)


def order_runs(spark, sf_dir) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "OK").when(
        F.col("o_orderstatus") == "O", "SKIPPED_ALREADY_COMPLETE"
    ).otherwise("ERROR")
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("run"),
        status.alias("status"),
        F.when(c % 50 > 0, (c % 7) / F.lit(7.0)).alias("binary_mcc"),
        ((c % 11) / F.lit(11.0)).alias("balanced_accuracy"),
        ((k % 13) / F.lit(13.0)).alias("ood_auroc"),
        ((k % 17) / F.lit(17.0)).alias("ood_recall"),
        F.col("o_totalprice").alias("known_frr"),
    )


_RUNS_SQL = """
ru AS (
  SELECT o_orderkey AS run, CASE o_orderstatus WHEN 'F' THEN 'OK' WHEN 'O' THEN 'SKIPPED_ALREADY_COMPLETE' ELSE 'ERROR' END AS status,
    CASE WHEN o_custkey % 50 > 0 THEN (o_custkey % 7) / 7.0::DOUBLE END AS binary_mcc, (o_custkey % 11) / 11.0::DOUBLE AS balanced_accuracy,
    (o_orderkey % 13) / 13.0::DOUBLE AS ood_auroc, (o_orderkey % 17) / 17.0::DOUBLE AS ood_recall, o_totalprice AS known_frr
  FROM orders)
"""


@query(
    "run_ranking",
    f"""WITH {_RUNS_SQL} SELECT * FROM ru WHERE status <> 'ERROR' ORDER BY binary_mcc DESC NULLS LAST,
        balanced_accuracy DESC, ood_auroc DESC, ood_recall DESC, known_frr, run""",
)
def q_ranking_runs(spark, sf_dir):
    return runs.rank_runs(order_runs(spark, sf_dir))


@query(
    "sweep_status",
    f"""WITH {_RUNS_SQL} SELECT count(*) AS total_runs, count(*) FILTER (status = 'OK') AS ok_count,
        count(*) FILTER (status LIKE 'SKIPPED%') AS skipped_count, count(*) FILTER (status = 'ERROR') AS error_count,
        CASE WHEN count(*) FILTER (status = 'ERROR') > 0 THEN 'COMPLETED_WITH_ERRORS' ELSE 'COMPLETED_OK' END AS status FROM ru""",
)
def q_sweep_status(spark, sf_dir):
    return runs.sweep_status(order_runs(spark, sf_dir))


@query(
    "pending_lambdas",
    f"""WITH {_RUNS_SQL}, c AS (SELECT DISTINCT round(c_custkey / 4.0::DOUBLE, 2) AS "lambda" FROM customer)
    SELECT "lambda" FROM c WHERE NOT EXISTS (SELECT 1 FROM ru WHERE status = 'OK' AND run / 4.0::DOUBLE = "lambda")""",
)
def q_pending_lambdas(spark, sf_dir):
    candidates = table(spark, sf_dir, "customer").select(F.round(F.col("c_custkey") / 4.0, 2).alias("lambda")).distinct()
    done = order_runs(spark, sf_dir).withColumn("lambda", F.col("run") / 4.0)
    return runs.pending_lambdas(candidates, done)
