"""Queries over embeddings: moments, projection, quantiles, class profiles and the shield."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from netsieve.catalog.base import (
    DAY_S,
    DAY_US,
    KNOWN,
    PACKETS_SQL,
    SCORED_SQL,
    SESSION_ROWS_SQL,
    UNKNOWN,
    query,
    r6,
    scored_rows,
    sessions_sql,
    table,
)
from netsieve.catalog.ingestion import CAPTURED_SQL, cut_events, event_sessions
from netsieve.functions.gaussian import (
    CENTRAL_DEN,
    CENTRAL_NUM,
    EDGE,
    MIDDLE_DEN,
    MIDDLE_NUM,
    TAIL_DEN,
    TAIL_NUM,
)
from netsieve.functions.labels import long_enough
from netsieve.functions.scoring import legacy_rejected, shielded_prediction
from netsieve.operators import detection as det
from netsieve.operators.classification import known_degradation
from netsieve.operators.inference import score
from netsieve.operators.mahalanobis import (
    Calibration,
    Profiles,
    assigned_distance,
    calibrate,
    fit_profiles,
    nearest_class,
    sweep_by_class,
    sweep_lambda,
    thresholds_for,
)
from netsieve.operators.moments import mean_cov
from netsieve.operators.pca import fit_pca, project
from netsieve.operators.quantiles import fit_quantiles, gaussianise, landmarks
from netsieve.operators.sessions import build_sessions
from netsieve.operators.tensors import to_scaled_image
from netsieve.plans.closed_set import evaluate_closed_set
from netsieve.plans.open_set import (
    OpenSetResult,
    ShieldSettings,
    calibrate_shield,
    decide,
    evaluate_open_set,
    fit_shield,
    lambda_grid,
    measure,
    with_truth,
)
from netsieve.plans.report import metric_document
from netsieve.session import scratch_path, stage_table
from netsieve.sources.results import read_results, write_documents
from netsieve.sources.shields import load_shield, save_shield

LAMBDAS = (1.0, 1.25, 2.0, 4.5)
LAM = 1.25
CLASSES = sorted(KNOWN.values())


# --- moments, projection, quantiles -----------------------------------------------------------------


@query(
    "mean_covariance",
    """
    WITH d AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
    SELECT CAST(a.i - 1 AS INTEGER) AS i, CAST(b.i - 1 AS INTEGER) AS j, round(avg(a.x), 6) AS mean_i,
      round(covar_samp(a.x, b.x), 6) AS covariance
    FROM d a JOIN d b USING (vec_id) GROUP BY a.i, b.i""",
)
def q_mean_covariance(spark, sf_dir):
    m = mean_cov(table(spark, sf_dir, "embeddings"), "embedding")
    dim = len(m.mean)
    rows = [(i, j, float(m.mean[i]), float(m.covariance[i, j])) for i in range(dim) for j in range(dim)]
    df = spark.createDataFrame(rows, "i int, j int, mean_i double, covariance double")
    return df.select("i", "j", r6("mean_i").alias("mean_i"), r6("covariance").alias("covariance"))


@query(
    "pca_spectrum",
    """
    WITH d AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    c AS (SELECT a.i AS i, b.i AS j, covar_samp(a.x, b.x) AS v FROM d a JOIN d b USING (vec_id) GROUP BY a.i, b.i)
    SELECT CAST(max(i) AS INTEGER) AS components, round(sum(v) FILTER (i = j), 6) AS total_variance,
      round(sum(v * v), 6) AS squared_variance FROM c""",
)
def q_pca_spectrum(spark, sf_dir):
    """Eigenvalues sum to the covariance trace, their squares to its squared norm."""
    pca = fit_pca(table(spark, sf_dir, "embeddings"), "embedding", variance=1.0)
    values = pca.eigenvalues
    row = (len(values), float(values.sum()), float((values**2).sum()))
    df = spark.createDataFrame([row], "components int, total_variance double, squared_variance double")
    return df.select("components", r6("total_variance").alias("total_variance"), r6("squared_variance").alias("squared_variance"))


@query(
    "pca_projection",
    """
    WITH d AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    c AS (SELECT vec_id, label, x - avg(x) OVER (PARTITION BY i) AS x FROM d)
    SELECT label, count(DISTINCT vec_id) AS n, round(sum(x * x), 1) AS squared_length FROM c GROUP BY label""",
)
def q_pca_projection(spark, sf_dir):
    """A full set of components keeps lengths."""
    e = table(spark, sf_dir, "embeddings")
    z = e.select("label", project("embedding", fit_pca(e, "embedding", k=64)).alias("z"))
    length = F.aggregate("z", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return z.groupBy("label").agg(F.count(F.lit(1)).alias("n"), r6(F.sum(length), 1).alias("squared_length"))


_QUANTILES = 101
_MARKS_SQL = f"""
d AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
g AS (SELECT dim, quantile_cont(x, [{", ".join(str(i / (_QUANTILES - 1)) for i in range(_QUANTILES))}]) AS qs
      FROM d GROUP BY dim),
q AS (SELECT dim, unnest(qs) AS q, generate_subscripts(qs, 1) - 1 AS j FROM g)
"""


@query(
    "quantile_landmarks",
    f"WITH {_MARKS_SQL} SELECT CAST(dim AS INTEGER) AS dim, CAST(j AS INTEGER) AS j, round(q, 6) AS q FROM q",
)
def q_landmarks(spark, sf_dir):
    """As a fit takes them, a row for each number."""
    marks = fit_quantiles(table(spark, sf_dir, "embeddings"), "embedding", "vec_id", _QUANTILES)
    rows = [(dim, j, float(q)) for dim, row in enumerate(marks) for j, q in enumerate(row)]
    return spark.createDataFrame(rows, "dim int, j int, q double").withColumn("q", r6("q"))


@query(
    "quantile_landmarks_exact",
    f"WITH {_MARKS_SQL} SELECT CAST(dim AS INTEGER) AS dim, CAST(j AS INTEGER) AS j, round(q, 6) AS q FROM q",
)
def q_landmarks_exact(spark, sf_dir):
    """From running totals, exact at any size."""
    marks = landmarks(table(spark, sf_dir, "embeddings"), "embedding", _QUANTILES)
    return marks.select("dim", F.posexplode("q").alias("j", "q")).withColumn("q", r6("q"))


def _poly(coefficients, x: str) -> str:
    out = f"{coefficients[-1]!r}::DOUBLE"
    for c in reversed(coefficients[:-1]):
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


# The inverse normal of p from q = p - 1/2 and r = sqrt(-ln(min(p, 1 - p))).
_NORMAL_SQL = f"""CASE WHEN abs(q) <= 0.425::DOUBLE
        THEN q * {_poly(CENTRAL_NUM, '(0.180625::DOUBLE - q * q)')} / {_poly(CENTRAL_DEN, '(0.180625::DOUBLE - q * q)')}
        WHEN r <= 5 THEN sign(q) * {_poly(MIDDLE_NUM, '(r - 1.6::DOUBLE)')} / {_poly(MIDDLE_DEN, '(r - 1.6::DOUBLE)')}
        ELSE sign(q) * {_poly(TAIL_NUM, '(r - 5.0::DOUBLE)')} / {_poly(TAIL_DEN, '(r - 5.0::DOUBLE)')} END"""


@query(
    "gaussianised",
    f"""
    WITH {_MARKS_SQL},
    seg AS (SELECT dim, j, q AS lo, lead(q) OVER (PARTITION BY dim ORDER BY j) AS hi FROM q),
    lim AS (SELECT dim, min(q) AS first_q, max(q) AS last_q FROM q GROUP BY dim),
    pos AS (
      SELECT d.vec_id, d.dim, CASE WHEN d.x <= first_q THEN 0.0::DOUBLE WHEN d.x >= last_q THEN 1.0::DOUBLE
          ELSE (s.j + (d.x - s.lo) / (s.hi - s.lo)) / {_QUANTILES - 1}.0::DOUBLE END AS p0
      FROM d JOIN lim USING (dim) LEFT JOIN seg s ON s.dim = d.dim AND d.x >= s.lo AND d.x < s.hi),
    p AS (SELECT vec_id, least(greatest(p0, {EDGE}::DOUBLE), 1 - {EDGE}::DOUBLE) AS p FROM pos),
    a AS (SELECT vec_id, p, p - 0.5::DOUBLE AS q, sqrt(-ln(least(p, 1 - p))) AS r FROM p),
    z AS (SELECT vec_id, {_NORMAL_SQL} AS z FROM a)
    SELECT vec_id, round(sum(CAST(z AS FLOAT)::DOUBLE), 4) AS total, round(max(CAST(z AS FLOAT)::DOUBLE), 4) AS top FROM z GROUP BY vec_id""",
)
def q_gaussianised(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    marks = fit_quantiles(e, "embedding", "vec_id", quantiles=_QUANTILES)
    g = e.select("vec_id", gaussianise("embedding", marks).cast("array<double>").alias("g"))
    total = F.aggregate("g", F.lit(0.0), lambda a, x: a + x)
    return g.select("vec_id", r6(total, 4).alias("total"), r6(F.array_max("g"), 4).alias("top"))


# --- class profiles over all components ------------------------------------------------------------

# The inverse of each ridged covariance by elimination of [matrix | identity], one column a step. The matrices are
# symmetric and positive, so no rows change places.
def _profile_sql(source: str, ridge: str) -> str:
    """Profiles of the training rows of a relation, distances of all its rows, and the calibration of its validation rows."""
    return f"""
tr AS (SELECT id, label AS c, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM {source} WHERE split = 'train_known'),
mu AS (SELECT c, list(m ORDER BY i) AS mu, any_value(n) AS n FROM (SELECT c, i, avg(x) AS m, count(*) AS n FROM tr GROUP BY c, i) GROUP BY c),
cv AS (
  SELECT a.c, a.i, b.i AS j, covar_samp(a.x, b.x) + CASE WHEN a.i = b.i THEN {ridge}::DOUBLE ELSE 0 END AS v
  FROM tr a JOIN tr b ON a.id = b.id GROUP BY a.c, a.i, b.i),
cr AS (SELECT c, i, list(v ORDER BY j) AS r FROM cv GROUP BY c, i),
c0 AS (
  SELECT c, list(list_concat(r, list_transform(range(1, len(r) + 1), lambda j: (j = i)::INTEGER::DOUBLE)) ORDER BY i) AS m, count(*) AS d
  FROM cr GROUP BY c),
el AS (
  WITH RECURSIVE gj AS (
    SELECT c, d, 1 AS k, m FROM c0
    UNION ALL
    SELECT c, d, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN p ELSE list_transform(r, lambda v, j: v - r[k] * p[j]) END)
    FROM (SELECT *, list_transform(m[k], lambda v: v / m[k][k]) AS p FROM gj WHERE k <= d))
  SELECT c, d, m FROM gj WHERE k = d + 1),
pf AS (SELECT c, n, mu, list_transform(m, lambda r: r[d + 1 : 2 * d]) AS inv FROM el JOIN mu USING (c)),
df AS (
  SELECT {source}.*, pf.c, inv, list_transform(embedding, lambda v, i: v::DOUBLE - mu[i]) AS diff FROM {source}, pf),
ds AS (
  SELECT * EXCLUDE (inv, diff), list_sum(list_transform(inv, lambda r, i: diff[i] * list_dot_product(r, diff))) AS d2 FROM df),
nc AS (
  SELECT id, any_value(label) AS label, any_value(pred) AS pred, any_value(split) AS split, any_value(attack_subtype) AS attack_subtype,
    min(d2) AS distance, arg_min(c, d2) AS winner FROM ds GROUP BY id),
ow AS (SELECT id, label, d2 AS own FROM ds WHERE c = label AND split = 'val_known'),
om AS (SELECT label, count(*) AS n, quantile_disc(own, 0.5) AS med FROM ow GROUP BY label),
ca AS (SELECT om.label, any_value(om.n) AS n, any_value(med) AS med, quantile_disc(abs(own - med), 0.5) AS mad
       FROM ow JOIN om ON om.label = ow.label GROUP BY om.label),
lm AS (SELECT unnest([1.0, 1.25, 2.0, 4.5])::DOUBLE AS lam),
ta AS (SELECT lam, label AS c, med + lam * mad AS tau FROM ca, lm)
"""


_PROFILE_SQL = f"{SCORED_SQL}, {_profile_sql('sc', '1e-5')}"


def class_fit(spark, sf_dir) -> tuple[DataFrame, Profiles]:
    rows = scored_rows(spark, sf_dir)
    return rows, fit_profiles(rows.where("split = 'train_known'"), "embedding", "label", CLASSES)


def class_distances(spark, sf_dir) -> tuple[DataFrame, Profiles]:
    rows, profiles = class_fit(spark, sf_dir)
    near = rows.withColumn("near", nearest_class("embedding", profiles))
    return near.select("id", "label", "pred", "split", "attack_subtype", "embedding", "near.distance", "near.winner"), profiles


def class_calibration(spark, sf_dir) -> tuple[DataFrame, dict[int, Calibration]]:
    rows, profiles = class_distances(spark, sf_dir)
    val = rows.where("split = 'val_known'").select("label", assigned_distance("embedding", "label", profiles).alias("own"))
    return rows, calibrate(stage_table(val, "own-distances"), CLASSES, "label", "own")


@query(
    "class_profiles",
    f"""WITH {_PROFILE_SQL} SELECT c AS label, n, CAST(i - 1 AS INTEGER) AS i, round(mu[i], 6) AS centroid, round(inv[i][i], 3) AS diagonal,
        round(list_sum(inv[i]), 3) AS row_sum FROM (SELECT *, unnest(range(1, len(mu) + 1)) AS i FROM pf WHERE c <= 2)""",
)
def q_profiles(spark, sf_dir):
    _, p = class_fit(spark, sf_dir)
    rows = [
        (c, p.counts[c], i, float(p.centroids[c][i]), float(p.inverses[c][i, i]), float(p.inverses[c][i].sum()))
        for c in p.classes
        for i in range(len(p.centroids[c]))
    ]
    df = spark.createDataFrame(rows, "label int, n long, i int, centroid double, diagonal double, row_sum double")
    return df.select("label", "n", "i", r6("centroid").alias("centroid"), *[r6(c, 3).alias(c) for c in ("diagonal", "row_sum")])


@query("nearest_class", f"WITH {_PROFILE_SQL} SELECT id, round(distance, 6) AS distance, winner FROM nc")
def q_nearest(spark, sf_dir):
    rows, _ = class_distances(spark, sf_dir)
    return rows.select("id", r6("distance").alias("distance"), "winner")


@query(
    "assigned_distance",
    f"WITH {_PROFILE_SQL} SELECT id, round(d2, 6) AS distance FROM ds WHERE c = label AND label <= 2",
)
def q_assigned(spark, sf_dir):
    rows, profiles = class_fit(spark, sf_dir)
    known = rows.where("label <= 2")
    return known.select("id", r6(assigned_distance("embedding", "label", profiles)).alias("distance"))


@query(
    "calibration",
    f"WITH {_PROFILE_SQL} SELECT label, n, round(med, 6) AS median, round(mad, 6) AS mad FROM ca",
)
def q_calibration(spark, sf_dir):
    _, cal = class_calibration(spark, sf_dir)
    df = spark.createDataFrame(
        [(c, v.count, v.median, v.mad) for c, v in cal.items()], "label int, n long, median double, mad double"
    )
    return df.select("label", "n", r6("median").alias("median"), r6("mad").alias("mad"))


@query(
    "lambda_thresholds",
    f"""WITH {_PROFILE_SQL} SELECT lam AS "lambda", c AS label, round(tau, 6) AS threshold FROM ta""",
)
def q_thresholds(spark, sf_dir):
    _, cal = class_calibration(spark, sf_dir)
    rows = [(lam, c, t) for lam in LAMBDAS for c, t in thresholds_for(cal, lam).items()]
    return spark.createDataFrame(rows, "lambda double, label int, threshold double").withColumn("threshold", r6("threshold"))


_SWEEP_SQL = f"""
{_PROFILE_SQL},
sw AS (
  SELECT nc.*, lam, distance / tau >= 1 AS rejected FROM nc JOIN ta ON ta.c = nc.winner WHERE split = 'val_known')
"""


@query(
    "sweep_by_class",
    f"""WITH {_SWEEP_SQL}
    SELECT sw.lam AS "lambda", sw.label, count(*) AS total, count(*) FILTER (rejected) AS rejected,
      count(*) FILTER (winner = sw.label) AS correct, round(any_value(tau), 6) AS threshold
    FROM sw JOIN ta ON ta.lam = sw.lam AND ta.c = sw.label GROUP BY 1, 2""",
)
def q_sweep_by_class(spark, sf_dir):
    rows, cal = class_calibration(spark, sf_dir)
    out = sweep_by_class(rows.where("split = 'val_known'"), cal, LAMBDAS)
    return out.withColumn("threshold", r6("threshold"))


@query(
    "lambda_sweep",
    f"""WITH {_SWEEP_SQL}
    SELECT lam AS "lambda", count(*) AS known_total, count(*) FILTER (rejected) AS known_rejected,
      count(*) FILTER (NOT rejected) AS known_accepted, round(avg(rejected::INTEGER), 6) AS global_frr,
      avg(rejected::INTEGER) <= 0.3 AS eligible, round(avg((winner = label)::INTEGER), 6) AS geometric_accuracy,
      round(avg(rejected::INTEGER) FILTER (label = 0), 6) AS frr_benign, round(avg(rejected::INTEGER) FILTER (label = 2), 6) AS frr_ddos
    FROM sw GROUP BY lam""",
)
def q_lambda_sweep(spark, sf_dir):
    rows, cal = class_calibration(spark, sf_dir)
    names = {i: n for n, i in KNOWN.items()}
    out = sweep_lambda(sweep_by_class(rows.where("split = 'val_known'"), cal, LAMBDAS), 0.3, names)
    return out.select(
        "lambda", "known_total", "known_rejected", "known_accepted", r6("global_frr").alias("global_frr"), "eligible",
        r6("geometric_accuracy").alias("geometric_accuracy"),
        r6(F.col("frr_by_class")["Benign"]).alias("frr_benign"), r6(F.col("frr_by_class")["DDoS"]).alias("frr_ddos"),
    )


_TEST_SQL = f"""
{_PROFILE_SQL},
te AS (
  SELECT nc.*, lam, distance / tau AS score, distance / tau >= 1 AS rejected, (split = 'test_ood')::INTEGER AS truth
  FROM nc JOIN ta ON ta.c = nc.winner WHERE split IN ('test_known', 'test_ood'))
"""


def test_rows(rows: DataFrame) -> DataFrame:
    """Distances of the test rows with their binary truth."""
    return with_truth(rows.where("split = 'test_known'"), rows.where("split = 'test_ood'")).drop("embedding")


@query(
    "shield_decisions",
    f"""WITH {_TEST_SQL} SELECT id, round(score, 6) AS score, rejected, CAST(CASE WHEN rejected THEN -1 ELSE pred END AS INTEGER) AS final
        FROM te WHERE lam = {LAM}""",
)
def q_decisions(spark, sf_dir):
    rows, cal = class_calibration(spark, sf_dir)
    out = decide(test_rows(rows), cal, LAM)
    return out.select(
        "id", r6("score").alias("score"), "rejected",
        shielded_prediction(F.col("rejected"), F.col("pred")).cast("int").alias("final"),
    )


@query(
    "legacy_rejection",
    f"""WITH {_PROFILE_SQL} SELECT id, round(d2, 6) AS distance, coalesce(d2 > tau, false) AS rejected
        FROM ds LEFT JOIN (SELECT * FROM ta WHERE lam = {LAM} AND c <> 2) t ON t.c = ds.pred WHERE ds.c = pred""",
)
def q_legacy(spark, sf_dir):
    """Class 2 is left uncalibrated, so it never rejects."""
    rows, profiles = class_fit(spark, sf_dir)
    val = rows.where("split = 'val_known'").select("label", assigned_distance("embedding", "label", profiles).alias("own"))
    tau = thresholds_for(calibrate(val.where("label <> 2"), [0, 1, 2], "label", "own", skip_empty=True), LAM)
    measured = rows.select("id", "pred", assigned_distance("embedding", "pred", profiles, legacy=True).alias("distance"))
    return measured.select(
        "id", r6("distance").alias("distance"), legacy_rejected(F.col("distance"), F.col("pred"), tau).alias("rejected")
    )


_MCC_SQL = """
(SELECT CASE WHEN (n * n - pp) * (n * n - ss) > 0 THEN (c * n - sp) / sqrt((n * n - pp) * (n * n - ss)) ELSE 0 END FROM (
  SELECT sum(c) AS c, sum(s) AS n, sum(s * p) AS sp, sum(p * p) AS pp, sum(s * s) AS ss FROM (
    SELECT k, count(*) FILTER (label = k)::DOUBLE AS s, count(*) FILTER ({p} = k)::DOUBLE AS p,
      count(*) FILTER (label = k AND {p} = k)::DOUBLE AS c
    FROM kn, (SELECT unnest([-1, 0, 1, 2]) AS k) WHERE kn.lam = {lam} GROUP BY k)))
"""


def _degradation_sql(lam: str) -> str:
    after = "CASE WHEN rejected THEN -1 ELSE pred END"
    return f"""
      count(*) AS known_total, count(*) FILTER (rejected) AS known_rejected,
      round(avg((pred = winner)::INTEGER), 6) AS geometry_agreement, round(avg((label = winner)::INTEGER), 6) AS geometric_accuracy,
      round({_MCC_SQL.format(p='pred', lam=lam)}, 6) AS mcc_before_shield, round({_MCC_SQL.format(p=after, lam=lam)}, 6) AS mcc_after_shield"""


def _rounded(df: DataFrame, plain: tuple[str, ...]) -> DataFrame:
    return df.select(*[F.col(c) if c in plain else r6(c).alias(c) for c in df.columns])


@query(
    "known_degradation",
    f"""WITH {_TEST_SQL}, kn AS (SELECT * FROM te WHERE truth = 0) SELECT {_degradation_sql(str(LAM))} FROM kn WHERE lam = {LAM}""",
)
def q_degradation(spark, sf_dir):
    rows, cal = class_calibration(spark, sf_dir)
    out = known_degradation(decide(test_rows(rows), cal, LAM).where("truth = 0")).drop("mcc_delta")
    return _rounded(out, ("known_total", "known_rejected"))


@query(
    "shield_unknown_breakdown",
    f"""WITH {_TEST_SQL}
    SELECT attack_subtype, count(*) AS support, count(*) FILTER (rejected) AS detected_as_ood,
      round(avg(rejected::INTEGER), 6) AS ood_recall, round(avg(score), 6) AS score_mean, round(median(score), 6) AS score_median,
      round(min(score), 6) AS score_min, round(max(score), 6) AS score_max
    FROM te WHERE truth = 1 AND lam = {LAM} GROUP BY 1""",
)
def q_unknown_breakdown(spark, sf_dir):
    rows, cal = class_calibration(spark, sf_dir)
    unknown = decide(test_rows(rows), cal, LAM).where("truth = 1")
    out = det.unknown_breakdown(unknown, "attack_subtype")
    return _rounded(out, ("attack_subtype", "support", "detected_as_ood"))


@query(
    "lambda_grid",
    f"""WITH {_TEST_SQL}, kn AS (SELECT * FROM te WHERE truth = 0),
    bi AS (SELECT lam, count(*) FILTER (truth = 0 AND NOT rejected) AS tn, count(*) FILTER (truth = 0 AND rejected) AS fp,
             count(*) FILTER (truth = 1 AND NOT rejected) AS fn, count(*) FILTER (truth = 1 AND rejected) AS tp FROM te GROUP BY lam),
    au AS (SELECT a.lam, avg(CASE WHEN a.score > b.score THEN 1.0::DOUBLE WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS auroc
           FROM te a JOIN te b ON a.lam = b.lam AND a.truth = 1 AND b.truth = 0 GROUP BY 1),
    kd AS (
      {" UNION ALL ".join(f"SELECT {lam}::DOUBLE AS lam, {_degradation_sql(str(lam))} FROM kn WHERE lam = {lam}" for lam in LAMBDAS)})
    SELECT bi.lam AS "lambda", tn, fp, fn, tp, round(tp / (tp + fn)::DOUBLE, 6) AS ood_recall,
      round((tp / (tp + fn)::DOUBLE + tn / (tn + fp)::DOUBLE) / 2, 6) AS balanced_accuracy, round(auroc, 6) AS auroc,
      known_total, known_rejected, geometry_agreement, geometric_accuracy, mcc_before_shield, mcc_after_shield
    FROM bi JOIN au USING (lam) JOIN kd USING (lam)""",
)
def q_lambda_grid(spark, sf_dir):
    rows, cal = class_calibration(spark, sf_dir)
    out = lambda_grid(stage_table(test_rows(rows), "test-distances"), cal, LAMBDAS).select(
        "lambda", "tn", "fp", "fn", "tp", "ood_recall", "balanced_accuracy", "auroc", "known_total", "known_rejected",
        "geometry_agreement", "geometric_accuracy", "mcc_before_shield", "mcc_after_shield",
    )
    return _rounded(out, ("lambda", "tn", "fp", "fn", "tp", "known_total", "known_rejected"))


# The whole shield. Components come from cyclic Jacobi sweeps over the covariance: a step turns all pairs of a round robin at
# once, so d - 1 steps meet every pair once, and ten sweeps leave nothing beside the diagonal. Index k turns with pa[k] by the
# angle an[k], co and si being its cosine and signed sine.
_OPEN_VARIANCE, _OPEN_QUANTILES, _OPEN_RIDGE, _SWEEPS = 0.9, 1000, "1e-2", 10
_DIAGONAL_GAP = "a[greatest(k, p)][greatest(k, p)] - a[least(k, p)][least(k, p)]"
_SPACE_SQL = f"""
px AS (SELECT id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM sc WHERE split = 'train_known'),
pm AS (SELECT list(m ORDER BY i) AS mean FROM (SELECT i, avg(x) AS m FROM px GROUP BY i)),
pv AS (SELECT a.i, b.i AS j, covar_samp(a.x, b.x) AS v FROM px a JOIN px b USING (id) GROUP BY a.i, b.i),
pr AS (SELECT i, list(v ORDER BY j) AS r, list((j = i)::INTEGER::DOUBLE ORDER BY j) AS e FROM pv GROUP BY i),
p0 AS (SELECT list(r ORDER BY i) AS a, list(e ORDER BY i) AS v, count(*)::INTEGER AS d FROM pr),
jl AS (
  WITH RECURSIVE ja AS (
    SELECT 0 AS t, d, a, v FROM p0
    UNION ALL
    SELECT t + 1, d,
      list_transform(list_transform(a, lambda r, k: list_transform(r, lambda x, j: co[k] * x + si[k] * a[pa[k]][j])),
                     lambda r: list_transform(r, lambda x, j: co[j] * x + si[j] * r[pa[j]])),
      list_transform(v, lambda r: list_transform(r, lambda x, j: co[j] * x + si[j] * r[pa[j]]))
    FROM (
      SELECT *, list_transform(an, lambda g: cos(g)) AS co, list_transform(an, lambda g, k: CASE WHEN k < pa[k] THEN -sin(g) ELSE sin(g) END) AS si
      FROM (
        SELECT *, list_transform(pa, lambda p, k: CASE WHEN a[k][p] = 0 THEN 0.0::DOUBLE
            ELSE atan2(CASE WHEN {_DIAGONAL_GAP} < 0 THEN -2 ELSE 2 END * a[k][p], abs({_DIAGONAL_GAP})) / 2 END) AS an
        FROM (
          SELECT *, list_transform(range(0, d), lambda k: CASE WHEN k = d - 1 THEN t % (d - 1) WHEN k = t % (d - 1) THEN d - 1
              ELSE (2 * (t % (d - 1)) - k + d - 1) % (d - 1) END::INTEGER + 1) AS pa
          FROM ja WHERE t < {_SWEEPS} * (d - 1)))))
  SELECT a, v, d FROM ja ORDER BY t DESC LIMIT 1),
ev AS (SELECT k, greatest(a[k][k], 0) AS val, list_transform(v, lambda r: r[k]) AS vec FROM (SELECT *, unnest(range(1, d + 1)) AS k FROM jl)),
es AS (
  SELECT *, sum(val) OVER () AS total, coalesce(sum(val) OVER (ORDER BY val DESC, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    list_transform(vec, lambda x: abs(x)) AS size FROM ev),
cm AS (
  SELECT list(list_transform(vec, lambda x: x * sign(vec[list_position(size, list_max(size))])) ORDER BY val DESC, k) AS comps
  FROM es WHERE before / total < {_OPEN_VARIANCE}::DOUBLE),
zz AS (
  SELECT * EXCLUDE (embedding, mean, comps),
    list_transform(comps, lambda c: list_dot_product(list_transform(embedding, lambda x, i: x::DOUBLE - mean[i]), c)::FLOAT::DOUBLE) AS z
  FROM sc, pm, cm),
zv AS (SELECT id, split, unnest(z) AS x, generate_subscripts(z, 1) AS dim FROM zz),
zs AS (SELECT dim, list(x ORDER BY x) AS xs, count(*) - 1 AS top, least({_OPEN_QUANTILES}, count(*)) - 1 AS steps FROM zv WHERE split = 'train_known' GROUP BY dim),
mk AS (
  SELECT dim, steps, list_transform(range(0, steps + 1), lambda j:
    xs[j * top // steps + 1] + (xs[least(j * top // steps + 2, top + 1)] - xs[j * top // steps + 1]) * ((j * top % steps) / steps::DOUBLE)) AS ms
  FROM zs),
zc AS (
  SELECT id, dim, x, ms, steps, len(list_filter(ms, lambda m: m <= x)) AS upto, len(list_filter(ms, lambda m: m < x)) AS below
  FROM zv JOIN mk USING (dim)),
zp AS (
  SELECT id, dim,
    ((CASE WHEN upto = 0 THEN 0 WHEN upto > steps THEN 1 ELSE (upto - 1 + (x - ms[upto]) / (ms[upto + 1] - ms[upto])) / steps END)
     + (CASE WHEN below = 0 THEN 0 WHEN below > steps THEN 1 ELSE (below - (ms[below + 1] - x) / (ms[below + 1] - ms[below])) / steps END)) / 2 AS p0
  FROM zc),
zq AS (SELECT id, dim, p - 0.5::DOUBLE AS q, sqrt(-ln(least(p, 1 - p))) AS r
       FROM (SELECT id, dim, least(greatest(p0, {EDGE}::DOUBLE), 1 - {EDGE}::DOUBLE) AS p FROM zp)),
zg AS (SELECT id, list(({_NORMAL_SQL})::FLOAT ORDER BY dim) AS embedding FROM zq GROUP BY id),
sg AS (SELECT zz.* EXCLUDE (z), zg.embedding FROM zz JOIN zg USING (id))
"""


_OPEN_SQL = f"""
{SCORED_SQL}, {_SPACE_SQL}, {_profile_sql("sg", _OPEN_RIDGE)},
te AS (
  SELECT nc.*, lam, distance / tau AS score, distance / tau >= 1 AS rejected, (split = 'test_ood')::INTEGER AS truth
  FROM nc JOIN ta ON ta.c = nc.winner WHERE split IN ('test_known', 'test_ood') AND lam = {LAM}),
kn AS (SELECT * FROM te WHERE truth = 0),
bi AS (SELECT count(*) FILTER (truth = 0 AND NOT rejected)::DOUBLE AS tn, count(*) FILTER (truth = 0 AND rejected)::DOUBLE AS fp,
         count(*) FILTER (truth = 1 AND NOT rejected)::DOUBLE AS fn, count(*) FILTER (truth = 1 AND rejected)::DOUBLE AS tp FROM te),
bm AS (
  SELECT tn::BIGINT AS tn, fp::BIGINT AS fp, fn::BIGINT AS fn, tp::BIGINT AS tp,
    round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS ood_precision, round(tp / (tp + fn), 6) AS ood_recall,
    round(2 * tp / (2 * tp + fp + fn), 6) AS ood_f1, round(fn / (tp + fn), 6) AS ood_fnr, round(fp / (fp + tn), 6) AS known_false_rejection_rate,
    round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy,
    round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS binary_mcc FROM bi),
rk AS (
  SELECT pos, neg, sum(pos) OVER (ORDER BY score DESC) AS up, sum(neg) OVER (ORDER BY score DESC) AS fa, sum(pos) OVER () AS np, sum(neg) OVER () AS nn
  FROM (SELECT score, count(*) FILTER (truth = 1) AS pos, count(*) FILTER (truth = 0) AS neg FROM te GROUP BY score)),
ra AS (SELECT round(sum(neg * (up - pos / 2.0::DOUBLE)) / (max(np)::DOUBLE * max(nn)), 6) AS auroc,
         round(sum(pos * up / (up + fa)::DOUBLE) / max(np), 6) AS average_precision,
         round(min(fa / nn::DOUBLE) FILTER (up / np::DOUBLE >= 0.95::DOUBLE), 6) AS fpr_at_tpr FROM rk),
kd AS (SELECT {_degradation_sql(str(LAM))} FROM kn)
"""


def open_set_result(spark, sf_dir) -> OpenSetResult:
    """Components, landmarks, profiles, calibration and judgement over all rows."""
    rows = scored_rows(spark, sf_dir)
    part = {s: rows.where(F.col("split") == s) for s in ("train_known", "val_known", "test_known", "test_ood")}
    settings = ShieldSettings(
        variance=_OPEN_VARIANCE, lambdas=LAMBDAS, selected=LAM, quantiles=_OPEN_QUANTILES, known=KNOWN, unknown=UNKNOWN, epsilon=float(_OPEN_RIDGE)
    )
    return evaluate_open_set(part["train_known"], part["val_known"], part["test_known"], part["test_ood"], settings, subtype="attack_subtype")


@query("open_set_evaluation", f"WITH {_OPEN_SQL} SELECT bm.*, ra.*, kd.* FROM bm, ra, kd")
def q_open_set(spark, sf_dir):
    result = open_set_result(spark, sf_dir)
    # Single rows side by side.
    both = result.binary.join(F.broadcast(result.ranking)).join(F.broadcast(result.degradation)).drop("mcc_delta")
    return _rounded(both, ("tn", "fp", "fn", "tp", "known_total", "known_rejected"))


@query(
    "stored_shield",
    f"""WITH {_OPEN_SQL} SELECT id, winner, rejected, CAST(CASE WHEN rejected THEN -1 ELSE pred END AS INTEGER) AS final FROM te""",
)
def q_stored_shield(spark, sf_dir):
    """Test rows judged by a shield that was fitted, written as a version and read again."""
    rows = scored_rows(spark, sf_dir)
    train, val = (rows.where(F.col("split") == s) for s in ("train_known", "val_known"))
    settings = ShieldSettings(
        variance=_OPEN_VARIANCE, lambdas=LAMBDAS, selected=LAM, quantiles=_OPEN_QUANTILES, known=KNOWN, unknown=UNKNOWN, epsilon=float(_OPEN_RIDGE)
    )
    fitted = fit_shield(train, settings)
    calibrate_shield(fitted, val, settings)
    path = scratch_path(spark, "shields")
    save_shield(fitted, settings, path, train)
    stored = load_shield(spark, path)
    tested = measure(stored.shield, rows.where(F.col("split").isin("test_known", "test_ood")).select("id", "pred", "embedding"))
    judged = decide(tested, stored.shield.calibration, stored.settings.selected)
    return judged.select("id", "winner", "rejected", shielded_prediction(F.col("rejected"), F.col("pred")).cast("int").alias("final"))


@query(
    "metric_document",
    f"""WITH {_OPEN_SQL},
    vr AS (SELECT avg((distance / tau >= 1)::INTEGER) AS frr FROM nc JOIN ta ON ta.c = nc.winner WHERE split = 'val_known' AND lam = {LAM}),
    kc AS (SELECT count(*) AS kept, sum(val) / any_value(total) AS part FROM es WHERE before / total < {_OPEN_VARIANCE}::DOUBLE)
    SELECT 'OK' AS status, kept::INTEGER AS pca_components_real, round(part, 6) AS pca_variance_actual, {LAM}::DOUBLE AS selected_lambda_mad,
      round(frr, 6) AS val_frr, known_false_rejection_rate AS known_frr, ood_recall, ood_precision, ood_f1, auroc AS ood_auroc,
      average_precision AS ood_aupr, binary_mcc, balanced_accuracy, mcc_after_shield, known_rejected::INTEGER AS known_rejected
    FROM vr, kc, bm, ra, kd""",
)
def q_metric_document(spark, sf_dir):
    """The nested document of the evaluation, written as a file and read back into flat columns."""
    path = scratch_path(spark, "documents")
    write_documents(metric_document(open_set_result(spark, sf_dir), "embeddings", "1970-01-01T00:00:00Z"), path)
    flat = read_results(spark, path).drop("result_json_path")
    return _rounded(flat, ("status", "pca_components_real", "selected_lambda_mad", "known_rejected"))


@query(
    "document_breakdown",
    f"""WITH {_OPEN_SQL}
    SELECT attack_subtype, count(*) AS support, count(*) FILTER (rejected) AS detected_as_ood, round(avg(rejected::INTEGER), 6) AS ood_recall
    FROM te WHERE truth = 1 GROUP BY 1""",
)
def q_document_breakdown(spark, sf_dir):
    """Unknown rows by subtype, as the written document holds them."""
    path = scratch_path(spark, "documents")
    write_documents(metric_document(open_set_result(spark, sf_dir), "embeddings", "1970-01-01T00:00:00Z"), path)
    part = "map<string, struct<support:bigint, detected_as_ood:bigint, ood_recall:double>>"
    inside = F.from_json("value", f"struct<metrics:struct<per_ood_subtype:{part}>>")
    rows = spark.read.text(path, wholetext=True).select(F.explode(inside["metrics"]["per_ood_subtype"]).alias("attack_subtype", "x"))
    return rows.select("attack_subtype", "x.support", "x.detected_as_ood", r6("x.ood_recall").alias("ood_recall"))


# --- inference --------------------------------------------------------------------------------------


def channel_model():
    """Stand-in model: the two directional sums against a constant, and the channel means as embedding."""
    import numpy as np

    def run(images):
        sums = images.reshape(len(images), 3, -1).sum(axis=2, dtype=np.float64)
        logits = np.stack([sums[:, 0], sums[:, 1], np.full(len(images), 40.0)], axis=1)
        return logits, sums / images[0].size

    return run


_INFERENCE_SQL = f"""
    {PACKETS_SQL}, {sessions_sql(DAY_US)}, {CAPTURED_SQL},
    n AS (SELECT source_capture, canonical_tuple, session_instance FROM w3 GROUP BY ALL HAVING count(*) >= 7),
    v AS (
      SELECT source_capture, canonical_tuple, session_instance,
        sum(CASE WHEN is_up = first_up THEN 16 * delta_enc::DOUBLE + s ELSE 0 END) / 255.0 AS f,
        sum(CASE WHEN is_up = first_up THEN 0 ELSE 16 * delta_enc::DOUBLE + s END) / 255.0 AS b
      FROM cq JOIN n USING (source_capture, canonical_tuple, session_instance)
      JOIN (SELECT packet_no, sum(('0x' || byte)::INTEGER) AS s FROM bt GROUP BY 1) USING (packet_no)
      WHERE packet_rank <= 7 GROUP BY 1, 2, 3)"""
_PRED_SQL = "CASE WHEN f >= b AND f >= 40 THEN 0 WHEN b >= 40 THEN 1 ELSE 2 END"


@query(
    "batch_inference",
    f"""WITH {_INFERENCE_SQL}
    SELECT source_capture, canonical_tuple, session_instance, {_PRED_SQL} AS pred FROM v""",
)
def q_inference(spark, sf_dir):
    sessions = build_sessions(cut_events(spark, sf_dir, True), timeout_s=DAY_S)
    chosen = sessions.where(long_enough(F.col("captured_packets"))).select(
        "source_capture", "canonical_tuple", "session_instance", "packets"
    )
    bounds = {"min_raw": 0.0, "max_raw": 255.0, "min_entropy": 0.0, "max_entropy": 8.0}
    scored = score(to_scaled_image(chosen, bounds, 7), channel_model, (3, 7, 144))
    return scored.select("source_capture", "canonical_tuple", "session_instance", "pred")


_CLOSED_SPLIT = "train_known"


_CLOSED_SQL = f"""
    WITH {PACKETS_SQL}, {SESSION_ROWS_SQL}, {_INFERENCE_SQL[_INFERENCE_SQL.index(CAPTURED_SQL.strip()[:20]):]},
    lp AS (
      SELECT CASE label WHEN 'Benign' THEN 0 WHEN 'DoS' THEN 1 ELSE 2 END AS label, {_PRED_SQL} AS pred
      FROM v JOIN se USING (source_capture, canonical_tuple, session_instance) WHERE split = '{_CLOSED_SPLIT}'),
    m AS (
      SELECT k, count(*)::DOUBLE AS t, count(*) FILTER (label = k)::DOUBLE AS s, count(*) FILTER (pred = k)::DOUBLE AS p,
        count(*) FILTER (label = k AND pred = k)::DOUBLE AS tp
      FROM lp, (SELECT unnest([0, 1, 2]) AS k) GROUP BY k),
    r AS (SELECT *, CASE WHEN p > 0 THEN tp / p ELSE 0 END AS pr, CASE WHEN s > 0 THEN tp / s ELSE 0 END AS rc FROM m)
    SELECT k AS label, round(pr, 6) AS precision, round(rc, 6) AS recall, round(CASE WHEN s > 0 THEN (s - tp) / s ELSE 0 END, 6) AS fnr,
      round(CASE WHEN t > s THEN (p - tp) / (t - s) ELSE 0 END, 6) AS fpr,
      round(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END, 6) AS f1, s::BIGINT AS support, p::BIGINT AS predicted FROM r"""


@query("closed_set_evaluation", _CLOSED_SQL)
def q_closed_set(spark, sf_dir):
    """Inference over the sessions of one split, counted against the index, and the report by class."""
    sessions = event_sessions(spark, sf_dir, with_packets=True)
    bounds = {"min_raw": 0.0, "max_raw": 255.0, "min_entropy": 0.0, "max_entropy": 8.0}
    report = evaluate_closed_set(sessions, bounds, channel_model, _CLOSED_SPLIT, 7).report
    rates = ("precision", "recall", "fnr", "fpr", "f1")
    return report.select("label", *[r6(c).alias(c) for c in rates], "support", "predicted")
