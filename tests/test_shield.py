import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from netsieve.functions.gaussian import EDGE, inverse_normal
from netsieve.operators import detection as det
from netsieve.operators.mahalanobis import calibrate, fit_profiles, robust_inverse, thresholds_for
from netsieve.operators.moments import fit_moments
from netsieve.operators.pca import fit_pca, project
from netsieve.operators.quantiles import cdf, fit_quantiles, gaussianise, seeded_sample
from netsieve.plans.open_set import ShieldSettings, evaluate_open_set, lambda_grid

DIM = 6


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(7)
    centres = rng.normal(scale=3, size=(5, DIM))
    frames = []
    for split, classes, n in (("train", (0, 1, 2), 300), ("val", (0, 1, 2), 80), ("known", (0, 1, 2), 60), ("ood", (3, 4), 50)):
        for c in classes:
            x = (centres[c] + rng.normal(size=(n, DIM)) @ np.diag([3, 2, 1, 1, 0.5, 0.1])).astype(np.float32)
            frames.append(pd.DataFrame({"split": split, "label": c, "embedding": list(x), "pred": rng.integers(0, 3, n)}))
    out = pd.concat(frames, ignore_index=True)
    out["id"] = np.arange(len(out))
    return out


@pytest.fixture(scope="module")
def df(spark, table):
    rows = [(int(r.id), r.split, int(r.label), int(r.pred), [float(v) for v in r.embedding]) for r in table.itertuples()]
    return spark.createDataFrame(rows, "id long, split string, label int, pred int, embedding array<float>").repartition(5)


def matrix(table, split):
    part = table[table.split == split]
    return np.stack(part.embedding.values).astype(np.float64), part.label.values, part.pred.values


def test_moments(df, table):
    got = fit_moments(df, "embedding", "label")
    for c, part in table.groupby("label"):
        x = np.stack(part.embedding.values).astype(np.float64)
        assert got[c].n == len(x)
        np.testing.assert_allclose(got[c].mean, x.mean(axis=0), atol=1e-12)
        np.testing.assert_allclose(got[c].covariance, np.cov(x.T), atol=1e-11)
    plain = fit_moments(df, "embedding", "label", {c: np.zeros(DIM) for c in range(5)})
    np.testing.assert_allclose(plain[0].covariance, got[0].covariance, atol=1e-9)


def test_ragged_vectors_are_an_error(spark):
    bad = spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "v array<float>").coalesce(1)
    with pytest.raises(Exception):
        fit_moments(bad, "v")


def numpy_shield(table, variance, quantiles, epsilon):
    x, y, _ = matrix(table, "train")
    values, vectors = np.linalg.eigh(np.cov(x.T))
    values, vectors = values[::-1], vectors[:, ::-1]
    k = int(np.searchsorted(np.cumsum(values) / values.sum(), variance)) + 1
    v = vectors[:, :k]
    v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(k)])
    z = lambda a: ((a - x.mean(axis=0)) @ v).astype(np.float32).astype(np.float64)
    grid = np.linspace(0, 1, min(quantiles, len(x)))
    marks = np.quantile(z(x), grid, axis=0)

    def g(a):
        p = np.stack([np.interp(z(a)[:, d], marks[:, d], grid) for d in range(k)], axis=1)
        return inverse_normal(p).astype(np.float32).astype(np.float64)

    gx = g(x)
    profiles = {c: (gx[y == c].mean(axis=0), np.linalg.inv(np.cov(gx[y == c].T) + epsilon * np.eye(k))) for c in (0, 1, 2)}

    def distances(a):
        return np.stack([np.einsum("ij,jk,ik->i", g(a) - m, s, g(a) - m) for m, s in profiles.values()], axis=1)

    return k, distances


def test_open_set_equals_numpy(spark, df, table):
    part = {s: df.where(F.col("split") == s).drop("split") for s in ("train", "val", "known", "ood")}
    settings = ShieldSettings(variance=0.999, lambdas=(1.0, 2.0, 4.0), selected=2.0, quantiles=200, epsilon=1e-5)
    unknown = part["ood"].withColumn("attack_subtype", F.concat(F.lit("s"), F.col("id") % 3))
    result = evaluate_open_set(part["train"], part["val"], part["known"], unknown, settings, subtype="attack_subtype")

    k, distances = numpy_shield(table, 0.999, 200, 1e-5)
    assert result.shield.pca.k == k
    x, y, _ = matrix(table, "val")
    dv = distances(x)
    lower = lambda a: np.sort(a)[(len(a) - 1) // 2]
    stats = {c: (lower(dv[y == c, c]), lower(np.abs(dv[y == c, c] - lower(dv[y == c, c])))) for c in (0, 1, 2)}
    for c, (median, mad) in stats.items():
        assert result.shield.calibration[c].median == pytest.approx(median, rel=1e-6)
        assert result.shield.calibration[c].mad == pytest.approx(mad, rel=1e-6)
    sweep = {r["lambda"]: r for r in result.sweep.collect()}
    for lam in (1.0, 2.0, 4.0):
        tau = np.array([m + lam * s for m, s in stats.values()])
        rejected = dv.min(axis=1) / tau[dv.argmin(axis=1)] >= 1
        assert sweep[lam].known_rejected == rejected.sum() and sweep[lam].known_total == len(x)
        assert sweep[lam].frr_by_class["DoS"] == pytest.approx(rejected[y == 1].mean())
        assert sweep[lam].geometric_accuracy == pytest.approx((dv.argmin(axis=1) == y).mean())
    tau = np.array([m + 2.0 * s for m, s in stats.values()])
    score, rejects, winners = {}, {}, {}
    for split in ("known", "ood"):
        d = distances(matrix(table, split)[0])
        winners[split] = d.argmin(axis=1)
        score[split] = d.min(axis=1) / tau[winners[split]]
        rejects[split] = score[split] >= 1
    binary = result.binary.first()
    assert (binary.fp, binary.tp) == (rejects["known"].sum(), rejects["ood"].sum())
    pairs = (score["ood"][:, None] > score["known"][None, :]).mean()
    assert result.ranking.first().auroc == pytest.approx(pairs, abs=1e-6)
    _, label, pred = matrix(table, "known")
    cost = result.degradation.first()
    assert cost.known_rejected == rejects["known"].sum()
    assert cost.geometry_agreement == pytest.approx((pred == winners["known"]).mean())
    by_class = {r.label: r for r in result.by_class.collect()}
    ood_label = matrix(table, "ood")[1]
    assert by_class[3].score_median == pytest.approx(np.median(score["ood"][ood_label == 3]), rel=1e-5)
    assert sum(r.support for r in result.by_subtype.collect()) == len(ood_label)
    assert result.frr_exceeded == (not sweep[2.0].eligible)

    measured = result.scored.drop("score", "rejected")
    done = spark.createDataFrame([(1.0, "OK"), (4.0, "ERROR")], "lambda double, status string")
    grid = {r["lambda"]: r for r in lambda_grid(measured, result.shield.calibration, (1.0, 2.0, 4.0), done).collect()}
    assert sorted(grid) == [2.0, 4.0] and grid[2.0].tp == binary.tp
    assert grid[2.0].auroc == pytest.approx(result.ranking.first().auroc)


def test_without_a_selected_lambda_only_the_sweep_runs(df):
    part = {s: df.where(F.col("split") == s) for s in ("train", "val", "known", "ood")}
    result = evaluate_open_set(part["train"], part["val"], part["known"], part["ood"], ShieldSettings(lambdas=(3.0,), quantiles=50))
    assert result.scored is None and result.sweep.count() == 1
    with pytest.raises(ValueError, match="absent"):
        evaluate_open_set(part["train"], part["val"].where("label <> 1"), part["known"], part["ood"], ShieldSettings())


@pytest.mark.parametrize(
    "bad", [dict(variance=0), dict(lambdas=()), dict(lambdas=(-1.0,)), dict(selected=9.9), dict(max_frr=2), dict(quantiles=1), dict(epsilon=0)]
)
def test_settings_are_checked(bad):
    with pytest.raises(ValueError):
        ShieldSettings(**bad)


def test_pca_options(df):
    assert fit_pca(df, "embedding", k=2).k == 2
    pca = fit_pca(df, "embedding", variance=1.0)
    assert pca.retained == pytest.approx(1.0)
    flat = df.select(F.transform("embedding", lambda x: x * 0).alias("e"))
    with pytest.raises(ValueError, match="variance"):
        fit_pca(flat, "e")
    assert df.select(F.size(project("embedding", pca))).first()[0] == DIM


def test_quantiles(df, table):
    marks = fit_quantiles(df, "embedding", "id", quantiles=50)
    x = np.stack(table.embedding.values).astype(np.float64)
    np.testing.assert_allclose(marks.T, np.quantile(x, np.linspace(0, 1, 50), axis=0), atol=1e-12)
    sample = seeded_sample(df, "id", 100, seed=3)
    assert sample.count() == 100 and {r.id for r in sample.collect()} == {r.id for r in seeded_sample(df, "id", 100, seed=3).collect()}
    got = np.array(df.orderBy("id").select(gaussianise("embedding", marks).alias("g")).toPandas().g.tolist())
    assert np.abs(got).max() == pytest.approx(abs(float(inverse_normal(np.array([EDGE]))[0])), rel=1e-6)


def test_distribution_function_is_odd_with_ties():
    marks = np.array([-2.0, -1, -1, 0, 1, 1, 1, 3])
    x = np.linspace(-3, 4, 200)
    np.testing.assert_allclose(cdf(x, marks), 1 - cdf(-x, -marks[::-1]), atol=1e-12)


def test_inverse_normal():
    known = {0.5: 0.0, 0.975: 1.959963984540054, 0.001: -3.090232306167813, 0.9999: 3.719016485455709}
    for p, z in known.items():
        assert float(inverse_normal(np.array([p]))[0]) == pytest.approx(z, abs=1e-12)


def test_robust_inverse():
    good = np.array([[2.0, 0.3], [0.3, 1.0]])
    np.testing.assert_allclose(robust_inverse(good), np.linalg.inv(good + 1e-5 * np.eye(2)), rtol=1e-9)
    bad = np.diag([1.0, -5.0])
    np.testing.assert_allclose(robust_inverse(bad), np.linalg.pinv(bad))


def test_profile_and_calibration_errors(spark, df):
    with pytest.raises(ValueError, match="class 9"):
        fit_profiles(df, "embedding", "label", [0, 9])
    assert fit_profiles(df, "embedding", "label", [0, 9], skip_small=True).classes == [0]
    rows = spark.createDataFrame([(0, 1.0), (0, 2.0), (0, 3.0), (0, 10.0)], "label int, distance double")
    c = calibrate(rows, [0])[0]
    assert (c.count, c.median, c.mad) == (4, 2.0, 1.0)
    with pytest.raises(ValueError, match="no calibration rows"):
        calibrate(rows, [0, 1])
    for lam in (0.0, float("nan")):
        with pytest.raises(ValueError):
            thresholds_for({0: c}, lam)


def test_empty_target_recall_is_null(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0)], "y int, s double")
    assert det.ranking_metrics(det.roc_points(df, "y", "s")).first().fpr_at_tpr is None
