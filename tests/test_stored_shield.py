import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from netsieve.plans.open_set import ShieldSettings, calibrate_shield, decide, evaluate_open_set, fit_shield, measure
from netsieve.plans.report import metric_document, sweep_document
from netsieve.sources.results import read_results, write_documents
from netsieve.sources.shields import load_shield, save_shield, stored_versions

KNOWN, UNKNOWN = {"a": 0, "b": 1}, {"x": 3, "y": 4}


@pytest.fixture(scope="module")
def parts(spark):
    rng = np.random.default_rng(0)
    centres = {0: np.zeros(6), 1: np.full(6, 3.0), 3: np.full(6, -4.0), 4: np.array([4.0, -4, 4, -4, 4, -4])}

    def rows(classes, n, start):
        out = []
        for k in range(n):
            c = classes[k % len(classes)]
            vector = centres[c] + rng.normal(size=6) * [1, 2, 1, 0.5, 1, 1]
            out.append((f"r{start + k}", c, int(k % 7 == 0), f"s{c}-{k % 2}", [float(np.float32(v)) for v in vector]))
        return spark.createDataFrame(out, "id string, label int, pred int, kind string, embedding array<float>")

    return rows([0, 1], 200, 0), rows([0, 1], 80, 1000), rows([0, 1], 60, 2000), rows([3, 4], 60, 3000)


def settings(**changed):
    return ShieldSettings(variance=0.95, lambdas=(2.0, 5.0), selected=5.0, quantiles=100, known=KNOWN, unknown=UNKNOWN, **changed)


@pytest.fixture(scope="module")
def fitted(parts):
    shield = fit_shield(parts[0], settings())
    calibrate_shield(shield, parts[1], settings())
    return shield


def scores(shield, lam, rows):
    return sorted(map(tuple, decide(measure(shield, rows.select("id", "embedding")), shield.calibration, lam).collect()))


def test_a_loaded_shield_scores_as_the_fitted_one(spark, parts, fitted, tmp_path):
    path = f"{tmp_path}/store"
    assert save_shield(fitted, settings(), path, parts[0]) == 1
    stored = load_shield(spark, path)
    assert stored.settings == settings() and stored.version == 1 and stored.trained_rows == 200
    for a, b in zip((stored.shield.marks, stored.shield.pca.components, stored.shield.pca.mean), (fitted.marks, fitted.pca.components, fitted.pca.mean)):
        assert np.array_equal(a, b)
    assert stored.shield.profiles.counts == fitted.profiles.counts and stored.shield.calibration == fitted.calibration
    assert scores(stored.shield, 5.0, parts[3]) == scores(fitted, 5.0, parts[3])


def test_versions_are_kept_and_the_newest_is_read(spark, parts, fitted, tmp_path):
    path = f"{tmp_path}/store"
    assert stored_versions(spark, path).count() == 0
    with pytest.raises(ValueError, match="no shield"):
        load_shield(spark, path)
    other = ShieldSettings(variance=0.5, lambdas=(3.0,), selected=None, quantiles=20, known=KNOWN, unknown=UNKNOWN)
    assert save_shield(fitted, settings(), path, parts[0]) == 1
    assert save_shield(fit_shield(parts[1], other), other, path, parts[1]) == 2
    assert load_shield(spark, path).settings == other and not load_shield(spark, path).shield.calibration
    first = load_shield(spark, path, 1)
    assert first.settings.selected == 5.0 and scores(first.shield, 5.0, parts[2]) == scores(fitted, 5.0, parts[2])
    with pytest.raises(ValueError, match="version 9"):
        load_shield(spark, path, 9)
    # The fingerprint is that of the rows, in any order; another row gives another.
    again = save_shield(fitted, settings(), path, parts[0].orderBy(F.desc("id")).repartition(3))
    assert load_shield(spark, path, again).trained_on == first.trained_on != load_shield(spark, path, 2).trained_on


def test_a_damaged_version_is_refused(spark, parts, fitted, tmp_path):
    save_shield(fitted, settings(), f"{tmp_path}/whole", parts[0])
    rows = spark.read.parquet(f"{tmp_path}/whole")
    rows.where("NOT (part = 'inverse' AND class = 1 AND place = 0)").write.parquet(f"{tmp_path}/short")
    rows.withColumn("values", F.when(F.col("part") == "mean", F.transform("values", lambda x: x + 1e-9)).otherwise(F.col("values"))).write.parquet(f"{tmp_path}/other")
    rows.withColumn("format", F.lit(99)).write.parquet(f"{tmp_path}/format")
    for name in ("short", "other"):
        with pytest.raises(ValueError, match="not whole"):
            load_shield(spark, f"{tmp_path}/{name}")
    with pytest.raises(ValueError, match="format"):
        load_shield(spark, f"{tmp_path}/format")


def test_document_round_trip(spark, parts, tmp_path):
    result = evaluate_open_set(*parts, settings(), subtype="kind")
    path = f"{tmp_path}/documents"
    counts = {"train_known": 200, "val_known": 80}
    write_documents(metric_document(result, "one", "2020-01-01T00:00:00Z", counts, {"model": "m1"}), path)
    write_documents(metric_document(result, "two", "2020-01-02T00:00:00Z"), path)
    flat = {r.result_json_path.split("run=")[1][:3]: r for r in read_results(spark, path).collect()}
    binary, ranking, cost = (f.first() for f in (result.binary, result.ranking, result.degradation))
    assert set(flat) == {"one", "two"}
    for row in flat.values():
        assert row.status == "OK" and row.pca_components_real == result.shield.pca.k and row.selected_lambda_mad == 5.0
        assert (row.ood_recall, row.ood_f1, row.binary_mcc) == (binary.ood_recall, binary.ood_f1, binary.binary_mcc)
        assert (row.ood_auroc, row.ood_aupr) == (ranking.auroc, ranking.average_precision)
        assert (row.known_rejected, row.mcc_after_shield) == (cost.known_rejected, cost.mcc_after_shield)
    first = json.loads(spark.read.text(f"{path}/run=one", wholetext=True).first()[0])
    assert first["sample_counts"] == counts and first["notes"] == {"model": "m1"} and first["class_to_idx"] == KNOWN
    by_kind = {r.kind: r for r in result.by_subtype.collect()}
    assert {k: v["support"] for k, v in first["metrics"]["per_ood_subtype"].items()} == {k: r.support for k, r in by_kind.items()}
    assert set(first["metrics"]["per_ood_class"]) == set(UNKNOWN)
    assert set(first["calibration_by_class"]) == set(KNOWN)
    assert all(abs(v["threshold"] - v["median"] - 5.0 * v["mad"]) < 1e-12 for v in first["calibration_by_class"].values())
    curve = first["metrics"]["binary_detection"]["roc_curve"]
    assert curve["fpr"][0] == 0 and curve["tpr"][-1] == 1 and len(curve["fpr"]) == len(curve["tpr"])
    # Writing a run again replaces it alone.
    write_documents(metric_document(result, "two", "2020-01-03T00:00:00Z"), path)
    assert read_results(spark, path).count() == 2


def test_sweep_document_and_missing_lambda(spark, parts, tmp_path):
    open_settings = ShieldSettings(variance=0.95, lambdas=(2.0, 5.0), quantiles=100, known=KNOWN, unknown=UNKNOWN)
    result = evaluate_open_set(*parts, open_settings)
    with pytest.raises(ValueError, match="no test metrics"):
        metric_document(result, "one", "now")
    write_documents(sweep_document(result, "sweep", "now"), f"{tmp_path}/sweeps")
    made = json.loads(spark.read.text(f"{tmp_path}/sweeps", wholetext=True).first()[0])
    want = {r["lambda"]: r for r in result.sweep.collect()}
    assert [r["lambda_mad"] for r in made["lambda_results"]] == sorted(want)
    assert all(r["known_rejected"] == want[r["lambda_mad"]].known_rejected for r in made["lambda_results"])
