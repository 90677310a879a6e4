import json

import pytest
from pyspark.sql import functions as F

from netsieve.operators import integrity as it, profile, runs
from netsieve.sources.results import read_results, write_results

DOCUMENT = {
    "osr_configuration": {"pca_components": 257, "selected_lambda_mad": 1.25},
    "metrics": {"binary_detection": {"ood_auroc": 0.8, "ood_recall": float("nan"), "binary_mcc": float("inf")}, "known_degradation": {"known_rejected": 5}},
}


def test_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(DOCUMENT, indent=2))
    (tmp_path / "b.json").write_text("{oops")
    rows = {r.result_json_path[-6:]: r for r in read_results(spark, str(tmp_path / "*.json")).collect()}
    a, b = rows["a.json"], rows["b.json"]
    assert (a.status, a.pca_components_real, a.ood_auroc, a.known_rejected) == ("OK", 257, 0.8, 5)
    assert a.ood_recall is None and a.binary_mcc is None and a.val_frr is None
    assert b.status == "JSON_READ_ERROR" and b.ood_auroc is None


@pytest.mark.parametrize("fmt", ["json", "csv", "markdown"])
def test_sinks(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1.0, {"b": 2.0, "a": 1.0})], "lambda double, frr map<string,double>")
    write_results(df, str(tmp_path / fmt), fmt)
    text = "\n".join(r[0] for r in spark.read.text(str(tmp_path / fmt)).collect())
    if fmt == "json":
        assert json.loads(text) == {"lambda": 1.0, "frr": {"a": 1.0, "b": 2.0}}
    elif fmt == "csv":
        assert text.splitlines()[0] == "lambda,frr" and '{\\"a\\":1.0,\\"b\\":2.0}' in text
    else:
        assert "| lambda | frr |" in text and '| 1.0 | {"a":1.0,"b":2.0} |' in text
    with pytest.raises(ValueError):
        write_results(df, str(tmp_path / "x"), "xml")


def test_best_epoch_breaks_ties_by_loss(spark):
    df = spark.createDataFrame([(1, 0.5, 0.1), (2, 0.9, 0.7), (3, 0.9 - 1e-13, 0.2)], "epoch int, mcc double, loss double")
    assert runs.pick_best(df).first().epoch == 3


def test_ranking_puts_missing_metrics_last(spark):
    rows = [(1, "OK", None, 0.9), (2, "OK", 0.1, 0.9), (3, "ERROR", 0.9, 0.1), (4, "SKIPPED_ALREADY_COMPLETE", 0.1, 0.2)]
    df = spark.createDataFrame(rows, "id int, status string, binary_mcc double, known_frr double")
    for c in ("balanced_accuracy", "ood_auroc", "ood_recall"):
        df = df.withColumn(c, F.lit(0.5))
    assert [r.id for r in runs.rank_runs(df).collect()] == [4, 2, 1]


def test_manifest_and_fingerprint(spark, tmp_path):
    spark.range(100).withColumn("x", F.col("id") * 2).repartition(3).write.parquet(str(tmp_path / "t"))
    m = it.build_manifest(spark, str(tmp_path / "t"))
    assert m.count() == 3 and m.agg(F.sum("row_count")).first()[0] == 100
    again = it.build_manifest(spark, str(tmp_path / "t"))
    same = it.reconcile(m, again, [("sha256", "hash_mismatch"), ("size_bytes", "size_mismatch")])
    assert {r.status for r in same.collect()} == {"ok"}
    a = it.fingerprint(m, ["path", "sha256"]).first()
    assert a == it.fingerprint(again.repartition(5), ["path", "sha256"]).first() and a.rows == 3
    assert a.fingerprint != it.fingerprint(m.limit(2), ["path", "sha256"]).first().fingerprint


def test_bounds_checks(spark):
    df = spark.createDataFrame([(0.0, 256.0)], "lo double, hi double")
    with pytest.raises(Exception, match="bad bounds"):
        profile.check_bounds(df, [("lo", "hi", profile.RAW_RANGE)]).collect()
    assert profile.check_bounds(df, [("lo", "hi", (0.0, 300.0))]).count() == 1


def test_validation_examples_are_capped_but_counts_are_not(spark):
    df = spark.range(1000).select(F.lit("f").alias("file"), "id")
    r = profile.validate_rows(df, F.when(F.col("id") > 10, "big"), "file", "id").first()
    assert (r.invalid, r.examples) == (989, [11, 12, 13, 14, 15])
