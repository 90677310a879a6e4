import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from netsieve.operators import detection as det
from netsieve.operators.ordered import broadcast_if_small, group_medians, running_totals, small_rows, split_points


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(0)
    # One group holds most rows, and one value a third of them.
    v = np.where(rng.random(5000) < 0.33, 7.25, np.round(rng.normal(size=5000) ** 3, 3))
    return pd.DataFrame({"g": np.where(rng.random(5000) < 0.8, 0, rng.integers(1, 5, 5000)), "v": v, "y": rng.integers(0, 2, 5000)})


@pytest.mark.parametrize("small", [0, 100_000])
def test_medians(spark, values, small, monkeypatch):
    monkeypatch.setattr("netsieve.operators.ordered.SMALL_SIDE_ROWS", small)  # by buckets, and in one aggregate
    nulls = spark.createDataFrame([(g, None, 0) for g in (0, 0, 1, 9)], "g long, v double, y long")
    got = {r.g: r for r in group_medians(spark.createDataFrame(values).unionByName(nulls), ["g"], "v").collect()}
    assert 9 not in got  # nulls only
    for g, part in values.groupby("g"):
        ordered = np.sort(part.v.values)
        assert got[g].n == len(part)
        assert got[g].lower_median == ordered[(len(part) - 1) // 2]
        assert got[g].median == np.median(part.v.values)


@pytest.mark.parametrize("points", [None, [], [0.0], [-1.0, 0.0, 7.25]])
def test_running_totals(spark, values, points):
    counts = spark.createDataFrame(values).groupBy("g", "v").agg(F.count("*").alias("c"))
    got = {(r.g, r.v): (r.cum_c, r.total_c) for r in running_totals(counts, "v", ["c"], ["g"], points).collect()}
    for g, part in values.groupby("g"):
        running = part.v.value_counts().sort_index().cumsum()
        assert {v: int(c) for v, c in running.items()} == {v: c for (h, v), (c, _) in got.items() if h == g}
        assert {t for (h, _), (_, t) in got.items() if h == g} == {len(part)}


def test_ranking_against_brute_force(spark, values):
    df = spark.createDataFrame(values)
    points = det.roc_points(df, "y", "v")
    m = det.ranking_metrics(points).first()
    pos, neg = values.v[values.y == 1].values, values.v[values.y == 0].values
    wins = (pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean()
    assert m.auroc == pytest.approx(wins)
    steps = [(t, (pos >= t).sum(), (neg >= t).sum()) for t in sorted(set(values.v), reverse=True)]
    before, precision = 0, 0.0
    for _, tp, fp in steps:
        precision += (tp - before) * tp / (tp + fp)
        before = tp
    assert m.average_precision == pytest.approx(precision / len(pos))
    assert m.fpr_at_tpr == pytest.approx(min(fp / len(neg) for _, tp, fp in steps if tp / len(pos) >= 0.95))
    curve = det.roc_curve(points, 100).orderBy("point_no").collect()
    assert len(curve) == 100 and curve[0].threshold is None and (curve[-1].fpr, curve[-1].tpr) == (1.0, 1.0)


def test_split_points_share_rows(spark):
    df = spark.range(10_000).withColumn("v", F.col("id").cast("double"))
    points = split_points(df, "v", 4)
    assert len(points) == 3 and all(abs(p - q) < 800 for p, q in zip(points, (2500, 5000, 7500)))


def test_broadcast_needs_a_size_check(spark):
    df = spark.range(100)
    assert small_rows(df, 99) is None and small_rows(df, 100).count() == 100
    assert broadcast_if_small(df, 10) is df
