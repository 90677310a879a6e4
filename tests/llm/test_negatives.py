import numpy as np
import pytest
from pyspark.sql import functions as F

from netsieve.llm.negatives import LARGEST, Settings, Windows, angles_to, build_index, fit_references, mine, runs, whole_vectors

KIND = "vec_id long, label int, vector array<double>"
SMALL = Settings(sample_rows=200, references=4, bins=16, part_rows=37, part_anchors=3, first_rows=40, chunk=2)


def plain(rows, is_anchor, n_positives=5, n_negatives=10, scale=256):
    """Every pair, one after the other."""
    whole = [(i, v, label, [int(np.floor(scale * x)) for x in vector]) for i, (v, label, vector) in enumerate(rows)]
    order = lambda r: (-r[0], r[1] is None, r[1] or 0, r[2])
    out = []
    for a, anchor_id, label, vector in whole:
        if anchor_id is None or not is_anchor(anchor_id):
            continue
        scored = [(sum(x * y for x, y in zip(vector, other)), v, i, kind) for i, v, kind, other in whole if i != a]
        positives = sorted((s for s in scored if s[3] == label), key=order)[:n_positives]
        for p in positives:
            fits = [s for s in scored if s[3] != label and 30 * p[0] <= 100 * s[0] <= 90 * p[0]]
            for rank, s in enumerate(sorted(fits, key=order)[:n_negatives], 1):
                out.append((anchor_id, p[1], rank, s[1], p[0], s[0]))
    return sorted(out, key=str)


def made(n, seed=0, spread=0.4, dims=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    return [(i, int(rng.integers(3)), [float(x) for x in centres[rng.integers(6)] + spread * rng.normal(size=dims)]) for i in range(n)]


def found(df, settings=SMALL):
    return sorted((tuple(r) for r in mine(df, F.col("vec_id") % 20 == 0, settings=settings).collect()), key=str)


@pytest.mark.parametrize("spread", [0.05, 1.5])
def test_against_every_pair(spark, spread):
    rows = made(300, spread=spread)
    assert found(spark.createDataFrame(rows, KIND)) == plain(rows, lambda v: v % 20 == 0)


def test_default_settings_and_floats(spark):
    rows = [(v, label, [float(np.float32(x)) for x in vector]) for v, label, vector in made(150, seed=4)]
    df = spark.createDataFrame(rows, "vec_id long, label int, vector array<float>")
    assert found(df, Settings()) == plain(rows, lambda v: v % 20 == 0)


def test_ties_repeats_and_a_hot_vector(spark):
    rows = made(60, seed=2)
    rows += [(1000 + i, i % 2, [0.5] * 8) for i in range(120)]  # one vector in two labels
    rows += [rows[0], rows[0], (rows[0][0], 2, rows[5][2])]  # a repeated anchor, and its id with another vector
    assert found(spark.createDataFrame(rows, KIND)) == plain(rows, lambda v: v % 20 == 0)


def test_odd_rows(spark):
    good = made(50, seed=3) + [(None, 0, [0.3] * 8), (None, 1, [0.3] * 8), (700, 1, [0.0] * 8), (720, 1, [-0.5] * 8)]
    odd = [(20, None, [0.1] * 8), (40, 1, None), (60, 1, [None] + [0.1] * 7), (80, 1, [float("nan")] * 8), (100, 2, [float("-inf")] * 8)]
    odd += [(120, 1, []), (140, 1, [0.5]), (160, 1, [1e300] * 8), (180, 1, [1e12] * 8)]
    df = spark.createDataFrame(good + odd, KIND).withColumn("row", F.lit("clash")).withColumn("score", F.lit(None))
    assert found(df) == plain(good, lambda v: v % 20 == 0)
    assert found(df.limit(0)) == []
    assert found(spark.createDataFrame(odd, KIND)) == []
    alone = spark.createDataFrame([(0, 1, [1.0, 0.0])], KIND)
    assert found(alone) == []


def test_large_integers_stay_exact(spark):
    rng = np.random.default_rng(7)
    rows = [(i, int(i % 2), [float(x) for x in rng.integers(200_000, 300_000, 2) + rng.random(2)]) for i in range(60)]
    big = Settings(references=2, bins=8, part_rows=16, part_anchors=2, first_rows=8)
    df = spark.createDataFrame(rows, KIND)
    assert max(r["norm"] for r in build_index(whole_vectors(df, 256), big)[0].collect()) ** 2 > 2**52
    assert found(df, big) == plain(rows, lambda v: v % 20 == 0)


def test_bounds_hold_every_score():
    rng = np.random.default_rng(1)
    rows = np.floor(40 * rng.normal(size=(400, 6)) * rng.integers(0, 3, (400, 1)))
    references = fit_references(rows, Settings(references=5))
    angles, norms = angles_to(rows, references)
    ends = lambda at: np.stack([angles[at].min(axis=0), angles[at].max(axis=0)], axis=-1)
    cells = [np.flatnonzero(np.argmin(angles, axis=1) == i) for i in range(len(references))]
    windows = Windows(
        references, np.arange(len(cells)), np.arange(len(cells)), np.stack([ends(c) for c in cells]),
        np.array([[norms[c].min(), norms[c].max()] for c in cells]), np.array([len(c) for c in cells]), 1e-6,
    )
    for i in range(0, 400, 7):
        low, high = windows.bounds(angles[i], norms[i])
        for c, least, most in zip(cells, low, high):
            scores = rows[c] @ rows[i]
            assert least <= scores.min() and scores.max() <= most


def test_runs_hold_every_row_in_range():
    rng = np.random.default_rng(2)
    rows = np.floor(60 * (rng.normal(size=(300, 3)) * 0.3 + [1, 0, 0]))
    angles, norms = angles_to(rows, np.array([[1.0, 0, 0]]))
    order = np.argsort(angles[:, 0])
    rows, homes, norms = rows[order], angles[order, 0], norms[order]
    low, high = rng.integers(-200, 4000, 300).astype(float), rng.integers(0, 6000, 300).astype(float)
    starts, stops = runs(homes, (norms.min(), norms.max()), homes, norms, low, high, 1e-6)
    skipped = 0
    for i in range(300):
        scores = rows @ rows[i]
        inside = np.flatnonzero((scores >= low[i]) & (scores <= high[i]))
        assert not len(inside) or (starts[i] <= inside.min() and inside.max() < stops[i])
        skipped += 300 - (stops[i] - starts[i])
    assert skipped > 0 and LARGEST == 2**55
