import numpy as np
from pyspark.sql import functions as F

from netsieve.llm.neighbours import Settings, grow, search

KIND = "vec_id long, vector array<float>"


def plain(vectors, queries, k=10):
    ids = np.array(sorted(vectors))
    rows = np.stack([vectors[i] for i in ids]).astype(np.float64)
    out = []
    for q in queries:
        gaps = np.sqrt(((rows - vectors[q].astype(np.float64)) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, gaps)) if ids[i] != q][:k]
        out += [(q, r + 1, int(ids[i]), float(gaps[i])) for r, i in enumerate(order)]
    return out


def made(n, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 16))
    return {i: (centres[rng.integers(12)] + 0.5 * rng.normal(size=16)).astype(np.float32) for i in range(n)}


def table(spark, vectors):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors.items()], KIND)


def test_recall(spark):
    vectors = made(3000)
    settings = Settings(sample_rows=1000, leaf_rows=64, part_rows=50, part_queries=7, calibration_queries=20)
    found = search(table(spark, vectors), F.col("vec_id") % 50 == 0, settings=settings).collect()
    queries = list(range(0, 3000, 50))
    exact = plain(vectors, queries)
    got = {(r.query_id, r.vec_id): r for r in found}
    assert len(found) == len(exact)
    assert np.mean([(q, v) in got for q, _, v, _ in exact]) >= 0.9
    for (q, v), r in got.items():
        gap = np.sqrt(((vectors[q].astype(np.float64) - vectors[v].astype(np.float64)) ** 2).sum())
        assert abs(r.score - gap) < 1e-12
    for q in queries:
        rows = sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, 11))
        assert [(r.score, r.vec_id) for r in rows] == sorted((r.score, r.vec_id) for r in rows)


def test_hot_vector_and_ties(spark):
    vectors = made(200)
    for i in range(200, 500):
        vectors[i] = np.full(16, 3.0, np.float32)
    settings = Settings(sample_rows=300, leaf_rows=32, part_rows=20, recall=1.0)
    found = search(table(spark, vectors), F.col("vec_id") % 100 == 0, settings=settings).collect()
    assert sorted(map(tuple, found)) == plain(vectors, [0, 100, 200, 300, 400])


def test_odd_rows(spark):
    good = made(6)
    rows = [(i, [float(x) for x in v]) for i, v in good.items()]
    odd = [(100, None), (200, []), (300, [0.0] * 16), (400, [None] * 16), (500, [float("nan")] * 16), (600, [float("inf")] + [1.0] * 15)]
    odd += [(700, [1.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows + odd, KIND).withColumn("leaf", F.lit("clash"))
    found = sorted(map(tuple, search(df, F.col("vec_id") % 100 == 0).collect()))
    assert found == plain(good, [0])
    assert search(df.limit(0), F.lit(True)).collect() == []


def test_repeated_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0])], KIND)
    assert sorted(map(tuple, search(df, F.col("vec_id") == 0).collect())) == [(0, 1, 1, 1.0), (0, 2, 1, 1.0)]


def test_every_row_reaches_one_leaf_and_every_leaf_is_visited():
    rows = np.stack(list(made(500).values())).astype(np.float64)
    tree = grow(rows, 20, Settings())
    assert tree.leaves > 10
    assert sorted(tree.visit(rows[0])) == list(range(tree.leaves))
    leaves = tree.assign(rows)
    assert all(next(tree.visit(r)) == leaf for r, leaf in zip(rows, leaves))


def test_doubles(spark):
    rng = np.random.default_rng(8)
    vectors = {i: rng.normal(size=6) for i in range(300)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, vector array<double>")
    found = search(df, F.col("vec_id") % 100 == 0, settings=Settings(recall=1.0, leaf_rows=40, sample_rows=300)).collect()
    assert sorted(map(tuple, found)) == plain(vectors, [0, 100, 200])


def test_a_repeated_id_is_one_query_whatever_the_order(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.1, 1.0]), (2, [1.0, 0.1]), (3, [5.0, 5.0])]
    first, second = (sorted(map(tuple, search(spark.createDataFrame(r, KIND), F.col("vec_id") == 0, k=1).collect())) for r in (rows, rows[::-1]))
    assert first == second and [r[2] for r in first] == [1]
