"""Frames with any number of tags and extension headers, and fingerprints of rows that only look alike."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from netsieve.operators.integrity import fingerprint
from netsieve.operators.quantiles import fit_quantiles, landmarks, sketched_landmarks
from netsieve.plans.open_set import ShieldSettings, fit_shield
from netsieve.sources.headers import decode_headers

UDP = struct.pack(">HHHH", 1000, 53, 12, 0) + b"data"


def tagged(n):
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(UDP), 0, 0, 64, 17, 0, b"\x0a\0\0\1", b"\x0a\0\0\2")
    tags = b"".join(struct.pack(">HH", 0x8100, i) for i in range(n))
    return b"\0" * 12 + tags + struct.pack(">H", 0x0800) + ip + UDP


def extended(n):
    chain = [60] * n + [17]
    headers = b"".join(struct.pack(">BB6x", chain[i + 1], 0) for i in range(n))
    ip = struct.pack(">IHBB16s16s", 6 << 28, len(headers) + len(UDP), chain[0], 64, b"\1" * 16, b"\2" * 16)
    return b"\0" * 12 + struct.pack(">H", 0x86DD) + ip + headers + UDP


def test_frames_are_conserved(spark):
    frames = [tagged(n) for n in range(6)] + [extended(n) for n in range(21)]
    # A chain that goes on over the end of the frame, and tags up to its end.
    endless = [extended(3)[:60], b"\0" * 12 + struct.pack(">HH", 0x8100, 1) * 10]
    df = spark.createDataFrame([(i, bytearray(f)) for i, f in enumerate(frames + endless)], "packet_no long, frame binary")
    got = {r.packet_no: r for r in decode_headers(df).collect()}
    assert all((got[i].sport, got[i].dport, bytes(got[i].payload)) == (1000, 53, b"data") for i in range(len(frames)))
    every = {r.packet_no for r in decode_headers(df, with_ports_only=False).collect()}
    assert every >= set(range(len(frames) + 1))


@pytest.mark.parametrize("a,b", [([("a|b", "c")], [("a", "b|c")]), ([(None, "")], [("", None)]), ([("a", "b")] * 2, [("a", "b")])])
def test_fingerprints_differ(spark, a, b):
    left, right = (fingerprint(spark.createDataFrame(x, "p string, q string"), ["p", "q"]).first() for x in (a, b))
    assert left.fingerprint != right.fingerprint


def test_fingerprint_ignores_order(spark):
    df = spark.range(100).select((F.col("id") % 7).alias("p"))
    assert fingerprint(df, ["p"]).first() == fingerprint(df.orderBy(F.desc("p")).repartition(5), ["p"]).first()


@pytest.mark.parametrize("rows,quantiles", [(1, 5), (2, 7), (40, 11), (300, 40)])
def test_landmarks_equal_numpy(spark, rows, quantiles):
    x = np.round(np.random.default_rng(rows).normal(size=(rows, 3)), 1)
    df = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>")
    got = {r.dim: r.q for r in landmarks(df, "v", quantiles).collect()}
    for d in range(3):
        np.testing.assert_allclose(got[d], np.quantile(x[:, d], np.linspace(0, 1, quantiles)), atol=1e-12)


@pytest.mark.parametrize("rows,quantiles", [(1, 5), (2, 7), (40, 11), (300, 40)])
def test_sketches_of_small_tables_are_exact(spark, rows, quantiles):
    x = np.round(np.random.default_rng(rows).normal(size=(rows, 3)), 1)
    df = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>").repartition(3)
    got = {r.dim: r.q for r in sketched_landmarks(df, "v", quantiles).collect()}
    for d in range(3):
        np.testing.assert_allclose(got[d], np.quantile(x[:, d], np.linspace(0, 1, quantiles)), atol=1e-12)
    assert sketched_landmarks(df.limit(0), "v", quantiles).count() == 0


def test_sketches_keep_ranks_within_their_error(spark):
    df = spark.range(0, 200_000, 1, 8).select(F.array(F.randn(1), F.exp(F.randn(2))).alias("v"), "id")
    assert np.array_equal(
        fit_quantiles(df.where("id < 500"), "v", "id", 100), fit_quantiles(df.where("id < 500"), "v", "id", 100, sketch=None)
    )
    exact = np.sort(np.array([r.v for r in df.select("v").collect()]), axis=0)
    got = fit_quantiles(df, "v", "id", 1001, sketch=1024)
    for d in range(2):
        ranks = np.searchsorted(exact[:, d], got[d]) / len(exact)
        assert np.abs(ranks - np.linspace(0, 1, 1001)).max() < 0.003
        assert (got[d][0], got[d][-1]) == (exact[0, d], exact[-1, d])
    # One exchange of sketches; no row per value.
    plan = sketched_landmarks(df, "v", 11)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("ObjectHashAggregate")


def test_fitted_landmarks_are_exact_at_any_size(spark):
    df = spark.range(0, 20_000, 1, 8).select(F.array(F.randn(3), F.exp(F.randn(4))).alias("embedding"), "id", F.lit(0).alias("label"))
    x = np.array([r.embedding for r in df.collect()])
    want = np.quantile(x, np.linspace(0, 1, 101), axis=0).T
    np.testing.assert_allclose(fit_quantiles(df, "embedding", "id", 101), want, atol=1e-12)
    shield = fit_shield(df, ShieldSettings(variance=1.0, quantiles=101, known={"a": 0}, unknown={}))
    z = ((x - shield.pca.mean) @ shield.pca.components).astype(np.float32).astype(np.float64)
    np.testing.assert_allclose(shield.marks, np.quantile(z, np.linspace(0, 1, 101), axis=0).T, atol=1e-6)
