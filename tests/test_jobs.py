"""Whole jobs: hand-made captures through ingestion, profile, closed-set evaluation and the stream."""

import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from netsieve.functions.labels import long_enough
from netsieve.operators.captures import (
    completion_totals,
    error_summary,
    group_captures,
    name_captures,
    pending_captures,
)
from netsieve.operators.sessions import build_sessions, packet_segment, sessionize
from netsieve.plans.audit import audit_captures
from netsieve.plans.closed_set import evaluate_closed_set
from netsieve.plans.ingestion import ingest
from netsieve.plans.train_profile import fit_profile
from netsieve.schemas import SCHEDULE
from netsieve.sources.pcap import read_packets
from netsieve.sources.sessions import list_capture_files, read_sessions, remove_replaced, withdraw_captures, write_sessions
from netsieve.streaming.sessionizer import numbered_sessions, run_available, sessionize_stream
from tests import folds
from tests.test_frames import capture_bytes, eth, tcp, udp, v4

HOST, PEER = "10.0.0.5", "10.0.0.10"


def frame(back=False, flags=16, payload=b"", sport=5000):
    src, dst, a, b = (PEER, HOST, 80, sport) if back else (HOST, PEER, sport, 80)
    return eth(0x800, v4(src, dst, 6, tcp(a, b, flags, payload)))


@pytest.fixture(scope="module")
def captures(tmp_path_factory):
    """Three sessions on one tuple (teardown, late answer, over-long gap), one long UDP session, one broken file."""
    folder = tmp_path_factory.mktemp("captures")
    first = [
        (1000, 0, frame(payload=b"aab")),
        (1002, 500_000, frame(back=True, payload=bytes(200))),
        (1003, 0, frame(flags=1)),
        (1003, 10, frame(back=True)),
        (1003, 20, b"tiny"),
    ]
    dns = [(1100 + i, 0, eth(0x800, v4("10.0.0.7", PEER, 17, udp(999, 53, bytes([i]))))) for i in range(20)]
    second = [(1124, 11, frame(payload=b"x")), *dns]
    (folder / "thu-22_UCAP_chunk_00000_20180222000000.pcap").write_bytes(capture_bytes(first))
    (folder / "thu-22_UCAP_chunk_00002_20180222000200.pcap").write_bytes(capture_bytes(second))
    (folder / "fri-16_X.pcap").write_bytes(capture_bytes([(5, 0, frame(sport=6000))])[:-3])
    return str(folder)


# The attack window opens at the late answer and covers the 19th and 20th UDP packet.
RULES = [
    (PEER, HOST, 1_003_000_010, 1_003_000_010, "DoS", "Slow", "stratified_split", 1, 1),
    ("10.0.0.7", PEER, 1_118_000_000, 1_118_000_000, "Botnet", "Bot", "hold_out_test", 2, 0),
    ("10.0.0.7", PEER, 1_118_000_000, 1_119_000_000, "DDoS", "Loic", "stratified_split", 1, 2),
]


@pytest.fixture(scope="module")
def ingested(spark, captures):
    groups = group_captures(name_captures(list_capture_files(spark, captures)))
    packets = read_packets(spark, captures, "capture")
    return ingest(packets, groups, spark.createDataFrame(RULES, SCHEDULE), segment_packets=2)


def test_audit_by_hand(spark, captures):
    """Per file: teardown session, labelled answer; then one TCP and one UDP session counted before its attack."""
    report = audit_captures(read_packets(spark, captures, "capture"), spark.createDataFrame(RULES, SCHEDULE), 2)
    assert {r.label: r.sessions for r in report.collect()} == {"Benign": 3, "DoS": 1}


def test_capture_groups(spark, captures):
    rows = {r.source_capture: r for r in group_captures(name_captures(list_capture_files(spark, captures))).collect()}
    assert rows["thu-22_UCAP"].missing_chunks == [1] and rows["thu-22_UCAP"].capture_day == "thu-22"
    assert [p[-40:-25] for p in rows["thu-22_UCAP"].source_files] == sorted(p[-40:-25] for p in rows["thu-22_UCAP"].source_files)
    assert rows["fri-16_X"].missing_chunks == []


@pytest.mark.parametrize("names,problem", [
    (["a_chunk_00000_20180101000000.pcap", "a.pcap"], "whole and in chunks"),
    (["a_chunk_00001_20180101000000.pcap", "a_chunk_00001_20180101000001.pcap"], "repeated chunk"),
])
def test_unsound_captures_are_an_error(spark, names, problem):
    files = spark.createDataFrame([("/in/" + n,) for n in names], "path string")
    with pytest.raises(Exception, match=problem):
        group_captures(name_captures(files)).collect()


def test_sessions_by_hand(ingested):
    rows = {(r.canonical_tuple, r.session_instance): r for r in ingested.sessions.collect()}
    key, dns = f"{PEER}-{HOST}-80-5000-6", "10.0.0.10-10.0.0.7-53-999-17"
    assert set(rows) == {(key, 1), (key, 2), (key, 3), (dns, 1)}
    a, b, c, d = rows[key, 1], rows[key, 2], rows[key, 3], rows[dns, 1]
    assert (a.start_ts_us, a.end_ts_us, a.observed_packets, a.captured_packets) == (1_000_000_000, 1_003_000_000, 3, 3)
    assert [p.is_forward for p in a.packets] == [True, False, True]
    assert a.packets[0].entropy == pytest.approx(-(2 / 3) * math.log2(2 / 3) - (1 / 3) * math.log2(1 / 3), rel=1e-6)
    assert (a.packets[1].entropy, a.packets[2].entropy) == (0.0, 0.0)
    assert a.packets[1].delta_enc == pytest.approx(255 * math.log1p(2.5) / math.log1p(120), rel=1e-6)
    stored = bytearray(frame(payload=b"aab"))
    stored[:12], stored[26:34] = bytes(12), bytes(8)
    assert bytes(a.packets[0].bytes) == bytes(stored)
    assert len(a.packets[1].bytes) == 128
    assert (a.label, b.label, b.attack_subtype, c.label) == ("Benign", "DoS", "Slow", "Benign")
    # The late answer opens its own session, so its sender is the initiator there.
    assert b.packets[0].is_forward and b.observed_packets == 1
    # A gap of more than 120 s after the answer.
    assert c.start_ts_us - b.end_ts_us == 121_000_001
    assert (d.observed_packets, d.captured_packets, len(d.packets)) == (20, 18, 18)
    # Only packets beyond the stored 18 carry a label; the unknown class wins over the later known one.
    assert (d.label, d.attack_subtype, d.split) == ("Botnet", "Bot", "test_ood")
    material = f"thu-22_UCAP|{key}|1000000000|1"
    assert a.session_id == hashlib.sha256(material.encode()).hexdigest()[:24]
    assert a.split_group_key == hashlib.sha256(f"thu-22|{key}".encode()).hexdigest() == c.split_group_key
    assert a.split == b.split == c.split and a.source_truncated
    assert len(a.source_files) == 2


def test_errors_and_flags(ingested):
    errors = {(r.source_capture, r.error_key): r.n for r in error_summary(ingested.errors).collect()}
    assert errors == {
        ("thu-22_UCAP", "thu-22_UCAP_chunk_00000_20180222000000.pcap | NeedData: short link header"): 1,
        ("fri-16_X", "fri-16_X.pcap | NeedData: truncated record"): 1,
    }
    assert {r.source_capture: r.source_truncated for r in ingested.flags.collect()} == {"thu-22_UCAP": True, "fri-16_X": True}


def test_store_replaces_only_the_written_captures(spark, ingested, tmp_path):
    path = str(tmp_path / "store")
    write_sessions(ingested.sessions, path)
    write_sessions(ingested.sessions.limit(0), path)
    write_sessions(ingested.sessions.where("split = 'test_ood'"), path)
    assert read_sessions(spark, path).count() == 4
    assert read_sessions(spark, path, "test_ood").count() == 1
    plan = read_sessions(spark, path, "test_ood").select("label")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and "packets" not in plan
    long = read_sessions(spark, path).where(long_enough(F.col("captured_packets"))).select("label")
    assert "GreaterThanOrEqual(captured_packets,7)" in long._jdf.queryExecution().executedPlan().toString()


def test_a_rerun_leaves_no_stale_rows(spark, ingested, tmp_path):
    path = str(tmp_path / "store")
    write_sessions(ingested.sessions, path)
    captures = ingested.completion
    moved = ingested.sessions.where("split = 'test_ood'").withColumn("split", F.lit("val_known"))
    write_sessions(moved, path, captures)
    assert [r.split for r in read_sessions(spark, path).select("split").collect()] == ["val_known"]
    write_sessions(ingested.sessions, path, captures.where("false"))
    assert read_sessions(spark, path).count() == 5


def test_a_failed_write_changes_nothing(spark, ingested, tmp_path):
    path = str(tmp_path / "store")
    write_sessions(ingested.sessions, path)
    rows = sorted(map(str, read_sessions(spark, path).collect()))
    broken = ingested.sessions.withColumn("attack_subtype", F.when(F.col("split") == "test_ood", F.raise_error(F.lit("broken"))).otherwise("new"))
    with pytest.raises(Exception, match="broken"):
        write_sessions(broken, path, ingested.completion)
    assert sorted(map(str, read_sessions(spark, path).collect())) == rows
    # Rows that were written without a commit do not show either.
    parts = ingested.sessions.withColumn("generation", F.lit("lost"))
    parts.write.mode("append").partitionBy("generation", "split", "capture_day", "capture_id").parquet(f"{path}/data")
    assert sorted(map(str, read_sessions(spark, path).collect())) == rows
    assert remove_replaced(spark, path) > 0 and remove_replaced(spark, path) == 0
    assert sorted(map(str, read_sessions(spark, path).collect())) == rows


def test_withdrawn_captures_are_gone(spark, ingested, tmp_path):
    path = str(tmp_path / "store")
    assert read_sessions(spark, path).count() == 0 and withdraw_captures(spark, path, ingested.completion) == 0
    assert write_sessions(ingested.sessions, path) == 1
    assert withdraw_captures(spark, path, ingested.completion) == ingested.sessions.select("split").distinct().count()
    assert read_sessions(spark, path).count() == 0
    assert write_sessions(ingested.sessions, path) == 3 and read_sessions(spark, path).count() == 4


def test_completion(ingested):
    rows = {r.source_capture: r for r in ingested.completion.collect()}
    # One capture gave sessions in spite of an error; the other's reader failed before any packet.
    a, b = rows["thu-22_UCAP"], rows["fri-16_X"]
    assert (a.status, a.sessions, a.packet_errors, a.source_truncated) == ("OK", 4, 1, True)
    assert (b.status, b.sessions, b.packet_errors, b.source_truncated) == ("FAILED", 0, 1, True)
    totals = completion_totals(ingested.completion).first()
    assert (totals.captures, totals.failed, totals.truncated, totals.sessions, totals.packet_errors) == (2, 1, 2, 4, 2)
    assert pending_captures(ingested.completion, ingested.completion.where("status = 'OK'")).count() == 1


@pytest.fixture(scope="module")
def stored(spark):
    """Fold sessions with three known labels spread over the splits."""
    rows = [r for r in folds.packets(6000, seed=9, hot=1) if r[6] not in folds.UNKNOWN]
    built = build_sessions(sessionize(spark.createDataFrame(pd.DataFrame(rows, columns=folds.COLUMNS)), packet_segment(500)))
    split = F.when(F.col("session_instance") % 3 == 0, "test_known").otherwise("train_known")
    return built.withColumn("session_id", F.concat_ws("/", "canonical_tuple", "session_instance")).withColumn("split", split)


def test_train_profile(spark, stored):
    profile = fit_profile(stored)
    train = stored.where("split = 'train_known'").collect()
    packets = [p for r in train for p in r.packets]
    assert profile.bounds["valid_sessions"] == len(train)
    assert profile.bounds["max_delta"] == pytest.approx(max(p.delta_enc for p in packets))
    assert profile.bounds["max_packet"] == max(b for p in packets for b in bytes(p.bytes))
    assert profile.bounds["max_entropy"] == pytest.approx(max(p.entropy for p in packets))
    assert (profile.bounds["min_raw"], profile.bounds["min_entropy"]) == (0.0, 0.0)
    assert sum(n for _, n in profile.counts) == len(train)
    with pytest.raises(ValueError, match="counts differ"):
        fit_profile(stored, spark.createDataFrame([("Benign", 1)], "label string, n long"))
    broken = stored.withColumn("label", F.when(F.col("session_instance") == 1, "Odd").otherwise(F.col("label")))
    with pytest.raises(ValueError, match="label not allowed"):
        fit_profile(broken)


def test_closed_set(stored):
    bounds = {"min_raw": 0.0, "max_raw": 255.0, "min_entropy": 0.0, "max_entropy": 8.0}

    def model():
        def run(images):
            m = images.reshape(len(images), 3, -1).mean(axis=2)
            return m, m

        return run

    result = evaluate_closed_set(stored, bounds, model)
    chosen = [r for r in stored.where("split = 'test_known'").collect() if r.captured_packets >= 7]
    want = {}
    for r in chosen:
        tensor = np.zeros((18, 144, 3), np.float32)
        for i, p in enumerate(r.packets):
            c = 0 if p.is_forward else 1
            tensor[i, :16, c] = p.delta_enc
            tensor[i, 16 : 16 + len(p.bytes), c] = list(p.bytes)
            tensor[i, :, 2] = p.entropy
        image = tensor[:7].transpose(2, 0, 1) / np.array([255, 255, 8])[:, None, None]
        want[r.session_id] = image.reshape(3, -1).mean(axis=1)
    got = {r.session_id: r for r in result.scored.collect()}
    assert set(got) == set(want)
    for k, m in want.items():
        np.testing.assert_allclose(got[k].embedding, m, rtol=1e-4, atol=1e-7)
        assert got[k].pred == np.argmax(m)
    assert result.summary.first().total_samples == len(chosen)


def streamed(spark, tmp_path, df, cuts, lateness):
    for cut in cuts:
        part = df.where((F.col("packet_no") >= cut[0]) & (F.col("packet_no") < cut[1]))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return run_available(spark, sessionize_stream(source, lateness), str(tmp_path / "out"), str(tmp_path / "state"))


def packet_table(spark, rows):
    df = spark.createDataFrame(pd.DataFrame(rows, columns=folds.COLUMNS)).withColumn("sport", F.col("sport").cast("int"))
    return df.withColumn("entropy", F.col("entropy").cast("float"))


def test_stream_equals_batch(spark, tmp_path):
    df = packet_table(spark, folds.packets(1500, seed=11, backwards=0))
    run = streamed(spark, tmp_path, df, ((0, 500), (500, 1000), (1000, 2000)), "0 seconds")
    assert run.late_packets == 0 and run.open.count() > 0
    batch = build_sessions(sessionize(df, None))
    out = numbered_sessions(run.closed.unionByName(run.open)).select(batch.columns)
    assert out.count() == batch.count() and out.exceptAll(batch).count() == 0


def test_late_packets_of_many_triggers(spark, tmp_path):
    second, n = 1_000_000, 16
    times = [10_000, *[20_000 + k if k % 2 else k for k in range(n)]]
    rows = [("cap", f"k{i}", 0, i, t * second, False, "Benign", "Benign", "1.1.1.1", 1, 0.0, b"") for i, t in enumerate(times)]
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "4")
    try:
        run = streamed(spark, tmp_path, packet_table(spark, rows), [(i, i + 1) for i in range(len(rows))], "0 seconds")
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    assert run.late_packets == n // 2


def test_late_packets_are_counted(spark, tmp_path):
    second = 1_000_000
    rows = [("cap", f"k{i}", 0, i, t * second, False, "Benign", "Benign", "1.1.1.1", 1, 0.0, b"") for i, t in enumerate((1000, 2000, 10, 3000))]
    run = streamed(spark, tmp_path, packet_table(spark, rows), [(i, i + 1) for i in range(4)], "0 seconds")
    assert run.late_packets == 1
    assert run.closed.unionByName(run.open).count() == 3
