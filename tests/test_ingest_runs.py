"""Whole runs over capture files: what the store and the log hold after each."""

import hashlib

import pytest
from pyspark.sql import functions as F

from netsieve.operators.captures import group_captures, name_captures
from netsieve.operators.integrity import build_manifest
from netsieve.plans.ingestion import run_ingestion
from netsieve.plans.train_profile import InputChanged, unchanged_files
from netsieve.schemas import SCHEDULE
from netsieve.sources.completion import append_completion, done_captures, failed_captures, latest, read_log
from netsieve.sources.digests import file_digests
from netsieve.sources.pcap import read_packets
from netsieve.sources.sessions import list_capture_files, read_sessions
from tests.test_frames import capture_bytes
from tests.test_jobs import frame

RATES = {s: {"Benign": 1.0, "DoS": 1.0, "DDoS": 1.0} for s in ("train_known", "val_known", "test_known")} | {"test_ood": {}}


def write(folder, name, packets, tail=b""):
    (folder / name).write_bytes(capture_bytes(packets) + tail)


@pytest.fixture
def folder(tmp_path):
    made = tmp_path / "in"
    made.mkdir()
    write(made, "mon-19_A_chunk_00000_20180219000000.pcap", [(1000, 0, frame(sport=6001)), (1001, 0, frame(sport=6002))])
    write(made, "mon-19_A_chunk_00002_20180219000000.pcap", [(1002, 0, frame(sport=6003))])
    write(made, "tue-20_B.pcap", [(2000, 0, frame(sport=6004))], tail=b"\x01\x02\x03")
    (made / "wed-21_C.pcap").write_bytes(b"no capture")
    return made


def run(spark, folder, tmp_path, name):
    captures = group_captures(name_captures(list_capture_files(spark, str(folder))))
    schedule = spark.createDataFrame([], SCHEDULE)
    packets = read_packets(spark, str(folder), "capture")
    return run_ingestion(packets, captures, schedule, str(tmp_path / "store"), str(tmp_path / "log"), name, rates=RATES)


def test_runs_resume_from_the_log(spark, folder, tmp_path):
    first = run(spark, folder, tmp_path, "one")
    rows = {r.source_capture: r for r in first.completion.collect()}
    assert {k: r.status for k, r in rows.items()} == {"mon-19_A": "OK", "tue-20_B": "PARTIAL", "wed-21_C": "FAILED"}
    assert rows["mon-19_A"].missing_chunks == [1] and rows["tue-20_B"].missing_chunks == []
    totals = first.totals.first()
    assert (totals.captures, totals.failed, totals.partial, totals.incomplete, totals.missing_chunks) == (3, 1, 1, 1, 1)
    assert totals.sessions == sum(r.sessions for r in rows.values()) == read_sessions(spark, str(tmp_path / "store")).count()
    log = read_log(spark, str(tmp_path / "log"))
    assert first.number == 1 and done_captures(log).count() == 2
    assert [r.source_capture for r in failed_captures(log).collect()] == ["wed-21_C"]
    # The next run takes the failed capture alone; once it can be read it is done.
    write(folder, "wed-21_C.pcap", [(3000, 0, frame(sport=6005)), (3001, 0, frame(sport=6006))])
    second = run(spark, folder, tmp_path, "two")
    assert [(r.source_capture, r.status) for r in second.completion.collect()] == [("wed-21_C", "OK")]
    log = read_log(spark, str(tmp_path / "log"))
    assert latest(log).count() == 3 and log.count() == 4 and failed_captures(log).count() == 0
    assert read_sessions(spark, str(tmp_path / "store")).count() == totals.sessions + 2
    third = run(spark, folder, tmp_path, "three")
    assert third.number is None and third.totals.first().captures == 0


def test_a_run_broken_before_the_log_is_made_good(spark, folder, tmp_path, monkeypatch):
    def broken(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr("netsieve.plans.ingestion.append_completion", broken)
        with pytest.raises(RuntimeError, match="lost"):
            run(spark, folder, tmp_path, "one")
    assert read_log(spark, str(tmp_path / "log")).count() == 0
    count = read_sessions(spark, str(tmp_path / "store")).count()
    again = run(spark, folder, tmp_path, "two")
    assert again.totals.first().captures == 3 and read_sessions(spark, str(tmp_path / "store")).count() == count > 0


def test_newest_row_of_a_capture_counts(spark, tmp_path):
    kind = "capture_id string, source_capture string, status string, sessions long, kept long, packet_errors long, source_truncated boolean, missing_chunks array<int>"
    path = str(tmp_path / "log")
    row = lambda c, status: (c, c, status, 1, 1, 0, False, [])
    assert append_completion(spark.createDataFrame([row("a", "FAILED"), row("b", "OK")], kind), path, "x") == 1
    assert append_completion(spark.createDataFrame([row("a", "OK"), row("b", "FAILED")], kind), path, "y") == 2
    log = read_log(spark, path)
    assert [r[0] for r in done_captures(log).collect()] == ["a"] and [r.capture_id for r in failed_captures(log).collect()] == ["b"]


def test_digests_of_whole_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    files = {"a.bin": b"", "b.bin": b"x" * 1000, "c.txt": b"no"}
    for name, content in files.items():
        (tmp_path / "in" / name).write_bytes(content)
    got = {r.path.rsplit("/", 1)[1]: (r.size_bytes, r.sha256) for r in file_digests(spark, str(tmp_path / "in"), "*.bin", piece_bytes=7).collect()}
    assert got == {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in files.items() if c and n.endswith("bin")}
    one = file_digests(spark, f"file:{tmp_path}/in/b.bin").first()
    assert one.sha256 == hashlib.sha256(files["b.bin"]).hexdigest()


def test_manifest_of_tables(spark, tmp_path):
    path = str(tmp_path / "tables")
    for name, n in (("one", 5), ("two", 0)):
        spark.range(n).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    rows = build_manifest(spark, path).collect()
    assert sorted(r.row_count for r in rows) == [0, 5]
    for r in rows:
        content = open(r.path, "rb").read()
        assert (r.size_bytes, r.sha256) == (len(content), hashlib.sha256(content).hexdigest())


def test_files_that_change_during_a_fit_are_refused(spark, tmp_path):
    path = str(tmp_path / "train")
    spark.range(10).write.parquet(path)
    with unchanged_files(spark, path) as manifest:
        assert manifest.agg(F.sum("row_count")).first()[0] == 10
    with pytest.raises(InputChanged, match="unexpected"):
        with unchanged_files(spark, path):
            spark.range(3).write.mode("append").parquet(path)
    with pytest.raises(InputChanged, match="missing"):
        with unchanged_files(spark, path):
            spark.range(4).write.mode("overwrite").parquet(path)
    with pytest.raises(ZeroDivisionError):
        with unchanged_files(spark, path):
            1 / 0
