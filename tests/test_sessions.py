import pandas as pd
import pytest
from pyspark.sql import functions as F

from netsieve.operators.audit import audit_report, audit_sessions, odd_in_streak
from netsieve.operators.sessions import build_sessions, packet_segment, sessionize, skew_segments
from tests import folds


def frame(spark, rows):
    return spark.createDataFrame(pd.DataFrame(rows, columns=folds.COLUMNS))


@pytest.mark.parametrize("segment", [None, 1, 7, 100, 10**6])
def test_sessions_equal_the_fold(spark, segment):
    rows = folds.packets()
    cut = sessionize(frame(spark, rows), None if segment is None else packet_segment(segment))
    built = build_sessions(cut)
    got = sorted(
        (*r[:7], list(r[7]))
        for r in built.select(
            "canonical_tuple", "session_instance", "start_ts_us", "end_ts_us", "observed_packets", "label", "attack_subtype",
            F.col("packets.is_forward"),
        ).collect()
    )
    want = folds.sessions(rows)
    assert any(s[4] > 18 for s in want)
    assert got == want


def test_ranks_count_through_each_session(spark):
    cut = sessionize(frame(spark, folds.packets(2000, seed=3)), packet_segment(13))
    bad = cut.groupBy("canonical_tuple", "session_instance").agg(
        F.count("*").alias("n"), F.max("packet_rank").alias("hi"), F.count_distinct("packet_rank").alias("d")
    ).where("n <> hi or n <> d")
    assert bad.count() == 0


def test_gap_of_exactly_the_timeout_does_not_split(spark):
    rows = [("c", "k", 0, i, t, False, "Benign", "Benign", "1.1.1.1", 1, 0.0, b"") for i, t in enumerate([0, 120_000_000, 240_000_001])]
    got = [r.session_instance for r in sessionize(frame(spark, rows), None).orderBy("packet_no").collect()]
    assert got == [1, 1, 2]


@pytest.mark.parametrize("cap,teardown", [(2, 0.5), (3, 0.5), (18, 0.05)])
@pytest.mark.parametrize("segment", [None, 13])
def test_audit_equals_the_fold(spark, cap, teardown, segment):
    rows = folds.packets(3000, seed=cap, teardown=teardown)
    counted = audit_sessions(
        frame(spark, rows), segment and packet_segment(segment), keys=("source_capture", "canonical_tuple"), max_packets=cap
    )
    assert {r.label: r.sessions for r in audit_report(counted).collect()} == folds.audit(rows, cap)


@pytest.mark.parametrize("block", [1, 3, 16, 10_000])
def test_odd_positions_of_streaks(spark, block):
    numbers = [n for n in range(300) if n % 7 not in (0, 3) or n % 5 == 0]
    want, previous, place = [], None, 0
    for n in numbers:
        place = place + 1 if previous == n - 1 else 1
        previous = n
        want += [n] if place % 2 else []
    df = spark.createDataFrame([("a", n) for n in numbers], "k string, n long")
    assert sorted(r.n for r in odd_in_streak(df, ["k"], "n", block).collect()) == want


def test_label_outside_the_taxonomy_is_an_error(spark):
    row = ("c", "k", 0, 0, 0, False, "Strange", "x", "1.1.1.1", 1, 0.0, b"")
    with pytest.raises(Exception, match="outside the taxonomy"):
        build_sessions(sessionize(frame(spark, [row]), None)).collect()


def test_segments_only_for_large_keys(spark):
    df = frame(spark, folds.packets(500))
    assert skew_segments(df)[1] is None
    cut, segment = skew_segments(df, limit=100)
    assert segment is not None
    assert cut.groupBy("canonical_tuple", "_time_segment").count().agg(F.max("count")).first()[0] < 100


def test_small_keys_need_one_shuffle(spark, tmp_path):
    frame(spark, folds.packets(500)).write.parquet(str(tmp_path / "p"))
    cut = sessionize(spark.read.parquet(str(tmp_path / "p")), None)
    plan = build_sessions(cut, with_packets=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
