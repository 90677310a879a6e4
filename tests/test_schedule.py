import random

import pytest

from netsieve.operators.schedule import disjoint_segments, label_packets
from netsieve.schemas import SCHEDULE
from netsieve.sources.schedule import load_schedule, schedule_from

YAML = """
attacks:
  closed_set:
    - {attack_name: Hulk, date: "2018-02-16", attacker_ips: [a1, a2], victim_ips: [v1], time_windows: [["13:45", "14:19"]], target_folder: stratified_split, label: DoS}
  zero_day:
    - {attack_name: Bot, date: "2018-03-02", attacker_ips: [a1], victim_ips: [v1, v2], time_windows: [["10:11", "11:34"], ["14:24", "15:55"]], target_folder: hold_out_test, label: Botnet}
"""


def test_schedule_rows(spark, tmp_path):
    (tmp_path / "s.yaml").write_text(YAML)
    rows = load_schedule(spark, str(tmp_path / "s.yaml")).collect()
    assert len(rows) == 2 + 4
    bot = [r for r in rows if r.label == "Botnet"]
    assert {r.priority for r in bot} == {2} and {r.rule_order for r in bot} == {0}
    assert min(r.start_us for r in bot) == 1519999860 * 1_000_000
    assert load_schedule(spark, str(tmp_path / "s.yaml"), "2018-02-16").count() == 2


def test_known_label_in_quarantine_is_refused(spark):
    entry = dict(attack_name="x", date="2018-02-16", attacker_ips=["a"], victim_ips=["v"], time_windows=[], target_folder="test_ood", label="DoS")
    with pytest.raises(ValueError, match="quarantine"):
        schedule_from(spark, {"attacks": {"closed_set": [entry]}})


@pytest.fixture(scope="module")
def case():
    rng = random.Random(4)
    ips = [f"h{i}" for i in range(6)]
    rules = []
    for order in range(40):
        lo = rng.randrange(1000)
        label = rng.choice(["DoS", "DDoS", "Botnet"])
        rules.append((rng.choice(ips), rng.choice(ips), lo, lo + rng.randrange(200), label, f"s{order}", "f", 2 if label == "Botnet" else 1, order))
    packets = [(i, rng.choice(ips), rng.choice(ips), rng.randrange(1200)) for i in range(3000)]
    return rules, packets


def by_hand(rules, packet, priority):
    _, src, dst, ts = packet
    best = None
    for pair in ((src, dst), (dst, src)):
        for r in rules:
            if (r[0], r[1]) == pair and r[2] <= ts <= r[3] and (best is None or (priority and r[7] > best[7])):
                best = r
    return ("Benign", "Benign") if best is None else (best[4], best[5])


@pytest.mark.parametrize("policy", ["priority", "first"])
@pytest.mark.parametrize("limit", [100_000, 1])
def test_labels_equal_the_search(spark, case, policy, limit):
    rules, packets = case
    schedule = spark.createDataFrame(rules, SCHEDULE)
    df = spark.createDataFrame(packets, "id int, src_ip string, dst_ip string, ts_us long")
    out = label_packets(df, schedule, policy, limit, bucket_us=50)
    got = {r.id: (r.label, r.attack_subtype) for r in out.collect()}
    assert got == {p[0]: by_hand(rules, p, policy == "priority") for p in packets}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert ("strategy=broadcast" in plan) == (limit > 1)


@pytest.mark.parametrize("policy", ["priority", "first"])
def test_segments_equal_the_search(spark, case, policy):
    rules, packets = case
    odd = [("h0", "h1", 30, 20, "DoS", "never", "f", 9, 90), (None, "h1", 0, 2000, "DoS", "null", "f", 9, 91)]
    schedule = spark.createDataFrame(rules + odd, SCHEDULE)
    more = [(5000, None, "h1", 5), (5001, "h0", None, 5), (5002, "h0", "h1", None), (5003, "new", "h1", 5)]
    df = spark.createDataFrame(packets + more, "id int, src_ip string, dst_ip string, ts_us long")
    out = label_packets(df, schedule, policy, many_windows=0)
    got = {r.id: (r.label, r.attack_subtype) for r in out.collect()}
    want = {p[0]: by_hand(rules, p, policy == "priority") for p in packets} | {p[0]: ("Benign", "Benign") for p in more}
    assert got == want and out.columns == label_packets(df, schedule, policy).columns
    assert sorted(map(str, out.collect())) == sorted(map(str, label_packets(df, schedule, policy).collect()))


def test_many_windows_of_one_pair(spark):
    rng = random.Random(8)
    rules = []
    for order in range(10_000):
        lo = rng.randrange(1_000_000)
        rules.append(("a", "v", lo, lo + rng.randrange(3000), "DoS", f"s{order}", "f", rng.randrange(3), order))
    schedule = spark.createDataFrame(rules, SCHEDULE)
    df = spark.range(20_000).selectExpr("id", "'v' AS src_ip", "'a' AS dst_ip", "id * 53 % 1005000 AS ts_us")
    got = {r.id: r.attack_subtype for r in label_packets(df, schedule).collect()}
    for i in range(0, 20_000, 997):
        ts = i * 53 % 1005000
        covering = [r for r in rules if r[2] <= ts <= r[3]]
        assert got[i] == (max(covering, key=lambda r: (r[7], -r[8]))[5] if covering else "Benign")


def test_disjoint_segments():
    starts, winners = disjoint_segments([(5, 9), (0, 20), (8, 30), (40, 30), (31, 31)])
    assert list(zip(starts.tolist(), winners.tolist())) == [(0, 1), (5, 0), (10, 1), (21, 2), (31, 4), (32, -1)]
    assert [len(x) for x in disjoint_segments([])] == [0, 0]
