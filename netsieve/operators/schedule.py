"""Labelling packets from an attack schedule: address pair in either direction plus an inclusive interval."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from netsieve.operators.ordered import SMALL_SIDE_ROWS
from netsieve.schemas import DEFAULT_FOLDER


BUCKET_US = 3_600_000_000
#: Above so many windows on one address pair, windows are cut into disjoint segments and searched by bisection.
MANY_WINDOWS = 64
_RESULT = ("label", "attack_subtype", "target_folder")


def rules_by_pair(schedule: DataFrame, policy: str, bucket_us: int | None = None) -> DataFrame:
    """One row per ordered address pair with its windows; the largest matching struct wins.

    With `bucket_us` one row per pair and time bucket, so that a pair with very many rules is spread out.
    """
    if policy not in ("priority", "first"):
        raise ValueError(f"unknown labelling policy {policy!r}")
    rank = F.col("priority") if policy == "priority" else F.lit(0)

    def directed(src: str, dst: str, direction: int) -> DataFrame:
        return schedule.select(
            F.col(src).alias("src_ip"),
            F.col(dst).alias("dst_ip"),
            F.struct(
                rank.alias("rank"),
                F.lit(-direction).alias("direction"),
                (-F.col("rule_order")).alias("order"),
                F.col("start_us").alias("lo"),
                F.col("end_us").alias("hi"),
                "label",
                "attack_subtype",
                "target_folder",
            ).alias("rule"),
        )

    both = directed("attacker_ip", "victim_ip", 0).unionByName(directed("victim_ip", "attacker_ip", 1))
    keys = ["src_ip", "dst_ip"]
    if bucket_us is not None:
        first, last = (F.floor(F.col(f"rule.{edge}") / bucket_us) for edge in ("lo", "hi"))
        both = both.where("rule.lo <= rule.hi").withColumn("_bucket", F.explode(F.sequence(first, last)))
        keys.append("_bucket")
    return both.groupBy(*keys).agg(F.collect_list("rule").alias("rules"))


def disjoint_segments(windows: Sequence[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(starts, winners) of inclusive windows (low, high), the first of which that covers a moment wins: from each start on, up to the
    next one, the place of the winner in `windows`, -1 for none. Windows that end before they begin cover nothing."""
    sound = [i for i, (low, high) in enumerate(windows) if low <= high]
    opening = sorted(sound, key=lambda i: windows[i][0])
    moments = sorted({windows[i][0] for i in sound} | {windows[i][1] + 1 for i in sound})
    starts, winners, open_now, at = [], [], [], 0
    for moment in moments:
        while at < len(opening) and windows[opening[at]][0] <= moment:
            heapq.heappush(open_now, opening[at])
            at += 1
        while open_now and windows[open_now[0]][1] < moment:
            heapq.heappop(open_now)
        winner = open_now[0] if open_now else -1
        if not winners or winners[-1] != winner:
            starts.append(moment)
            winners.append(winner)
    return np.array(starts, np.int64), np.array(winners, np.int64)


def _indexed(packets: DataFrame, rules: DataFrame) -> DataFrame:
    """`packets` with `_hit`: the rule that wins, found by bisection in the segments of the packet's pair.

    `rules` is the output of `rules_by_pair` for a schedule of a proven size, so it is gathered and broadcast.
    """
    index, results = {}, []
    for row in rules.collect():
        # A larger struct wins; nulls are smallest and texts are compared by their bytes, as in Spark.
        key = lambda r: tuple((0,) if v is None else (1, v.encode() if isinstance(v, str) else v) for v in r)
        best = sorted((r for r in row["rules"] if r["lo"] is not None and r["hi"] is not None), key=key, reverse=True)
        starts, winners = disjoint_segments([(r["lo"], r["hi"]) for r in best])
        if row["src_ip"] is not None and row["dst_ip"] is not None:
            index[row["src_ip"], row["dst_ip"]] = starts, np.where(winners < 0, -1, winners + len(results))
            results += [tuple(r[c] for c in _RESULT) for r in best]
    shared = packets.sparkSession.sparkContext.broadcast((index, [pa.array([r[i] for r in results], pa.string()) for i in range(3)]))

    @F.arrow_udf("label string, attack_subtype string, target_folder string")
    def find(src: pa.Array, dst: pa.Array, ts: pa.Array) -> pa.Array:
        known, columns = shared.value
        codes = [c.dictionary_encode() for c in (src, dst)]
        a, b = (c.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for c in codes)
        names = [c.dictionary.to_pylist() for c in codes]
        pair, moments = a * (len(names[1]) + 1) + b, ts.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        winner, order = np.full(len(pair), -1, np.int64), np.argsort(pair, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(pair[order])) + 1):
            if not len(part) or a[part[0]] < 0 or b[part[0]] < 0:
                continue
            own = known.get((names[0][a[part[0]]], names[1][b[part[0]]]))
            if own is not None and len(own[0]):
                place = np.searchsorted(own[0], moments[part], "right") - 1
                winner[part] = np.where(place < 0, -1, own[1][place])
        at = pa.array(winner, mask=winner < 0)
        return pa.StructArray.from_arrays([pc.take(c, at) for c in columns], list(_RESULT))

    keys = ["src_ip", "dst_ip"]  # first, as a join has them
    others = [c for c in packets.columns if c not in keys]
    return packets.select(*keys, *others, find(*keys, F.col("ts_us").cast("long")).alias("_hit"))


def label_packets(
    packets: DataFrame,
    schedule: DataFrame,
    policy: str = "priority",
    small_limit: int = SMALL_SIDE_ROWS,
    bucket_us: int = BUCKET_US,
    many_windows: int = MANY_WINDOWS,
) -> DataFrame:
    """Add label, attack_subtype and target_folder to each packet, exactly one result per packet.

    `priority`: the highest priority wins, then the forward pair, then schedule order. `first`: the
    forward pair, then schedule order. Rules ride along as an array per pair, so overlapping windows
    never multiply packets. A schedule of at most `small_limit` rows is broadcast, and where a pair has more than
    `many_windows`, packets find theirs by bisection in disjoint segments instead of trying them all; a larger schedule is joined
    by shuffle on pair and time bucket, which spreads hot pairs of either side. All ways give the same rows.
    """
    if schedule.limit(small_limit + 1).count() <= small_limit:
        rules = rules_by_pair(schedule, policy)
        if (rules.agg(F.max(F.size("rules"))).first()[0] or 0) > many_windows:
            return _with_results(_indexed(packets, rules))
        joined = packets.join(F.broadcast(rules), ["src_ip", "dst_ip"], "left")
    else:
        keyed = packets.withColumn("_bucket", F.floor(F.col("ts_us") / bucket_us))
        joined = keyed.join(rules_by_pair(schedule, policy, bucket_us), ["src_ip", "dst_ip", "_bucket"], "left")
    hit = F.array_max(F.filter("rules", lambda r: F.col("ts_us").between(r["lo"], r["hi"])))
    return _with_results(joined.withColumn("_hit", hit))


def _with_results(hits: DataFrame) -> DataFrame:
    return (
        hits.withColumn("label", F.coalesce(F.col("_hit.label"), F.lit("Benign")))
        .withColumn("attack_subtype", F.coalesce(F.col("_hit.attack_subtype"), F.lit("Benign")))
        .withColumn("target_folder", F.coalesce(F.col("_hit.target_folder"), F.lit(DEFAULT_FOLDER)))
        .drop("rules", "_hit", "_bucket")
    )
