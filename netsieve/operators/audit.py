"""The independent session count: other rules than `sessions`, counts only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from netsieve.operators.sessions import sessionize
from netsieve.schemas import AUDIT_TIMEOUT_S, MAX_PACKETS
from netsieve.session import materialize


def audit_sessions(
    packets: DataFrame,
    segment: Column | None,
    keys: Sequence[str] = ("source_file", "canonical_tuple"),
    order: Sequence[str] = ("packet_no",),
    timeout_s: float = AUDIT_TIMEOUT_S,
    max_packets: int = MAX_PACKETS,
) -> DataFrame:
    """One row (keys, session_instance, label) per counted session.

    A session is counted at its `max_packets`-th packet or when it closes earlier, under the last
    non-Benign label among its first `max_packets` packets. A teardown that is exactly the
    `max_packets`-th packet does not close the session, so the run of packets behind it, up to the
    next boundary, belongs to the same session and is not counted again. Within consecutive such
    runs every second one is swallowed; that parity replaces the packet-by-packet state machine.
    """
    keys = list(keys)
    cut = sessionize(packets, segment, keys, order, timeout_s)
    rank = F.col("packet_rank")
    runs = cut.groupBy(*keys, "session_instance").agg(
        F.count(F.lit(1)).alias("rows"),
        F.max_by("is_teardown", rank).alias("torn_down"),
        F.min_by("ts_us", rank).alias("first_ts"),
        F.max_by("ts_us", rank).alias("last_ts"),
        F.coalesce(
            F.max_by("label", F.when((rank <= max_packets) & (F.col("label") != "Benign"), rank)), F.lit("Benign")
        ).alias("label"),
    )
    # The runs are read four times below and are far fewer than the packets, so they are written once.
    runs = materialize(runs)
    # A run can swallow its successor if it holds exactly max_packets packets, ends in a teardown and
    # no timeout lies between. Only such runs and their successors take part in the parity.
    limit_us = int(round(timeout_s * 1_000_000))
    full = runs.where((F.col("rows") == max_packets) & F.col("torn_down")).select(
        *keys, (F.col("session_instance") + 1).alias("session_instance"), F.col("last_ts").alias("full_last_ts")
    )
    joined = runs.join(full, [*keys, "session_instance"], "left").withColumn(
        "follows_full", F.coalesce(F.col("first_ts") - F.col("full_last_ts") <= limit_us, F.lit(False))
    )
    followers = joined.where("follows_full").select(*keys, "session_instance")
    swallowed = odd_in_streak(followers, keys, "session_instance")
    return joined.join(swallowed, [*keys, "session_instance"], "left_anti").select(
        *keys, "session_instance", "label"
    )


STREAK_BLOCK = 1 << 16


def odd_in_streak(df: DataFrame, keys: Sequence[str], number: str, block: int = STREAK_BLOCK) -> DataFrame:
    """Rows at odd positions (1st, 3rd, ...) of each streak of consecutive `number`s per key.

    Windows cover one block of numbers; streaks that reach across blocks are joined through one row
    per (key, block) holding the block's last streak start and whether it is consecutive to the next.
    """
    keys = list(keys)
    cell = [*keys, "_block"]
    n = F.col(number)
    w = Window.partitionBy(*cell).orderBy(number)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    local = (
        df.withColumn("_block", F.floor(n / F.lit(block)))
        .withColumn("_prev", F.lag(number).over(w))
        .withColumn("_own", F.max(F.when(n - F.col("_prev") > 1, n)).over(upto))
    )
    summary = local.groupBy(*cell).agg(
        F.min(number).alias("lo"), F.max(number).alias("hi"), F.max("_own").alias("last_start")
    )
    k = Window.partitionBy(*keys).orderBy("_block")
    linked = summary.withColumn("_fresh", F.coalesce(F.col("lo") - F.lag("hi").over(k) > 1, F.lit(True)))
    # Start of the streak open at each block's end; blocks that neither start nor break one inherit it.
    start = F.coalesce("last_start", F.when(F.col("_fresh"), F.col("lo")))
    carried = linked.withColumn("_open", F.max(start).over(k.rowsBetween(Window.unboundedPreceding, 0))).select(
        *cell, F.when(F.col("_fresh"), F.col("lo")).otherwise(F.lag("_open").over(k)).alias("_carried")
    )
    return (
        local.join(carried, cell)
        .where((n - F.coalesce("_own", "_carried")) % 2 == 0)
        .select(*keys, number)
    )


def audit_report(counted: DataFrame) -> DataFrame:
    """Counted sessions per label, most frequent first; Benign is listed but is not an attack."""
    return counted.groupBy("label").agg(F.count(F.lit(1)).alias("sessions")).select(
        "label", "sessions", (F.col("label") != "Benign").alias("is_attack")
    ).orderBy("is_attack", F.desc("sessions"), "label")
