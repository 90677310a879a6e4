"""The session rules as a stateful stream.

State per key is one open session, as the aggregates from which `build_sessions` makes a record: times, counts, the
first packets and the fixed handful of values that decide the label. The stream emits closed sessions in that form,
so both ways share one definition of a session and of its label. Sessions are numbered when they are read, hence
no counter is kept for a key without open session.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from netsieve.operators.sessions import PACKET_ORDER, SESSION_KEYS, finish_sessions
from netsieve.schemas import KNOWN_ATTACKS, MAX_PACKETS, SESSION_TIMEOUT_S, UNKNOWN_ATTACKS

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

FIELDS = {
    "first_order": "array<bigint>",
    "start_ts_us": "bigint",
    "end_ts_us": "bigint",
    "observed_packets": "bigint",
    "_unknown": "struct<label:string,attack_subtype:string>",
    "_stray": "string",
    **{f"_first_{i}": "bigint" for i in range(len(KNOWN_ATTACKS))},
    **{f"_subtype_{i}": "string" for i in range(len(KNOWN_ATTACKS))},
    "_kept": "array<struct<pos:int,ts_us:bigint,src_ip:string,sport:int,entropy:float,bytes:binary>>",
}
STATE = ", ".join(f"{n} {t}" for n, t in FIELDS.items())
OUTPUT = "source_capture string, canonical_tuple string, " + STATE
NAMES = ["source_capture", "canonical_tuple", *FIELDS]
KEPT = ("pos", "ts_us", "src_ip", "sport", "entropy", "bytes")


#: What is read of a packet, behind the columns of its order.
READ = ("ts_us", "is_teardown", "label", "attack_subtype", "src_ip", "sport", "entropy", "bytes")
ATTACK_AT = {name: i for i, name in enumerate(KNOWN_ATTACKS)}
PLAIN = {None, "Benign", *KNOWN_ATTACKS, *UNKNOWN_ATTACKS}


class Sessionizer(StatefulProcessor):
    """Emits a session at its teardown packet, at the packet after a timeout, or when the watermark passes it.

    Keys have few packets each, so packets are plain tuples and a session is added up packet by packet; a table for each key and
    session costs far more than the packets in it.
    """

    def __init__(self, timeout_s: float, max_packets: int, order: Sequence[str]):
        self.timeout_us = int(round(timeout_s * 1_000_000))
        self.max_packets = max_packets
        self.order = list(order)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        packets = self._ordered(rows)
        state = self._held()
        timer = None if state is None else self._expiry(state)
        closed, ended, at = [], False, len(self.order)
        for packet in packets:
            if state is None or ended or packet[at] - state["end_ts_us"] > self.timeout_us:
                if state is not None:
                    closed.append(state)
                state = {**dict.fromkeys(FIELDS), "first_order": list(packet[:at]), "start_ts_us": packet[at], "observed_packets": 0, "_kept": []}
            self._add(state, *packet[at:])
            ended = bool(packet[at + 1])
        if ended:
            closed.append(state)
            state = None
        self._keep(state, timer)
        return self._rows(key, closed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, closed = self._held(), []
        if state is not None and timerValues.getCurrentWatermarkInMs() * 1000 > state["end_ts_us"] + self.timeout_us:
            closed.append(state)
            self.open.clear()
        return self._rows(key, closed)

    def close(self) -> None:
        pass

    def _ordered(self, tables: Iterator[pd.DataFrame]) -> list[tuple]:
        """Packets in their order: the values of `order`, then those of READ."""
        columns, at = (*self.order, *READ), len(self.order)
        packets = [p for t in tables for p in zip(*[t[c].tolist() for c in columns])]
        return sorted(packets, key=lambda p: p[:at])

    def _held(self) -> dict | None:
        """The open session of the key, with its packets as tuples."""
        if not self.open.exists():
            return None
        state = dict(zip(FIELDS, self.open.get()))
        return {**state, "_kept": [tuple(p) for p in state["_kept"]], "_unknown": state["_unknown"] and tuple(state["_unknown"])}

    def _expiry(self, state: dict) -> int:
        return (state["end_ts_us"] + self.timeout_us) // 1000 + 1

    def _keep(self, state: dict | None, timer: int | None) -> None:
        """Put the open session, whose timer is the only one of its key, in the place of the one before."""
        after = None if state is None else self._expiry(state)
        if timer is not None and timer != after:
            self.handle.deleteTimer(timer)
        if state is not None:
            self.open.update(tuple(state[n] for n in FIELDS))
            self.handle.registerTimer(after)
        elif timer is not None:
            self.open.clear()

    def _add(self, state: dict, ts, torn, label, subtype, src_ip, sport, entropy, payload) -> None:
        """Put a packet behind those of a session."""
        state["end_ts_us"] = ts
        state["observed_packets"] += 1
        place = state["observed_packets"]
        known = ATTACK_AT.get(label)
        if known is not None:
            if state[f"_first_{known}"] is None:
                state[f"_first_{known}"] = place
            if subtype is not None and subtype != "Benign":
                state[f"_subtype_{known}"] = subtype
        elif label in UNKNOWN_ATTACKS:
            state["_unknown"] = (label, subtype)
        elif label not in PLAIN and (state["_stray"] is None or label > state["_stray"]):
            state["_stray"] = label
        if place <= self.max_packets:
            state["_kept"].append((place, ts, src_ip, sport, entropy, payload))

    def _rows(self, key, sessions: list[dict]) -> Iterator[pd.DataFrame]:
        rows = []
        for s in sessions:
            unknown = s["_unknown"] and dict(zip(("label", "attack_subtype"), s["_unknown"]))
            rows.append((*key, *({**s, "_unknown": unknown, "_kept": [dict(zip(KEPT, p)) for p in s["_kept"]]}[n] for n in FIELDS)))
        if rows:
            yield pd.DataFrame(rows, columns=NAMES)


def sessionize_stream(
    packets: DataFrame,
    lateness: str,
    timeout_s: float = SESSION_TIMEOUT_S,
    max_packets: int = MAX_PACKETS,
    order: Sequence[str] = PACKET_ORDER,
) -> DataFrame:
    """Closed sessions of a labelled packet stream, as aggregates; `numbered_sessions` makes records of them.

    `lateness` is how far a packet may lag behind the latest time seen. Later ones cannot be placed; they are counted, see
    `run_available`. A key is handled by one task per trigger: the source's limit per trigger bounds its rows.
    """
    timed = packets.withColumn("event_time", F.timestamp_micros("ts_us")).withWatermark("event_time", lateness)
    used = [*SESSION_KEYS, *order, "ts_us", "event_time", "src_ip", "sport", "label", "attack_subtype", "is_teardown", "entropy", "bytes"]
    return (
        timed.select(*dict.fromkeys(used))
        .groupBy(*SESSION_KEYS)
        .transformWithStateInPandas(
            statefulProcessor=Sessionizer(timeout_s, max_packets, order),
            outputStructType=StructType.fromDDL(OUTPUT),
            outputMode="Append",
            timeMode="EventTime",
        )
    )


NOTE_EVERY_S = 0.5


@dataclass
class StreamRun:
    """Closed sessions, those still open in the state, and the number of packets that came too late."""

    closed: DataFrame
    open: DataFrame
    late_packets: int


def run_available(spark: SparkSession, sessions: DataFrame, out: str, checkpoint: str) -> StreamRun:
    """Process what the source holds now. The open sessions are read from the state, which keeps them for the next run."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, STATE_STORE)
    try:
        stream = (
            sessions.writeStream.format("parquet")
            .option("path", out)
            .option("checkpointLocation", checkpoint)
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        late: dict[int, int] = {}
        ended = False
        while not ended:  # only the last triggers are kept by the stream, so they are noted while it runs
            ended = stream.awaitTermination(NOTE_EVERY_S)
            for p in stream.recentProgress:
                late[p["batchId"]] = sum(op["numRowsDroppedByWatermark"] for op in p["stateOperators"])
        state = spark.read.format("statestore").option("stateVarName", "open").load(checkpoint)
        names = SESSION_KEYS
        opened = state.select(*[F.col(f"key.{n}").alias(n) for n in names], "value.*").select(*NAMES)
    finally:
        spark.conf.set(key, before)
    return StreamRun(spark.read.schema(OUTPUT).parquet(out), opened, sum(late.values()))


def numbered_sessions(
    sessions: DataFrame, timeout_s: float = SESSION_TIMEOUT_S, max_packets: int = MAX_PACKETS
) -> DataFrame:
    """Session records, numbered from 1 within their key in the order of their first packets."""
    place = F.row_number().over(Window.partitionBy(*SESSION_KEYS).orderBy("first_order"))
    return finish_sessions(sessions.withColumn("session_instance", place).drop("first_order"), timeout_s, max_packets)
