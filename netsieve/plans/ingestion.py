"""Captures to labelled, routed and sampled sessions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from netsieve.functions.packets import anonymised_prefix, canonical_tuple
from netsieve.operators import captures as caps
from netsieve.operators.ordered import broadcast_if_small
from netsieve.operators.schedule import label_packets
from netsieve.operators.sessions import (
    SEGMENT_PACKETS,
    build_sessions,
    identify,
    packet_segment,
    retain,
    sessionize,
)
from netsieve.schemas import MAX_PACKETS, RETENTION_RATES, SESSION_TIMEOUT_S, SPLIT_RATIOS
from netsieve.session import stage_table
from netsieve.sources.completion import append_completion, done_captures, read_log
from netsieve.sources.headers import decode_headers
from netsieve.sources.sessions import write_sessions


@dataclass
class Ingestion:
    sessions: DataFrame
    errors: DataFrame
    flags: DataFrame
    completion: DataFrame
    #: The packets that could not be read or decoded, and those among them that their reader gave up at.
    error_rows: DataFrame
    errors_read: DataFrame


def narrow_packets(decoded: DataFrame) -> DataFrame:
    """The columns a session or an error report needs. Decoding already reduced a frame to its entropy and
    its head, so raw frames never reach a shuffle."""
    return decoded.select(
        "source_capture",
        "source_file",
        "chunk_index",
        "packet_no",
        "ts_us",
        "src_ip",
        "sport",
        "dst_ip",
        "is_teardown",
        canonical_tuple(*[F.col(c) for c in ("src_ip", "sport", "dst_ip", "dport", "proto")]).alias("canonical_tuple"),
        F.col("entropy").cast("float").alias("entropy"),
        anonymised_prefix(F.col("head"), F.col("ip_offset"), F.col("ip_version")).alias("bytes"),
        F.col("read_error").isNotNull().alias("is_read_error"),
        F.coalesce("read_error", "decode_error").alias("error"),
    )


def ingest(
    packets: DataFrame,
    captures: DataFrame,
    schedule: DataFrame,
    timeout_s: float = SESSION_TIMEOUT_S,
    max_packets: int = MAX_PACKETS,
    ratios: dict[str, float] = SPLIT_RATIOS,
    rates: dict[str, dict[str, float]] = RETENTION_RATES,
    segment_packets: int = SEGMENT_PACKETS,
) -> Ingestion:
    """All sessions with a `kept` flag, the error rows and the capture flags.

    `packets` follow the packet schema; `captures` is the output of `group_captures`, already reduced to
    the pending ones.
    """
    wanted = packets.join(broadcast_if_small(captures.select("source_capture")), "source_capture", "left_semi")
    decoded = decode_headers(wanted, extras=("entropy", "head"))
    # The raw frames are read once; sessions, flags and errors all read the narrow table.
    packets_table = stage_table(label_packets(narrow_packets(decoded), schedule), "packets")
    errors = packets_table.where("error is not null")
    cut = sessionize(packets_table.where("error is null"), packet_segment(segment_packets), timeout_s=timeout_s)
    flags = caps.truncated_captures(captures, errors.where("is_read_error"))
    built = retain(identify(build_sessions(cut, timeout_s=timeout_s, max_packets=max_packets), ratios), rates)
    sessions = caps.flag_sessions(built, flags)
    kind, message = F.substring_index("error", ": ", 1), F.regexp_replace("error", "^[^:]*: ", "")
    keyed = errors.select("source_capture", caps.error_key(F.col("source_file"), kind, message).alias("error_key"))
    completion = caps.capture_completion(captures, sessions, errors, errors.where("is_read_error"))
    return Ingestion(sessions, keyed, flags, completion, errors, errors.where("is_read_error"))


@dataclass
class IngestRun:
    """What a run did: its number in the log, the rows it added there, and their totals."""

    number: int | None
    completion: DataFrame
    totals: DataFrame


def run_ingestion(packets: DataFrame, captures: DataFrame, schedule: DataFrame, store: str, log: str, run: str, **settings) -> IngestRun:
    """Ingest the captures that the log does not know as done, and log them.

    Sessions are computed once, into the shared folder; kept ones replace those of their captures in the store by one commit,
    which also withdraws what failed captures had there, and then the log gets a row for each capture. Broken off anywhere, a
    run is made good by the next one: no commit shows half a run, and a capture without a row is taken again.
    """
    spark = packets.sparkSession
    pending = stage_table(caps.pending_captures(captures, done_captures(read_log(spark, log))), "pending")
    if pending.isEmpty():
        none = read_log(spark, log).limit(0)
        return IngestRun(None, none, caps.completion_totals(none))
    result = ingest(packets, pending, schedule, **settings)
    sessions = stage_table(result.sessions, "sessions")
    failures = result.errors_read
    completion = stage_table(caps.capture_completion(pending, sessions, result.error_rows, failures), "completion")
    write_sessions(sessions.where("kept"), store, pending)
    return IngestRun(append_completion(completion, log, run), completion, caps.completion_totals(completion))
