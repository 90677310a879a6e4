"""Logical captures: grouping of capture files, pending work, truncation flags and error telemetry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from netsieve.functions import hashing
from netsieve.operators.ordered import broadcast_if_small
from netsieve.schemas import KNOWN_TRUNCATED_CAPTURES

# Fixed file name format of a split capture: base, five-digit index, fourteen-digit time.
CHUNK_NAME = r"^(.+)_chunk_(\d{5})_(\d{14})\.pcap$"


def name_captures(files: DataFrame, path: str = "path") -> DataFrame:
    """Add source_capture, chunk_index and chunk_timestamp (both null for an unsplit file) to each file."""
    name = F.regexp_extract(F.col(path), r"([^/]*)$", 1)
    is_chunk = name.rlike(CHUNK_NAME)
    return files.select(
        "*",
        name.alias("file_name"),
        F.when(is_chunk, F.regexp_extract(name, CHUNK_NAME, 1))
        .otherwise(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))
        .alias("source_capture"),
        F.when(is_chunk, F.regexp_extract(name, CHUNK_NAME, 2).cast("int")).alias("chunk_index"),
        F.when(is_chunk, F.regexp_extract(name, CHUNK_NAME, 3)).alias("chunk_timestamp"),
    )


def _fail(condition: Column, message: Column) -> Column:
    return F.when(condition, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))


def group_captures(files: DataFrame, known_truncated: Sequence[str] = KNOWN_TRUNCATED_CAPTURES) -> DataFrame:
    """One row per logical capture: ordered files, missing chunk numbers, truncation mark.

    A capture present both whole and in chunks, or with a repeated chunk number, stops the query.
    Needs the `name_captures` columns. Repeats collapse first and chunk numbers have five digits, so a list
    holds at most 100,000 files.
    """
    per_chunk = files.groupBy("source_capture", "chunk_index").agg(
        F.min(F.struct("chunk_timestamp", "path")).alias("_file"), F.count(F.lit(1)).alias("_n")
    )
    grouped = per_chunk.groupBy("source_capture").agg(
        F.sort_array(F.collect_list(F.struct("chunk_index", "_file.chunk_timestamp", "_file.path"))).alias("_files"),
        F.count("chunk_index").alias("_chunks"),
        F.count(F.lit(1)).alias("_all"),
        F.max("_n").alias("_repeats"),
    )
    capture = F.col("source_capture")
    sound = _fail(
        (F.col("_chunks") > 0) & (F.col("_chunks") < F.col("_all")),
        F.concat(F.lit("capture present whole and in chunks: "), capture),
    ) & _fail(F.col("_repeats") > 1, F.concat(F.lit("repeated chunk number in "), capture))
    present = F.col("_files.chunk_index")
    missing = F.when(
        F.col("_chunks") > 0,
        F.array_except(F.sequence(F.lit(0), F.array_max(present)), present),
    ).otherwise(F.array().cast("array<int>"))
    return grouped.where(sound).select(
        "source_capture",
        hashing.capture_id(capture).alias("capture_id"),
        hashing.capture_day(capture).alias("capture_day"),
        F.col("_files.path").alias("source_files"),
        missing.alias("missing_chunks"),
        capture.isin(*known_truncated).alias("known_truncated"),
    )


def pending_captures(captures: DataFrame, done: DataFrame) -> DataFrame:
    """Captures without a completion row."""
    return captures.join(done.select("capture_id").distinct(), "capture_id", "left_anti")


def truncated_captures(captures: DataFrame, read_errors: DataFrame) -> DataFrame:
    """Capture-level flag: known list, missing chunks or a reader error. Packet errors do not count."""
    broken = read_errors.select("source_capture").distinct().withColumn("_broken", F.lit(True))
    return captures.join(broken, "source_capture", "left").select(
        "source_capture",
        "source_files",
        (
            F.col("known_truncated")
            | (F.size("missing_chunks") > 0)
            | F.coalesce("_broken", F.lit(False))
        ).alias("source_truncated"),
    )


def flag_sessions(sessions: DataFrame, flags: DataFrame) -> DataFrame:
    """Carry the capture's files and truncation flag to each of its sessions.

    Few captures are expected; the broadcast is checked and a large list joins by shuffle instead.
    """
    small = broadcast_if_small(flags, weight=F.size("source_files") + 1)
    return sessions.join(small, "source_capture", "left").withColumn(
        "source_truncated", F.coalesce("source_truncated", F.lit(False))
    )


def error_key(source_file: Column, kind: Column, message: Column) -> Column:
    """Telemetry key: file, error type and the first 160 characters of the message."""
    name = F.regexp_extract(source_file, r"([^/]*)$", 1)
    return F.concat(name, F.lit(" | "), kind, F.lit(": "), F.substring(message, 1, 160))


def error_summary(errors: DataFrame) -> DataFrame:
    """Error counts per capture and key, from rows (source_capture, error_key)."""
    return errors.groupBy("source_capture", "error_key").agg(F.count(F.lit(1)).alias("n"))


def capture_telemetry(packets_read: DataFrame, errors: DataFrame, flags: DataFrame) -> DataFrame:
    """One row per capture: packets read, packet errors, truncation flag."""
    read = packets_read.groupBy("source_capture").agg(F.count(F.lit(1)).alias("packets_read"))
    failed = errors.groupBy("source_capture").agg(F.count(F.lit(1)).alias("packet_error_count"))
    return (
        flags.select("source_capture", "source_truncated")
        .join(read, "source_capture", "left")
        .join(failed, "source_capture", "left")
        .na.fill(0, ["packets_read", "packet_error_count"])
    )


def capture_completion(captures: DataFrame, sessions: DataFrame, errors: DataFrame, read_errors: DataFrame) -> DataFrame:
    """(capture_id, source_capture, status, sessions, kept, packet_errors, source_truncated, missing_chunks): a row per capture.

    A capture whose reader failed before any session came out is FAILED, one whose reader failed later PARTIAL, others are OK.
    `sessions` are flagged sessions, `errors` rows (source_capture), `read_errors` those of the reader.
    """
    found = sessions.groupBy("source_capture").agg(
        F.count(F.lit(1)).alias("sessions"), F.count_if("kept").alias("kept"), F.bool_or("source_truncated").alias("source_truncated")
    )
    faults = errors.groupBy("source_capture").agg(F.count(F.lit(1)).alias("packet_errors"))
    broken = read_errors.select("source_capture").distinct().withColumn("_broken", F.lit(True))
    joined = captures.select("capture_id", "source_capture", "missing_chunks", "known_truncated")
    for part in (found, faults, broken):
        joined = joined.join(part, "source_capture", "left")
    none = F.coalesce("sessions", F.lit(0)) == 0
    cut = F.col("known_truncated") | (F.size("missing_chunks") > 0) | F.coalesce("_broken", F.lit(False))
    return joined.select(
        "capture_id",
        "source_capture",
        F.when(F.col("_broken").isNull(), "OK").when(none, "FAILED").otherwise("PARTIAL").alias("status"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("sessions", "kept", "packet_errors")],
        F.coalesce("source_truncated", cut).alias("source_truncated"),
        "missing_chunks",
    )


def completion_totals(completion: DataFrame) -> DataFrame:
    """One row of totals over the captures of a run: captures, failed, partial, truncated, captures with missing chunks and these
    chunks, sessions, kept, packet errors."""
    missing = F.size("missing_chunks")
    return completion.agg(
        F.count(F.lit(1)).alias("captures"),
        F.count_if(F.col("status") == "FAILED").alias("failed"),
        F.count_if(F.col("status") == "PARTIAL").alias("partial"),
        F.count_if("source_truncated").alias("truncated"),
        F.count_if(missing > 0).alias("incomplete"),
        F.coalesce(F.sum(missing), F.lit(0)).alias("missing_chunks"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("sessions", "kept", "packet_errors")],
    )
