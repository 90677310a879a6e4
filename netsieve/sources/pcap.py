"""Capture files as a Spark table, read in ranges.

A capture has no marks between records. A first pass indexes ranges of a file in parallel: the task of a range looks for the first
place that begins a chain of plausible record headers, hops from record to record until its range ends, and notes where it
began, where the next record begins, and how many it met. A range is confirmed if it began where the one before it ended; else, as
where frames look like records, it is hopped through again from there, up to a range that agrees. What results is what one hop
through the whole file gives. `spark.read.format("capture_index").load(glob)` is this pass: a row per range. The second pass
reads the ranges, spread over the cluster whatever file they are from.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from netsieve.operators.captures import name_captures
from netsieve.schemas import PACKETS
from netsieve.session import stage_table
from netsieve.sources.digests import arrow_uri

# Fixed format: magic number -> (byte order, fraction digits per microsecond).
MAGICS = {
    b"\xd4\xc3\xb2\xa1": ("<", 1),
    b"\xa1\xb2\xc3\xd4": (">", 1),
    b"\x4d\x3c\xb2\xa1": ("<", 1000),
    b"\xa1\xb2\x3c\x4d": (">", 1000),
}
FILE_HEADER = 24
RECORD_HEADER = 16
BATCH_ROWS = 4096

RANGE_BYTES = 32 << 20
TASK_BYTES = 16 << 20
BUFFER_BYTES = 1 << 20

FRAME = "source_file string, packet_no bigint, ts_us bigint, frame binary, read_error string"
FRAME_SCHEMA = pa.schema(
    [
        ("source_file", pa.string()),
        ("packet_no", pa.int64()),
        ("ts_us", pa.int64()),
        ("frame", pa.binary()),
        ("read_error", pa.string()),
    ]
)
#: Of a range: its number in the file, where it may begin and end, where its first record and the next one after it begin (the first is
#: -1 if none was found), and its packets.
RANGE = "source_file string, part bigint, low bigint, high bigint, size bigint, start bigint, stop bigint, packets bigint, magic string, read_error string"
RANGE_SCHEMA = pa.schema(
    [
        ("source_file", pa.string()),
        *[(c, pa.int64()) for c in ("part", "low", "high", "size", "start", "stop", "packets")],
        ("magic", pa.string()),
        ("read_error", pa.string()),
    ]
)
#: So many headers in a row make a place plausible; a record holds no more bytes than this; and its time lies within a year of
#: the first one's.
CHAIN = 6
LONGEST_RECORD = 1 << 18
CLOSE_S = 366 * 86_400


@dataclass
class CaptureRange(InputPartition):
    """Ranges of a file that follow on each other, (part, low, high) each."""

    uri: str
    size: int
    ranges: list[tuple[int, int, int]]


class Capture:
    """The records of an open capture file: hopping over them, and finding them from any place on."""

    def __init__(self, stream, size: int):
        self.stream, self.size, self.held, self.held_at = stream, size, b"", 0
        head = stream.read(FILE_HEADER)
        self.magic = bytes(head[:4]).hex() if len(head) == FILE_HEADER and bytes(head[:4]) in MAGICS else None
        if self.magic:
            order, per_us = MAGICS[bytes(head[:4])]
            self.header, self.fractions = struct.Struct(order + "IIII").unpack_from, per_us * 1_000_000
            self.first_s = self.header(self.at(FILE_HEADER))[0] if size >= FILE_HEADER + RECORD_HEADER else 0

    def at(self, place: int, n: int = RECORD_HEADER) -> bytes:
        """`n` bytes from `place` on, fewer at the end."""
        if not (self.held_at <= place and place + n <= self.held_at + len(self.held)):
            self.stream.seek(place)
            self.held, self.held_at = self.stream.read(max(n, BUFFER_BYTES)), place
        return self.held[place - self.held_at : place - self.held_at + n]

    def plausible(self, place: int) -> bool:
        """Whether a chain of headers begins here: CHAIN of them, or fewer up to the end of the file."""
        for _ in range(CHAIN):
            if place == self.size:
                return True
            if place + RECORD_HEADER > self.size:
                return False
            seconds, fraction, stored, whole = self.header(self.at(place))
            if fraction >= self.fractions or not stored <= whole <= LONGEST_RECORD or abs(seconds - self.first_s) > CLOSE_S:
                return False
            place += RECORD_HEADER + stored
            if place > self.size:
                return False
        return True

    def resync(self, low: int, high: int) -> int:
        """The first plausible place in [low, high), -1 without one."""
        return next((p for p in range(low, min(high, self.size)) if self.plausible(p)), -1)

    def hop(self, start: int, high: int) -> tuple[int, int, str | None]:
        """(where the first record from `high` on begins, packets before it, error of a broken tail)."""
        at = start
        count = 0
        while at < min(high, self.size):
            if at + RECORD_HEADER > self.size:
                return at, count, "NeedData: truncated record header"
            stored = self.header(self.at(at))[2]
            if at + RECORD_HEADER + stored > self.size:
                return at, count, "NeedData: truncated record"
            at += RECORD_HEADER + stored
            count += 1
        return at, count, None


def index_range(stream, uri: str, part: int, low: int, high: int, size: int, start: int | None = None) -> tuple:
    """The RANGE row of a part of a file; without a known `start` its records are looked for."""
    capture = Capture(stream, size)
    if capture.magic is None:
        return uri, part, low, high, size, 0, 0, 0, "", "ValueError: invalid capture header" if part == 0 else None
    if start is None:
        start = FILE_HEADER if part == 0 else capture.resync(low, high)
    if start < 0:
        return uri, part, low, high, size, -1, -1, 0, capture.magic, None
    stop, packets, error = capture.hop(start, high)
    return uri, part, low, high, size, start, stop, packets, capture.magic, error


def read_range(stream, start: int, stop: int, magic: str) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(ts_us, frames) of the records from `start` up to `stop`, which both are between records, up to BATCH_ROWS at a time.

    Only lengths are read record by record; headers and frames of the rest are cut out together.
    """
    order, per_us = MAGICS[bytes.fromhex(magic)]
    length = struct.Struct(order + "I").unpack_from
    stream.seek(start)
    rest, left, want = b"", stop - start, BUFFER_BYTES
    while left:
        more = stream.read(min(left, want))
        if not more:
            raise EOFError("the capture is shorter than when it was indexed")
        left, want = left - len(more), BUFFER_BYTES
        data, at, places = rest + more, 0, [0]
        while at + RECORD_HEADER <= len(data):
            end = at + RECORD_HEADER + length(data, at + 8)[0]
            if end > len(data):
                want = max(BUFFER_BYTES, end - len(data))  # fetch a long record in one go
                break
            places.append(end)
            at = end
        rest = data[at:]
        held, raw = np.frombuffer(data, np.uint8), pa.py_buffer(data)
        for k in range(0, len(places) - 1, BATCH_ROWS):
            cuts = np.array(places[k : k + BATCH_ROWS + 1], np.int64)
            heads = held[cuts[:-1, None] + np.arange(8)].view(order + "u4").astype(np.int64)
            pieces = np.empty(2 * len(cuts) - 1, np.int64)
            pieces[::2], pieces[1::2] = cuts, cuts[:-1] + RECORD_HEADER
            both = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(pieces) - 1, [None, pa.py_buffer(pieces), raw])
            frames = both.take(pa.array(np.arange(1, len(pieces), 2))).cast(pa.binary())
            yield heads[:, 0] * 1_000_000 + np.rint(heads[:, 1] / per_us).astype(np.int64), frames


class IndexReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def partitions(self) -> list[InputPartition]:
        folder, _, pattern = self.path.rpartition("/")
        names = None
        if not any(ch in pattern for ch in "*?"):
            fs, root = pafs.FileSystem.from_uri(self.path)
            info = fs.get_file_info(root)
            if info.type == pafs.FileType.File:
                names = [(self.path, info.size)]
            folder, pattern = self.path.rstrip("/"), "*.pcap"
        if names is None:
            fs, root = pafs.FileSystem.from_uri(folder)
            prefix = folder[: len(folder) - len(root)] if folder.endswith(root) else ""
            found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
            names = sorted((prefix + f.path, f.size) for f in found if f.is_file and fnmatch(f.base_name, pattern))
        step = max(self.range_bytes, RECORD_HEADER)
        # Small ranges share a task, which costs more than a range of them.
        together = max(1, TASK_BYTES // step)
        tasks = []
        for name, size in names:
            ranges = [(part, low, min(low + step, max(size, 1))) for part, low in enumerate(range(0, max(size, 1), step))]
            tasks += [CaptureRange(name, size, ranges[k : k + together]) for k in range(0, len(ranges), together)]
        return tasks

    def read(self, partition: CaptureRange) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(partition.uri)
        rows = []
        with fs.open_input_file(path) as stream:
            for part, low, high in partition.ranges:
                stream.seek(0)
                rows.append(index_range(stream, partition.uri, part, low, high, partition.size))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), RANGE_SCHEMA.types)], schema=RANGE_SCHEMA)


class CaptureIndex(DataSource):
    """Ranges of capture files, a task for each or for small ones together, as they were found; `confirmed_ranges` makes them agree."""

    @classmethod
    def name(cls) -> str:
        return "capture_index"

    def schema(self) -> str:
        return RANGE

    def reader(self, schema: StructType) -> DataSourceReader:
        return IndexReader(arrow_uri(self.options["path"]), int(self.options.get("range_bytes", RANGE_BYTES)))


def _again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (RANGE, begin, later): the first range of a file that does not agree, and those after it. Ranges are hopped through again
    where they do not begin at the end of the one before; the others are left as they are."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            fs, path = pafs.FileSystem.from_uri(r["source_file"])
            with fs.open_input_file(path) as stream:
                begin = r["begin"]
                for part in [r, *r["later"]]:
                    if part["start"] == begin:
                        begin, error = part["stop"], part["read_error"]
                    else:
                        stream.seek(0)
                        rows.append(index_range(stream, r["source_file"], part["part"], part["low"], part["high"], r["size"], begin))
                        begin, error = rows[-1][6], rows[-1][9]
                    if error:
                        break
        columns = list(zip(*rows)) if rows else [[] for _ in RANGE_SCHEMA]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, RANGE_SCHEMA.types)], schema=RANGE_SCHEMA)


def confirmed_ranges(found: DataFrame) -> DataFrame:
    """(source_file, start, stop, first_packet, magic, read_error): ranges that follow on each other, from those that were found.

    Ranges behind a broken record go. Most files need no mending; else one task walks along the ranges of a file and hops only through
    those that do not agree. Windows hold the ranges of a file, a row for each.
    """
    ranges = stage_table(found, "capture-ranges")
    in_file = Window.partitionBy("source_file").orderBy("part")
    while True:
        linked = ranges.withColumn("begin", F.lag("stop").over(in_file)).withColumn(
            "dead", F.coalesce(F.max(F.col("read_error").isNotNull()).over(in_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
        )
        live = linked.where(~F.col("dead")).drop("dead")
        odd = live.where(F.col("start") != F.col("begin"))
        first = odd.groupBy("source_file").agg(F.min("part").alias("first"))
        later = F.filter("parts", lambda p: p["part"] > F.col("part"))
        parts = live.groupBy("source_file").agg(F.sort_array(F.collect_list(F.struct("part", "low", "high", "start", "stop", "read_error"))).alias("parts"))
        work = odd.join(first, "source_file").where("part = first").join(parts, "source_file").withColumn("later", later)
        work = work.select(*ranges.columns, "begin", "later")
        if work.isEmpty():
            break
        mended = stage_table(work.repartition("source_file").mapInArrow(_again, RANGE), "mended-ranges")
        rest = ranges.join(mended, ["source_file", "part"], "left_anti")
        ranges = stage_table(rest.unionByName(mended), "capture-ranges")
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    counted = live.withColumn("first_packet", F.coalesce(F.sum("packets").over(before), F.lit(0)))
    used = counted.where("stop > start OR read_error IS NOT NULL")
    return used.select("source_file", "start", "stop", "first_packet", "magic", "read_error")


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch_of(uri: str, number: int, ts: pa.Array, frames: pa.Array, error: str | None) -> pa.RecordBatch:
        n = len(frames)
        numbers = pa.array(np.arange(number, number + n, dtype=np.int64))
        return pa.RecordBatch.from_arrays([pa.array([uri] * n, pa.string()), numbers, ts, frames, pa.array([error] * n, pa.string())], schema=FRAME_SCHEMA)

    for batch in batches:
        for r in batch.to_pylist():
            uri, number = r["source_file"], r["first_packet"]
            if r["stop"] > r["start"]:
                fs, path = pafs.FileSystem.from_uri(uri)
                with fs.open_input_file(path) as stream:
                    for ts, frames in read_range(stream, r["start"], r["stop"], r["magic"]):
                        yield batch_of(uri, number, pa.array(ts), frames, None)
                        number += len(ts)
            if r["read_error"]:
                yield batch_of(uri, number, pa.array([None], pa.int64()), pa.array([None], pa.binary()), r["read_error"])


def read_captures(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """FRAME rows of capture files: a file, or all *.pcap below a folder, or a pattern of names."""
    spark.dataSource.register(CaptureIndex)
    ranges = confirmed_ranges(spark.read.format("capture_index").option("range_bytes", range_bytes).load(path))
    tasks = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return ranges.repartition(tasks, "source_file", "start").mapInArrow(_frames, FRAME)


def _records(ts_us: pa.Array, frames: pa.Array) -> pa.Buffer:
    """Frames behind their record headers, as they stand in a file."""
    if ts_us.null_count or frames.null_count:
        raise ValueError("a packet without time or frame")
    ts, frames = ts_us.to_numpy(zero_copy_only=False), frames.cast(pa.large_binary())
    heads = np.empty((len(ts), 4), np.int64)
    heads[:, 0], heads[:, 1] = ts // 1_000_000, ts % 1_000_000
    heads[:, 2] = heads[:, 3] = pc.binary_length(frames).to_numpy(zero_copy_only=False)
    if heads.min() < 0 or heads.max() >= 1 << 32:
        raise ValueError("a time or length beyond 32 bits")
    head = pa.FixedSizeBinaryArray.from_buffers(pa.binary(RECORD_HEADER), len(ts), [None, pa.py_buffer(heads.astype("<u4").tobytes())])
    joined = pc.binary_join_element_wise(head.cast(pa.large_binary()), frames, pa.scalar(b"", pa.large_binary()))
    first, last = (int(np.frombuffer(joined.buffers()[1], np.int64)[joined.offset + k]) for k in (0, len(joined)))
    return joined.buffers()[2].slice(first, last - first)


def write_captures(frames: DataFrame, path: str) -> DataFrame:
    """(source_file, packets): rows (ts_us, frame) as capture files below `path`, one from each task, in its order."""
    folder = arrow_uri(path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{folder}/part_{TaskContext.get().partitionId():05d}.pcap"
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        count = 0
        with fs.open_output_stream(pafs.FileSystem.from_uri(name)[1]) as out:
            out.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 0xFFFF, 1))
            for batch in batches:
                if batch.num_rows:
                    out.write(_records(batch.column("ts_us"), batch.column("frame")))
                count += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count])], ["source_file", "packets"])

    rows = frames.select("ts_us", "frame").mapInArrow(write, "source_file string, packets bigint").collect()  # one a task
    return frames.sparkSession.createDataFrame(rows, "source_file string, packets bigint")


def read_packets(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The packet table from Parquet, or from capture files with names resolved to captures and chunks."""
    if fmt == "parquet":
        return spark.read.schema(PACKETS).parquet(path)
    if fmt != "capture":
        raise ValueError(f"unknown packet format {fmt!r}")
    named = name_captures(read_captures(spark, path), "source_file")
    return named.select(
        "source_file",
        "source_capture",
        F.coalesce("chunk_index", F.lit(0)).alias("chunk_index"),
        "packet_no",
        "ts_us",
        "frame",
        "read_error",
    )

