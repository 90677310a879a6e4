"""Header decoding of raw frames.

Spark has no integer-at-offset function for binary columns. A version from `hex`, `substr` and `conv`
took over half a millisecond of processor time per frame, since every later filter repeats the nested
offsets; the numpy helper here reads the same fields of a whole Arrow batch at once.
"""

from __future__ import annotations

import socket
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import (
    BinaryType,
    BooleanType,
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
)

from netsieve.functions.packets import HEAD_BYTES, entropy_of_batch

# Fixed protocol numbers.
ETHERNET_HEADER = 14
TYPE_IPV4 = 0x0800
TYPE_IPV6 = 0x86DD
TYPES_VLAN = (0x8100, 0x88A8, 0x9100)
PROTO_TCP = 6
PROTO_UDP = 17
EXTENSION_HEADERS = (0, 43, 44, 51, 60)
FRAGMENT_HEADER = 44
AUTH_HEADER = 51
FLAG_FIN = 0x01
FLAG_RST = 0x04

BASE_FIELDS = (
    ("ip_offset", IntegerType()),
    ("ip_version", IntegerType()),
    ("decode_error", StringType()),
    ("src_ip", StringType()),
    ("dst_ip", StringType()),
    ("sport", IntegerType()),
    ("dport", IntegerType()),
    ("proto", IntegerType()),
    ("is_teardown", BooleanType()),
)
EXTRA_FIELDS = {"payload": BinaryType(), "entropy": DoubleType(), "head": BinaryType()}


class Frames:
    """Field access over the bytes of one batch; reads past the end of a frame give 0."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)
        self.offsets = offsets[column.offset : column.offset + len(column) + 1]
        self.data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
        self.base, self.length = self.offsets[:-1], np.diff(self.offsets)

    def number(self, at, size: int) -> np.ndarray:
        at = np.broadcast_to(np.asarray(at, dtype=np.int64), self.length.shape)
        out = np.zeros(len(self.length), dtype=np.int64)
        inside = (at >= 0) & (at + size <= self.length)
        start = self.base[inside] + at[inside]
        value = np.zeros(len(start), dtype=np.int64)
        for i in range(size):
            value = (value << 8) | self.data[start + i]
        out[inside] = value
        return out

    def cut(self, start: np.ndarray, size: np.ndarray, keep: np.ndarray) -> pa.Array:
        """Binary column of `size` bytes from `start` of each frame, null where `keep` is false."""
        size = np.where(keep, size, 0)
        ends = np.concatenate([[0], np.cumsum(size)])
        index = np.repeat(self.base + start - ends[:-1], size) + np.arange(ends[-1])
        buffers = [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(self.data[index].tobytes())]
        column = pa.Array.from_buffers(pa.large_binary(), len(size), buffers).cast(pa.binary())
        return pc.if_else(pa.array(keep), column, pa.scalar(None, pa.binary()))

    def addresses(self, at: np.ndarray, v4: np.ndarray, v6: np.ndarray) -> np.ndarray:
        """Address texts, formatted once per distinct address of the batch."""
        out = np.full(len(self.length), None, dtype=object)
        for mine, size, family in ((v4, 4, socket.AF_INET), (v6, 16, socket.AF_INET6)):
            rows = np.flatnonzero(mine & (at + size <= self.length))
            if len(rows):
                raw = self.data[(self.base[rows] + at[rows])[:, None] + np.arange(size)]
                distinct, where = np.unique(raw, axis=0, return_inverse=True)
                names = np.array([socket.inet_ntop(family, a.tobytes()) for a in distinct], dtype=object)
                out[rows] = names[where.ravel()]
        return out


def decode_batch(frames: Frames, with_ports_only: bool, extras: Sequence[str]) -> tuple[dict[str, pa.Array], np.ndarray]:
    """Decoded columns of a batch and the mask of the rows to keep."""
    at, kind = np.full(len(frames.length), ETHERNET_HEADER), frames.number(12, 2)
    # Each tag moves on by four bytes, and reads past the end give 0, so the length of the frame ends the walk.
    while (tagged := np.isin(kind, TYPES_VLAN)).any():
        at = at + 4 * tagged
        kind = frames.number(at - 2, 2)
    short = frames.length < ETHERNET_HEADER
    v4, v6 = ~short & (kind == TYPE_IPV4), ~short & (kind == TYPE_IPV6)

    # A later fragment carries no transport header, so its proto number comes without ports.
    portless = v4 & ((frames.number(at + 6, 2) & 0x1FFF) > 0)
    proto = frames.number(at + np.where(v4, 9, 6), 1)
    pos = np.where(v4, at + (frames.number(at, 1) & 0x0F) * 4, at + 40)
    # Every extension header has eight bytes at least, and one that goes over the end stops its frame.
    while (walk := v6 & ~portless & np.isin(proto, EXTENSION_HEADERS)).any():
        units, fragment = frames.number(pos + 1, 1), proto == FRAGMENT_HEADER
        size = np.where(fragment, 8, np.where(proto == AUTH_HEADER, (units + 2) * 4, (units + 1) * 8))
        portless |= walk & ((fragment & (frames.number(pos + 2, 2) >> 3 > 0)) | (pos + 8 > frames.length))
        proto = np.where(walk, frames.number(pos, 1), proto)
        pos = np.where(walk, pos + size, pos)

    # IPv4 announces its whole length, IPv6 its payload; zero means up to the end of the frame.
    announced = np.where(v4, frames.number(at + 2, 2), frames.number(at + 4, 2))
    end = np.where(
        announced == 0, frames.length, np.minimum(at + announced + np.where(v4, 0, 40), frames.length)
    )
    tcp, ported = proto == PROTO_TCP, (v4 | v6) & ~portless & np.isin(proto, (PROTO_TCP, PROTO_UDP))
    smallest = np.where(tcp, 20, 8)
    data_at = pos + np.where(tcp, (frames.number(pos + 12, 1) >> 4) * 4, 8)
    cut_network = (v4 | v6) & (frames.length < at + np.where(v4, 20, 40))
    cut_transport = ported & ((pos + smallest > end) | (data_at < pos + smallest) | (data_at > end))
    error = np.select(
        [short, cut_network, cut_transport],
        ["NeedData: short link header", "NeedData: short network header", "NeedData: short transport header"],
        "",
    )
    failed = error != ""
    sound = ported & ~failed

    def ints(values: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
        return pa.array(values.astype(np.int32), mask=None if valid is None else ~valid)

    size = np.maximum(end - data_at, 0)
    flags = frames.number(pos + 13, 1)
    columns = {
        "ip_offset": ints(at),
        "ip_version": ints(np.where(v4, 4, 6), v4 | v6),
        "decode_error": pa.array(error.astype(object), mask=~failed, type=pa.string()),
        "src_ip": pa.array(frames.addresses(at + np.where(v4, 12, 8), v4, v6), type=pa.string()),
        "dst_ip": pa.array(frames.addresses(at + np.where(v4, 16, 24), v4, v6), type=pa.string()),
        "sport": ints(np.where(sound, frames.number(pos, 2), 0)),
        "dport": ints(np.where(sound, frames.number(pos + 2, 2), 0)),
        "proto": ints(proto, v4 | v6),
        "is_teardown": pa.array(sound & tcp & (flags & (FLAG_FIN | FLAG_RST) != 0)),
    }
    if "payload" in extras or "entropy" in extras:
        payload = frames.cut(data_at, size, sound)
        columns["payload"] = payload
        if "entropy" in extras:
            columns["entropy"] = entropy_of_batch(payload.fill_null(b""))
    if "head" in extras:
        columns["head"] = frames.cut(np.zeros_like(at), np.minimum(frames.length, HEAD_BYTES), ~short)
    return columns, failed | (ported if with_ports_only else (v4 | v6))


def decode_headers(
    df: DataFrame, frame: str = "frame", with_ports_only: bool = True, extras: Sequence[str] = ("payload",)
) -> DataFrame:
    """Replace the frame by its addresses, ports, proto, is_teardown, ip_offset, ip_version, decode_error.

    `extras` may add the transport payload, its byte entropy, and the head of the frame for
    `anonymised_prefix`. Frames without IP, and with `with_ports_only` those without TCP or UDP, are
    dropped; the audit keeps other protocols with ports 0. Frames too short for the headers they announce
    stay with a `decode_error` for the error table.
    """
    at = df.columns.index(frame)
    kept = [c for c in df.columns if c != frame]
    names = [n for n, _ in BASE_FIELDS] + list(extras)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns, wanted = decode_batch(Frames(batch.column(at)), with_ports_only, extras)
                others = [batch.column(batch.schema.get_field_index(c)) for c in kept]
                out = pa.RecordBatch.from_arrays(others + [columns[n] for n in names], names=[*kept, *names])
                yield out.filter(pa.array(wanted))

    fields = [StructField(n, t) for n, t in BASE_FIELDS] + [StructField(n, EXTRA_FIELDS[n]) for n in extras]
    return df.mapInArrow(run, StructType([df.schema[c] for c in kept] + fields))
