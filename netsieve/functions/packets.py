"""Per-packet columns: endpoint key, entropy, anonymised prefix, time encoding."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

from netsieve.schemas import MAX_BYTES, SESSION_TIMEOUT_S

# Enough for the stored prefix and for all address bytes, so that overlays never lengthen the prefix.
HEAD_BYTES = MAX_BYTES + 64


def canonical_tuple(src: Column, sport: Column, dst: Column, dport: Column, proto: Column) -> Column:
    """Direction-free key: the smaller (address text, port) endpoint first."""
    keep = F.struct(src.alias("ip"), sport.alias("port")) <= F.struct(dst.alias("ip"), dport.alias("port"))
    return F.when(keep, F.concat_ws("-", src, dst, sport, dport, proto)).otherwise(
        F.concat_ws("-", dst, src, dport, sport, proto)
    )


def encode_delta(delta_s: Column, timeout_s: float = SESSION_TIMEOUT_S) -> Column:
    """Inter-packet time clipped to [0, timeout] on a log scale of 0..255."""
    clipped = F.least(F.greatest(delta_s, F.lit(0.0)), F.lit(float(timeout_s)))
    return F.lit(255.0) * F.log1p(clipped) / F.lit(math.log1p(float(timeout_s)))


def entropy_of_batch(payload: pa.Array) -> pa.Array:
    payload = payload.cast(pa.large_binary())
    offsets = np.frombuffer(payload.buffers()[1], dtype=np.int64)[payload.offset : payload.offset + len(payload) + 1]
    data = np.frombuffer(payload.buffers()[2] or b"", dtype=np.uint8)
    out = np.zeros(len(payload), dtype=np.float64)
    # Rows are histogrammed together, a bounded number of counters and bytes at a time.
    start = 0
    while start < len(payload):
        stop = int(np.searchsorted(offsets, offsets[start] + (1 << 22), side="right")) - 1
        stop = min(max(stop, start + 1), start + 4096, len(payload))
        sizes = np.diff(offsets[start : stop + 1])
        rows = np.repeat(np.arange(stop - start, dtype=np.int64), sizes)
        counts = np.bincount(rows * 256 + data[offsets[start] : offsets[stop]], minlength=(stop - start) * 256)
        share = counts.reshape(-1, 256) / np.maximum(sizes, 1)[:, None]
        out[start:stop] = -(share * np.log2(np.where(share > 0, share, 1.0))).sum(axis=1)
        start = stop
    return pa.array(out + 0.0)


@F.arrow_udf(DoubleType())
def byte_entropy(payload: pa.Array) -> pa.Array:
    """Shannon entropy in bits of the bytes of each payload, 0 for an empty or missing one."""
    return entropy_of_batch(payload.fill_null(b""))


def anonymise(frame: Column, ip_offset: Column, ip_version: Column) -> Column:
    """Zero both hardware and both network addresses in place; ports and payload stay."""
    no_mac = F.overlay(frame, F.lit(bytes(12)), F.lit(1), F.lit(12))
    v4 = F.overlay(no_mac, F.lit(bytes(8)), ip_offset + F.lit(13), F.lit(8))
    v6 = F.overlay(no_mac, F.lit(bytes(32)), ip_offset + F.lit(9), F.lit(32))
    return F.when(ip_version == 4, v4).when(ip_version == 6, v6).otherwise(no_mac)


def anonymised_prefix(head: Column, ip_offset: Column, ip_version: Column, size: int = MAX_BYTES) -> Column:
    """The stored part of a frame, from its first `HEAD_BYTES` bytes."""
    return F.substring(anonymise(head, ip_offset, ip_version), 1, size)
