"""Dense session tensors, built late and in small batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType, StructType

from netsieve.schemas import DELTA_COLUMNS, MAX_PACKETS, TENSOR_CHANNELS, TENSOR_WIDTH

BATCH_ROWS = 256


def _dense(packets: pa.ListArray, rows: int) -> np.ndarray:
    """(n, rows, width, channels) float32 tensor of a batch of compact packet lists."""
    n = len(packets)
    out = np.zeros((n, rows, TENSOR_WIDTH, TENSOR_CHANNELS), dtype=np.float32)
    sizes = np.asarray(packets.value_lengths().fill_null(0))
    flat = packets.flatten()
    session = np.repeat(np.arange(n), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keep = place < rows
    session, place = session[keep], place[keep]
    flat = flat.filter(pa.array(keep))
    channel = np.where(np.asarray(flat.field("is_forward")), 0, 1)
    out[session, place, :DELTA_COLUMNS, channel] = np.asarray(flat.field("delta_enc"))[:, None]
    out[session, place, :, 2] = np.asarray(flat.field("entropy"))[:, None]
    room = TENSOR_WIDTH - DELTA_COLUMNS
    padded = b"".join((b or b"")[:room].ljust(room, b"\0") for b in flat.field("bytes").to_pylist())
    raw = np.frombuffer(padded, dtype=np.uint8).reshape(-1, room)
    out[session, place, DELTA_COLUMNS:, channel] = raw
    return out


def _with_tensor(df: DataFrame, build, name: str) -> DataFrame:
    at = df.columns.index("packets")
    kept = [c for c in df.columns if c != "packets"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(start, BATCH_ROWS)
                flat = build(part.column(at))
                width = flat.shape[1]
                offsets = pa.array(np.arange(0, flat.size + 1, width, dtype=np.int32))
                column = pa.ListArray.from_arrays(offsets, pa.array(flat.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [column], names=[*kept, name])

    schema = StructType([df.schema[c] for c in kept]).add(name, ArrayType(FloatType()))
    return df.mapInArrow(run, schema)


def to_tensor(df: DataFrame, name: str = "tensor", rows: int = MAX_PACKETS) -> DataFrame:
    """Replace `packets` by the dense tensor, flattened row-major as (packet, column, channel)."""
    return _with_tensor(df, lambda packets: _dense(packets, rows).reshape(len(packets), -1), name)


def to_scaled_image(df: DataFrame, bounds: dict[str, float], n_min: int, name: str = "image") -> DataFrame:
    """Replace `packets` by the model input: first `n_min` rows, min-max scaled, as (channel, row, column).

    Values outside the bounds are not clipped; a channel group with equal bounds is left as it is.
    """
    lo_raw, hi_raw = float(bounds["min_raw"]), float(bounds["max_raw"])
    lo_ent, hi_ent = float(bounds["min_entropy"]), float(bounds["max_entropy"])

    def build(packets: pa.ListArray) -> np.ndarray:
        image = np.ascontiguousarray(_dense(packets, n_min).transpose(0, 3, 1, 2))
        if hi_raw > lo_raw:
            image[:, :2] = (image[:, :2] - lo_raw) / (hi_raw - lo_raw)
        if hi_ent > lo_ent:
            image[:, 2] = (image[:, 2] - lo_ent) / (hi_ent - lo_ent)
        return image.reshape(len(packets), -1)

    return _with_tensor(df, build, name)


def min_max(value: Column, low: Column, high: Column) -> Column:
    """Scalar form of the scaling, unclipped, identity for equal bounds."""
    return F.when(high > low, (value - low) / (high - low)).otherwise(value)
