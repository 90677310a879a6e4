"""Mean vectors and second moments of array columns, per class or over the whole table."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

MAX_CLASSES = 1000
MAX_DIM = 8192
MAX_CELLS = 1 << 28


def matrix_of(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """Rows of an Arrow list column as a float64 matrix; ragged or missing vectors are an error."""
    flat = np.asarray(column.flatten(), dtype=np.float64)
    n = len(column)
    if n == 0:
        return flat.reshape(0, dim or 0)
    if column.null_count or flat.size % n or (dim is not None and flat.size != n * dim):
        raise ValueError("vectors are missing or differ in length")
    widths = np.diff(np.asarray(column.offsets))
    if (widths != widths[0]).any():
        raise ValueError("vectors differ in length")
    return flat.reshape(n, -1)


@dataclass
class Moments:
    n: int
    mean: np.ndarray
    covariance: np.ndarray


def vector_means(df: DataFrame, vector: str, label: str | None = None) -> dict[int, tuple[int, np.ndarray]]:
    """{class: (rows, mean vector)}; class 0 when there is no label."""
    keyed = df.select((F.col(label) if label else F.lit(0)).cast("int").alias("label"), array_to_vector(vector).alias("v"))
    stats = keyed.groupBy("label").agg(Summarizer.metrics("count", "mean").summary(F.col("v")).alias("s"))
    rows = stats.select("label", "s.count", vector_to_array("s.mean").alias("mean")).limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    return {r["label"]: (r["count"], np.array(r["mean"])) for r in rows}


def second_moments(
    df: DataFrame, vector: str, shifts: Mapping[int, np.ndarray], label: str | None = None
) -> DataFrame:
    """(label, i, n, row): summed moments of the shifted vectors of each class.

    Row i >= 0 is row i of sum (x-s)(x-s)^T, row -1 is sum (x-s). Each task folds its rows into one
    matrix per class, so it sends d+1 short rows per class however many rows it read, and the adding up
    is spread over (label, i). Classes without a shift are left out.
    """
    shifts = {int(c): np.asarray(s, dtype=np.float64) for c, s in shifts.items()}
    dim = len(next(iter(shifts.values())))
    if dim > MAX_DIM:
        raise ValueError(f"vectors longer than {MAX_DIM}")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = {c: np.zeros((dim + 1, dim)) for c in shifts}
        counts = dict.fromkeys(shifts, 0)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x, classes = matrix_of(batch.column(1), dim), np.asarray(batch.column(0))
            for c, shift in shifts.items():
                mine = x[classes == c] - shift
                if len(mine):
                    grams[c][0] += mine.sum(axis=0)
                    grams[c][1:] += mine.T @ mine
                    counts[c] += len(mine)
        for c, gram in grams.items():
            if counts[c]:
                offsets = pa.array(np.arange(0, gram.size + 1, dim, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(dim + 1, c, dtype=np.int32)),
                        pa.array(np.arange(-1, dim, dtype=np.int32)),
                        pa.array(np.full(dim + 1, counts[c], dtype=np.int64)),
                        pa.ListArray.from_arrays(offsets, pa.array(gram.ravel())),
                    ],
                    names=["label", "i", "n", "row"],
                )

    keyed = df.select((F.col(label) if label else F.lit(0)).cast("int").alias("label"), F.col(vector).alias("x"))
    partial = keyed.mapInArrow(fold, "label int, i int, n long, row array<double>")
    summed = partial.groupBy("label", "i").agg(
        F.sum("n").alias("n"), Summarizer.sum(array_to_vector("row")).alias("row")
    )
    return summed.withColumn("row", vector_to_array("row"))


def fit_moments(
    df: DataFrame, vector: str, label: str | None = None, shifts: Mapping[int, np.ndarray] | None = None
) -> dict[int, Moments]:
    """Count, mean and covariance (n-1) per class, in float64.

    Two passes with the class means as shift; given `shifts`, such as zeros for values known to lie near
    the origin, save the first. Only classes x d x d numbers reach the driver.
    """
    if shifts is None:
        shifts = {c: mean for c, (_, mean) in vector_means(df, vector, label).items()}
    if not shifts:
        return {}
    dim = len(next(iter(shifts.values())))
    if len(shifts) * dim * dim > MAX_CELLS:
        raise ValueError(f"{len(shifts)} covariances of dimension {dim} are too large to hold")
    rows = {(r["label"], r["i"]): r for r in second_moments(df, vector, shifts, label).collect()}
    out: dict[int, Moments] = {}
    for c, shift in shifts.items():
        head = rows.get((c, -1))
        if head is None:
            continue
        n = head["n"]
        gram = np.array([rows[c, i]["row"] for i in range(dim)])
        off = np.array(head["row"]) / n
        cov = (gram - n * np.outer(off, off)) / (n - 1) if n > 1 else np.full(gram.shape, np.nan)
        out[c] = Moments(n, np.asarray(shift) + off, (cov + cov.T) / 2)
    return out


def mean_cov(df: DataFrame, vector: str) -> Moments:
    fitted = fit_moments(df, vector)
    if not fitted:
        raise ValueError("no rows to fit")
    return fitted[0]
