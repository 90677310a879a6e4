"""Principal components fitted on the training split, projection of any split."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType

from netsieve.operators.moments import matrix_of, mean_cov


@dataclass
class Pca:
    mean: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray

    @property
    def k(self) -> int:
        return self.components.shape[1]

    @property
    def retained(self) -> float:
        return float(self.explained[: self.k].sum())


def fit_pca(df: DataFrame, vector: str, variance: float | None = 0.99, k: int | None = None) -> Pca:
    """Components up to a share of the variance, or a fixed number `k` of them.

    Signs are pinned by making the largest loading of each component positive.
    """
    if k is None and not (variance is not None and 0.0 < variance <= 1.0):
        raise ValueError("the retained variance must be in (0, 1]")
    moments = mean_cov(df, vector)
    if moments.n < 2:
        raise ValueError("at least two rows are needed")
    values, vectors = np.linalg.eigh(moments.covariance)
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
    total = values.sum()
    if not np.isfinite(total) or total <= 0:
        raise ValueError("the data has no variance")
    share = np.cumsum(values) / total
    if k is None:
        k = min(len(values), int(np.searchsorted(share, variance)) + 1)
    chosen = vectors[:, :k]
    top = np.abs(chosen).argmax(axis=0)
    chosen = chosen * np.sign(chosen[top, np.arange(chosen.shape[1])])
    return Pca(moments.mean, chosen, values, values / total)


def list_array(matrix: np.ndarray) -> pa.ListArray:
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix).ravel()))


def project(vector: Column | str, pca: Pca) -> Column:
    """(x - mean) V in float64, stored as float32; a non-finite result is an error."""
    mean, components = pca.mean, pca.components

    @F.arrow_udf(ArrayType(FloatType()))
    def apply(x: pa.Array) -> pa.Array:
        out = ((matrix_of(x, len(mean)) - mean) @ components).astype(np.float32)
        if not np.isfinite(out).all():
            raise FloatingPointError("projection gave a non-finite value")
        return list_array(out)

    return apply(vector)
