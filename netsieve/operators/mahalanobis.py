"""Per-class Gaussian profiles, distances, calibration and the threshold sweep."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from netsieve.functions.scoring import class_value
from netsieve.operators.moments import Moments, fit_moments, matrix_of
from netsieve.operators.ordered import group_medians

# Fixed values of the regularised inverse.
RIDGE_EPSILON = 1e-5
RIDGE_TRIES = 5


@dataclass
class Profiles:
    counts: dict[int, int]
    centroids: dict[int, np.ndarray]
    inverses: dict[int, np.ndarray]

    @property
    def classes(self) -> list[int]:
        return sorted(self.centroids)


@dataclass
class Calibration:
    count: int
    median: float
    mad: float


def robust_inverse(covariance: np.ndarray, epsilon: float = RIDGE_EPSILON, tries: int = RIDGE_TRIES) -> np.ndarray:
    """Inverse of the ridged covariance; ten times more ridge per failed try, pseudo-inverse at last."""
    for attempt in range(tries):
        ridged = covariance + epsilon * 10.0**attempt * np.eye(len(covariance))
        try:
            half = np.linalg.inv(np.linalg.cholesky(ridged))
            return half.T @ half
        except np.linalg.LinAlgError:
            continue
    return np.linalg.pinv(covariance)


def profiles_from_moments(
    moments: Mapping[int, Moments], classes: Sequence[int], epsilon: float = RIDGE_EPSILON, skip_small: bool = False
) -> Profiles:
    out = Profiles({}, {}, {})
    for c in sorted(int(c) for c in classes):
        m = moments.get(c)
        if m is None or m.n < 2:
            if skip_small:
                continue
            raise ValueError(f"class {c} has {0 if m is None else m.n} rows, at least two are needed")
        out.counts[c], out.centroids[c] = m.n, m.mean
        out.inverses[c] = robust_inverse(m.covariance, epsilon)
    return out


def fit_profiles(
    df: DataFrame,
    vector: str,
    label: str,
    classes: Sequence[int],
    epsilon: float = RIDGE_EPSILON,
    skip_small: bool = False,
    near_zero_dim: int | None = None,
) -> Profiles:
    """Centroid and regularised inverse covariance of each class, from one distributed moment fit.

    `near_zero_dim` is the dimension of vectors known to lie near the origin, which need one pass only.
    """
    classes = [int(c) for c in classes]
    known = df.where(F.col(label).isin(*classes))
    shifts = None if near_zero_dim is None else {c: np.zeros(near_zero_dim) for c in classes}
    return profiles_from_moments(fit_moments(known, vector, label, shifts), classes, epsilon, skip_small)


def _squared(x: np.ndarray, centre: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    diff = x - centre
    return np.maximum(((diff @ inverse) * diff).sum(axis=1), 0.0)


def nearest_class(vector: Column | str, profiles: Profiles) -> Column:
    """struct(distance, winner): smallest squared distance over all classes, lowest class on ties."""
    if not profiles.centroids:
        raise ValueError("no fitted profiles")
    classes = np.array(profiles.classes, dtype=np.int32)
    params = [(profiles.centroids[c], profiles.inverses[c]) for c in profiles.classes]
    shape = StructType().add("distance", DoubleType()).add("winner", IntegerType())

    @F.arrow_udf(shape)
    def apply(x: pa.Array) -> pa.Array:
        rows = matrix_of(x, len(params[0][0]))
        table = np.stack([_squared(rows, m, s) for m, s in params], axis=1)
        if not np.isfinite(table).all():
            raise FloatingPointError("distances are not finite")
        best = table.argmin(axis=1)
        return pa.StructArray.from_arrays(
            [pa.array(table[np.arange(len(rows)), best]), pa.array(classes[best])], names=["distance", "winner"]
        )

    return apply(vector)


def assigned_distance(vector: Column | str, label: Column | str, profiles: Profiles, legacy: bool = False) -> Column:
    """Squared distance to the row's own class. A class without profile is an error, or 0 in legacy mode."""
    params = {c: (profiles.centroids[c], profiles.inverses[c]) for c in profiles.classes}
    dim = len(next(iter(profiles.centroids.values())))

    @F.arrow_udf(DoubleType())
    def apply(x: pa.Array, y: pa.Array) -> pa.Array:
        rows, classes = matrix_of(x, dim), np.asarray(y)
        out = np.full(len(rows), 0.0 if legacy else np.nan)
        for c, (m, s) in params.items():
            mine = classes == c
            out[mine] = _squared(rows[mine], m, s)
        if not np.isfinite(out).all():
            raise FloatingPointError("a label has no profile or a distance is not finite")
        return pa.array(out)

    return apply(vector, label)


def calibrate(
    df: DataFrame, classes: Sequence[int], label: str = "label", distance: str = "distance", skip_empty: bool = False
) -> dict[int, Calibration]:
    """Lower median and lower median absolute deviation of own-class distances per true class."""
    rows = df.where(F.col(label).isin(*[int(c) for c in classes])).select(
        F.col(label).cast("int").alias("label"), F.col(distance).alias("d")
    )
    first = {r["label"]: r for r in group_medians(rows, ["label"], "d").collect()}
    empty = sorted(set(int(c) for c in classes) - set(first))
    if empty and not skip_empty:
        raise ValueError(f"no calibration rows for classes {empty}")
    medians = {c: r["lower_median"] for c, r in first.items()}
    spread = rows.select("label", F.abs(F.col("d") - class_value(F.col("label"), medians)).alias("a"))
    second = {r["label"]: r["lower_median"] for r in group_medians(spread, ["label"], "a").collect()}
    out = {c: Calibration(first[c]["n"], medians[c], second[c]) for c in sorted(first)}
    if any(not (math.isfinite(v.median) and math.isfinite(v.mad)) for v in out.values()):
        raise ValueError("calibration statistics are not finite")
    return out


def thresholds_for(calibration: Mapping[int, Calibration], lam: float) -> dict[int, float]:
    """median + lambda x MAD per class."""
    if not math.isfinite(lam) or lam <= 0:
        raise ValueError("lambda must be positive and finite")
    out = {c: v.median + lam * v.mad for c, v in calibration.items()}
    bad = {c: t for c, t in out.items() if not math.isfinite(t) or t <= 0}
    if bad:
        raise ValueError(f"unusable thresholds: {bad}")
    return out


def rejection_flags(
    calibration: Mapping[int, Calibration], lambdas: Sequence[float], distance: Column, winner: Column
) -> list[Column]:
    """One boolean column per lambda: distance reaches the winning class's threshold."""
    flags = []
    for lam in lambdas:
        tau = class_value(winner, thresholds_for(calibration, lam))
        missing = F.raise_error(F.concat(F.lit("no threshold for class "), winner.cast("string"))).cast("double")
        flags.append(distance / F.coalesce(tau, missing) >= 1.0)
    return flags


def sweep_by_class(
    df: DataFrame, calibration: Mapping[int, Calibration], lambdas: Sequence[float]
) -> DataFrame:
    """(lambda, label, total, rejected, correct, threshold) of validation rows with label, distance, winner.

    The whole grid is one aggregate of conditional counts; rows are not copied per lambda.
    """
    flags = rejection_flags(calibration, lambdas, F.col("distance"), F.col("winner"))
    wide = df.groupBy("label").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("winner") == F.col("label")).alias("correct"),
        *[F.count_if(flag).alias(f"r_{i}") for i, flag in enumerate(flags)],
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(float(lam)).alias("lambda"),
                F.col(f"r_{i}").alias("rejected"),
                class_value(F.col("label"), thresholds_for(calibration, lam)).alias("threshold"),
            )
            for i, lam in enumerate(lambdas)
        ]
    )
    return wide.select("label", "total", "correct", F.inline(cells)).select(
        "lambda", "label", "total", "rejected", "correct", "threshold"
    )


def sweep_lambda(by_class: DataFrame, max_frr: float, names: Mapping[int, str]) -> DataFrame:
    """One row per lambda: totals, global rejection rate, eligibility and per-class maps."""
    if not 0.0 <= max_frr <= 1.0:
        raise ValueError("the rejection cap must be in [0, 1]")
    name = F.try_element_at(F.create_map(*[F.lit(v) for kv in names.items() for v in kv]), F.col("label"))
    frr = F.sum("rejected") / F.sum("total")

    def by_name(value: Column) -> Column:
        return F.map_from_entries(F.sort_array(F.collect_list(F.struct(name.alias("key"), value.alias("value")))))

    return by_class.groupBy("lambda").agg(
        F.sum("total").alias("known_total"),
        F.sum("rejected").alias("known_rejected"),
        (F.sum("total") - F.sum("rejected")).alias("known_accepted"),
        frr.alias("global_frr"),
        (frr <= max_frr).alias("eligible"),
        (F.sum("correct") / F.sum("total")).alias("geometric_accuracy"),
        by_name(F.col("rejected") / F.col("total")).alias("frr_by_class"),
        by_name(F.col("threshold")).alias("thresholds"),
    )
