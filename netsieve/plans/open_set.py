"""The open-set shield: fit on train, calibrate on validation, judge on test."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from netsieve.functions.scoring import is_rejected, normalised_score
from netsieve.operators import detection
from netsieve.operators.classification import known_degradation
from netsieve.operators.mahalanobis import (
    RIDGE_EPSILON,
    Calibration,
    Profiles,
    assigned_distance,
    calibrate,
    fit_profiles,
    nearest_class,
    rejection_flags,
    sweep_by_class,
    sweep_lambda,
    thresholds_for,
)
from netsieve.operators.pca import Pca, fit_pca, project
from netsieve.operators.quantiles import fit_quantiles, gaussianise
from netsieve.operators.runs import pending_lambdas
from netsieve.schemas import KNOWN_CLASSES, LAMBDA_CANDIDATES, UNKNOWN_CLASSES
from netsieve.session import materialize


@dataclass
class ShieldSettings:
    variance: float = 0.99
    lambdas: Sequence[float] = LAMBDA_CANDIDATES
    selected: float | None = None
    max_frr: float = 0.10
    epsilon: float = RIDGE_EPSILON
    quantiles: int = 10_000
    sample: int | None = None  # all training rows
    sketch: int | None = None  # exact landmarks; a size: from sketches, beyond that many rows within an error of ranks
    seed: int = 42
    known: Mapping[str, int] = field(default_factory=lambda: dict(KNOWN_CLASSES))
    unknown: Mapping[str, int] = field(default_factory=lambda: dict(UNKNOWN_CLASSES))

    def __post_init__(self) -> None:
        if not 0.0 < self.variance <= 1.0:
            raise ValueError("the retained variance must be in (0, 1]")
        if not self.lambdas or any(not math.isfinite(x) or x <= 0 for x in self.lambdas):
            raise ValueError("lambdas must be positive and finite")
        self.lambdas = sorted({float(x) for x in self.lambdas})
        if self.selected is not None and not any(abs(self.selected - x) <= 1e-12 for x in self.lambdas):
            raise ValueError("the selected lambda must be one of the candidates")
        if not 0.0 <= self.max_frr <= 1.0:
            raise ValueError("the rejection cap must be in [0, 1]")
        if self.epsilon <= 0:
            raise ValueError("the ridge must be positive")
        if self.sketch is not None and not 8 <= self.sketch <= 65535:
            raise ValueError("the sketch size must be in 8..65535")
        if self.quantiles < 2 or (self.sample is not None and self.sample < 2):
            raise ValueError("quantiles and sample must be at least 2")


@dataclass
class Shield:
    """Everything fitted; small enough to travel with each task."""

    pca: Pca
    marks: np.ndarray
    profiles: Profiles
    calibration: dict[int, Calibration] = field(default_factory=dict)

    def transform(self, vector: Column | str) -> Column:
        return gaussianise(project(vector, self.pca), self.marks)


class OpenSetResult:
    """The fitted shield, the validation sweep and, computed on first use, the test metrics.

    `scored` holds one narrow row per test row (distance, winner, score, rejected, truth); it is written to
    the checkpoint folder once and every metric reads it from there.
    """

    def __init__(self, shield: Shield, sweep: DataFrame, settings: ShieldSettings, measured: DataFrame | None, subtype: str | None):
        self.shield = shield
        self.sweep = sweep
        self.settings = settings
        self.measured = measured
        self.subtype = subtype

    @cached_property
    def scored(self) -> DataFrame | None:
        if self.measured is None:
            return None
        return decide(self.measured, self.shield.calibration, self.settings.selected)

    @cached_property
    def binary(self) -> DataFrame:
        flagged = self.scored.withColumn("flag", F.col("rejected").cast("int"))
        return detection.binary_report(flagged, "truth", "flag")

    @cached_property
    def _points(self) -> DataFrame:
        return detection.roc_points(self.scored, "truth", "score")

    @cached_property
    def ranking(self) -> DataFrame:
        return detection.ranking_metrics(self._points)

    @cached_property
    def raw_ranking(self) -> DataFrame:
        return detection.ranking_metrics(detection.roc_points(self.scored, "truth", "distance"))

    @cached_property
    def roc(self) -> DataFrame:
        return detection.roc_curve(self._points)

    @cached_property
    def degradation(self) -> DataFrame:
        return known_degradation(self.scored.where("truth = 0"))

    @cached_property
    def by_class(self) -> DataFrame:
        return detection.unknown_breakdown(self.scored.where("truth = 1"), "label")

    @cached_property
    def by_subtype(self) -> DataFrame | None:
        return self.subtype and detection.unknown_breakdown(self.scored.where("truth = 1"), self.subtype)

    @cached_property
    def frr_exceeded(self) -> bool:
        """Whether the selected lambda rejects more validation rows than the cap; advisory only."""
        chosen = self.sweep.where(F.abs(F.col("lambda") - self.settings.selected) <= 1e-12).select("eligible").first()
        return not chosen["eligible"]


def fit_shield(train: DataFrame, settings: ShieldSettings, id_column: str = "id", vector: str = "embedding") -> Shield:
    """PCA, quantile landmarks and class profiles from the training rows only."""
    classes = sorted(settings.known.values())
    pca = fit_pca(train, vector, settings.variance)
    projected = train.select(id_column, "label", project(vector, pca).alias("z"))
    marks = fit_quantiles(projected, "z", id_column, settings.quantiles, settings.sample, settings.seed, settings.sketch)
    normal = projected.select("label", gaussianise("z", marks).alias("g"))
    # The transformed values lie within a few units of 0, so one uncentred pass is accurate.
    profiles = fit_profiles(normal, "g", "label", classes, settings.epsilon, near_zero_dim=pca.k)
    return Shield(pca, marks, profiles)


def calibrate_shield(shield: Shield, val: DataFrame, settings: ShieldSettings, vector: str = "embedding") -> DataFrame:
    """Set the shield's calibration; returns the (label, distance, winner) rows of validation for the sweep."""
    classes = sorted(settings.known.values())
    moved = val.select("label", shield.transform(vector).alias("g"))
    measured = materialize(
        moved.select(
            "label",
            assigned_distance("g", "label", shield.profiles).alias("own_distance"),
            nearest_class("g", shield.profiles).alias("near"),
        ).select("label", "own_distance", "near.distance", "near.winner")
    )
    shield.calibration = calibrate(measured, classes, "label", "own_distance")
    return measured.select("label", "distance", "winner")


def measure(shield: Shield, df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Replace the vector by its nearest-class distance and winner."""
    kept = [c for c in df.columns if c != vector]
    moved = df.select(*kept, shield.transform(vector).alias("g"))
    return moved.select(*kept, nearest_class("g", shield.profiles).alias("near")).select(
        *kept, "near.distance", "near.winner"
    )


def decide(df: DataFrame, calibration: Mapping[int, Calibration], lam: float) -> DataFrame:
    """Add the normalised score and the rejection at one lambda."""
    scored = df.withColumn("score", normalised_score(F.col("distance"), F.col("winner"), thresholds_for(calibration, lam)))
    return scored.withColumn("rejected", is_rejected(F.col("score")))


def with_truth(known: DataFrame, unknown: DataFrame) -> DataFrame:
    """Known and unknown rows under one binary truth column."""
    return known.withColumn("truth", F.lit(0)).unionByName(unknown.withColumn("truth", F.lit(1)))


def evaluate_open_set(
    train: DataFrame,
    val: DataFrame,
    known: DataFrame,
    unknown: DataFrame,
    settings: ShieldSettings,
    id_column: str = "id",
    subtype: str | None = None,
) -> OpenSetResult:
    """Fit, calibrate, sweep and, with a selected lambda, judge the test rows.

    Inputs hold `id_column`, label (class index), pred and embedding; unknown rows may hold a subtype.
    """
    detection.require_classes(val, "label", sorted(settings.known.values()), "validation")
    shield = fit_shield(train, settings, id_column)
    val_rows = calibrate_shield(shield, val, settings)
    names = {index: name for name, index in settings.known.items()}
    sweep = sweep_lambda(sweep_by_class(val_rows, shield.calibration, settings.lambdas), settings.max_frr, names)
    if settings.selected is None:
        return OpenSetResult(shield, sweep, settings, None, subtype)
    detection.require_classes(known, "label", sorted(settings.known.values()), "known test rows")
    detection.require_classes(unknown, "label", sorted(settings.unknown.values()), "unknown test rows")
    columns = [id_column, "label", "pred", "embedding"]
    extra = [subtype] if subtype else []
    both = with_truth(
        known.select(*columns, *[F.lit(None).cast("string").alias(c) for c in extra]), unknown.select(*columns, *extra)
    )
    return OpenSetResult(shield, sweep, settings, materialize(measure(shield, both)), subtype)


def lambda_grid(
    measured: DataFrame, calibration: Mapping[int, Calibration], lambdas: Sequence[float], done: DataFrame | None = None
) -> DataFrame:
    """One metrics row per lambda over test rows with truth, label, pred, distance, winner.

    PCA, quantiles and distances do not depend on lambda, so the grid is one job. Lambdas with a finished
    row in `done` (lambda, status) are left out. Only narrow points (score, positives, negatives) are ordered for each lambda.
    """
    wanted = sorted(float(x) for x in lambdas)
    if done is not None:
        candidates = done.sparkSession.createDataFrame([(x,) for x in wanted], "lambda double")
        wanted = sorted(r[0] for r in pending_lambdas(candidates, done).collect())
        if not wanted:
            raise ValueError("every lambda already has a finished result")
    rejected = rejection_flags(calibration, wanted, F.col("distance"), F.col("winner"))
    # Counts need no copies of rows: one aggregate counts the rejected of every lambda.
    cells = materialize(
        measured.groupBy("truth", "label", "pred", "winner").agg(
            F.count(F.lit(1)).alias("rows"), *[F.count_if(flag).alias(f"r_{i}") for i, flag in enumerate(rejected)]
        )
    )
    by_lambda = F.explode(
        F.flatten(
            F.array(
                *[
                    F.array(
                        F.struct(F.lit(lam).alias("lambda"), F.lit(True).alias("rejected"), F.col(f"r_{i}").alias("n")),
                        F.struct(F.lit(lam).alias("lambda"), F.lit(False).alias("rejected"), (F.col("rows") - F.col(f"r_{i}")).alias("n")),
                    )
                    for i, lam in enumerate(wanted)
                ]
            )
        )
    )
    counts = cells.select("truth", "label", "pred", "winner", by_lambda.alias("x")).select("truth", "label", "pred", "winner", "x.*").where("n > 0")
    counts = counts.withColumn("flag", F.col("rejected").cast("int"))
    binary = detection.binary_report(counts, "truth", "flag", ["lambda"], "n")
    cost = known_degradation(counts.where("truth = 0"), ["lambda"], "n")
    # Classes change their order among each other from lambda to lambda, so ranks need an order of each; rows that share a class and
    # a distance are one.
    points = measured.groupBy("winner", "distance").agg(
        F.count_if(F.col("truth") == 1).alias("pos"), F.count_if(F.col("truth") == 0).alias("neg")
    )
    scores = F.array(
        *[
            F.struct(
                F.lit(lam).alias("lambda"),
                normalised_score(F.col("distance"), F.col("winner"), thresholds_for(calibration, lam)).alias("score"),
            )
            for lam in wanted
        ]
    )
    ranking = detection.ranking_metrics(detection.counted_roc_points(points.select("pos", "neg", F.inline(scores)), "score", ["lambda"]), ["lambda"])
    return binary.join(ranking, "lambda").join(cost, "lambda")
