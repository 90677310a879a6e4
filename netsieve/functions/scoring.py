"""Row-wise classifier and rejection arithmetic."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F


def argmax_class(logits: Column) -> Column:
    """Index of the largest logit, the lowest index on ties."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def focal_loss(logits: Column, label: Column, weights: list[float] | None = None, gamma: float = 2.0) -> Column:
    """Weighted focal loss of one row from its logits."""
    wide = logits.cast("array<double>")
    top = F.array_max(wide)
    log_sum = top + F.log(F.aggregate(wide, F.lit(0.0), lambda acc, z: acc + F.exp(z - top)))
    cross_entropy = log_sum - F.element_at(wide, label + 1)
    weight = F.lit(1.0) if weights is None else F.element_at(F.array(*[F.lit(float(w)) for w in weights]), label + 1)
    return F.pow(F.lit(1.0) - F.exp(-cross_entropy), F.lit(float(gamma))) * weight * cross_entropy


def class_value(index: Column, table: Mapping[int, float]) -> Column:
    """Per-class constant as a lookup; null for a class without one."""
    if not table:
        return F.lit(None).cast("double")
    literals = [F.lit(v) for k, x in sorted(table.items()) for v in (int(k), float(x))]
    return F.try_element_at(F.create_map(*literals), index.cast("int"))


def normalised_score(distance: Column, winner: Column, thresholds: Mapping[int, float]) -> Column:
    """Distance in units of the winning class's threshold; a missing or bad threshold is an error."""
    tau = class_value(winner, thresholds)
    bad = F.raise_error(F.concat(F.lit("no usable threshold for class "), winner.cast("string"))).cast("double")
    return distance / F.when(tau > 0, tau).otherwise(bad)


def is_rejected(score: Column) -> Column:
    return score >= 1.0


def legacy_rejected(distance: Column, predicted: Column, thresholds: Mapping[int, float]) -> Column:
    """Older rule: strictly beyond the predicted class's threshold, never for an uncalibrated class."""
    return distance > F.coalesce(class_value(predicted, thresholds), F.lit(float("inf")))


def shielded_prediction(rejected: Column, predicted: Column) -> Column:
    return F.when(rejected, F.lit(-1)).otherwise(predicted)
