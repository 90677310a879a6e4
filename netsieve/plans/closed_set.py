"""Closed-set evaluation: images, inference, confusion table, report."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from netsieve.functions.labels import encode_label, long_enough
from netsieve.operators.classification import classification_report, classification_summary, confusion
from netsieve.operators.inference import score
from netsieve.operators.profile import class_counts
from netsieve.operators.tensors import to_scaled_image
from netsieve.schemas import KNOWN_CLASSES, N_MIN, TENSOR_CHANNELS, TENSOR_WIDTH
from netsieve.session import materialize


@dataclass
class ClosedSetResult:
    scored: DataFrame
    report: DataFrame
    summary: DataFrame


def infer_sessions(
    sessions: DataFrame,
    split: str,
    bounds: Mapping[str, float],
    make_model: Callable,
    n_min: int = N_MIN,
) -> DataFrame:
    """(session_id, attack_subtype, label, logits, embedding, pred) of the long enough sessions of a split."""
    chosen = sessions.where((F.col("split") == split) & long_enough(F.col("captured_packets"), n_min)).select(
        "session_id", "attack_subtype", encode_label(F.col("label"), split).alias("label"), "packets"
    )
    images = to_scaled_image(chosen, dict(bounds), n_min)
    return score(images, make_model, (TENSOR_CHANNELS, n_min, TENSOR_WIDTH))


def evaluate_closed_set(
    sessions: DataFrame, bounds: Mapping[str, float], make_model: Callable, split: str = "test_known", n_min: int = N_MIN
) -> ClosedSetResult:
    """Inference runs once; its narrow result is written to the checkpoint folder and counted against the index."""
    scored = materialize(infer_sessions(sessions, split, bounds, make_model, n_min).drop("logits"))
    conf = confusion(scored)
    indexed = sessions.where((F.col("split") == split) & long_enough(F.col("captured_packets"), n_min))
    expected = {KNOWN_CLASSES[r["label"]]: r["n"] for r in class_counts(indexed).collect()}
    inferred = {r["label"]: r["n"] for r in class_counts(scored).collect()}
    if expected != inferred:
        raise ValueError(f"inferred rows {inferred} differ from indexed rows {expected}")
    report = classification_report(conf, sorted(KNOWN_CLASSES.values()))
    return ClosedSetResult(scored, report, classification_summary(report))
