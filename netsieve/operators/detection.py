"""Known-versus-unknown detection metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from netsieve.operators.classification import mcc, ratio
from netsieve.operators.ordered import group_medians, running_totals, split_points


def binary_report(df: DataFrame, truth: str, pred: str, group: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """2x2 counts and the rates drawn from them; `truth` and `pred` are 1 for unknown, 0 for known. A `weight` column counts a
    row as so many."""
    t, p = F.col(truth), F.col(pred)

    def cell(a: int, b: int):
        here = (t == a) & (p == b)
        return F.count_if(here) if weight is None else F.coalesce(F.sum(F.when(here, F.col(weight))), F.lit(0))

    counts = df.groupBy(*group).agg(
        cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp")
    )
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    total = tn + fp + fn + tp
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    support_sq = (tp + fn) * (tp + fn) + (tn + fp) * (tn + fp)
    predicted_sq = (tp + fp) * (tp + fp) + (tn + fn) * (tn + fn)
    cross = (tp + fn) * (tp + fp) + (tn + fp) * (tn + fn)
    return counts.select(
        *group,
        "tn",
        "fp",
        "fn",
        "tp",
        precision.alias("ood_precision"),
        recall.alias("ood_recall"),
        ratio(2 * precision * recall, precision + recall).alias("ood_f1"),
        ratio(fn, fn + tp).alias("ood_fnr"),
        ratio(fp, fp + tn).alias("known_false_rejection_rate"),
        ((ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2).alias("balanced_accuracy"),
        mcc(tp + tn, total, cross, predicted_sq, support_sq).alias("binary_mcc"),
    )


def roc_points(df: DataFrame, truth: str, score: str, group: Sequence[str] = ()) -> DataFrame:
    """One row per distinct score with cumulative true and false positives at or above it.

    Ties collapse before anything is ordered, and the running sums carry across score buckets.
    """
    t = F.col(truth)
    return counted_roc_points(df.select(*group, score, (t == 1).cast("long").alias("pos"), (t == 0).cast("long").alias("neg")), score, group)


def counted_roc_points(df: DataFrame, score: str, group: Sequence[str] = ()) -> DataFrame:
    """The same from rows that stand for `pos` positives and `neg` negatives."""
    group = list(group)
    counts = df.groupBy(*group, (-F.col(score).cast("double")).alias("_neg")).agg(
        F.coalesce(F.sum("pos"), F.lit(0)).alias("pos"), F.coalesce(F.sum("neg"), F.lit(0)).alias("neg")
    ).withColumn("one", F.lit(1).cast("long"))
    # Split points from the rows themselves spare the sketch a shuffle.
    points = [-p for p in reversed(split_points(df, score))]
    curve = running_totals(counts, "_neg", ["pos", "neg", "one"], group, points)
    return curve.select(
        *group,
        (-F.col("_neg")).alias("threshold"),
        "pos",
        "neg",
        F.col("cum_pos").alias("tp"),
        F.col("cum_neg").alias("fp"),
        F.col("total_pos").alias("positives"),
        F.col("total_neg").alias("negatives"),
        F.col("cum_one").alias("point_no"),
        F.col("total_one").alias("points"),
    )


def ranking_metrics(points: DataFrame, group: Sequence[str] = (), tpr_target: float = 0.95) -> DataFrame:
    """AUROC, average precision and the lowest false-positive rate at the target recall.

    Null where undefined: one class absent, or the target never reached.
    """
    tp, fp, pos, neg = (F.col(c).cast("double") for c in ("tp", "fp", "pos", "neg"))
    positives, negatives = F.max("positives").cast("double"), F.max("negatives").cast("double")
    # A tie group is one trapezoid: its negatives against the positives before it plus half of its own.
    area = F.sum(neg * (tp - pos / 2))
    tpr = F.try_divide(tp, F.col("positives"))
    return points.groupBy(*group).agg(
        F.try_divide(area, positives * negatives).alias("auroc"),
        F.try_divide(F.sum(pos * tp / (tp + fp)), positives).alias("average_precision"),
        F.min(F.when(tpr >= tpr_target, F.try_divide(fp, F.col("negatives")))).alias("fpr_at_tpr"),
    )


def roc_curve(points: DataFrame, max_points: int = 5000) -> DataFrame:
    """(point_no, fpr, tpr, threshold) from the origin on, thinned evenly to at most `max_points` points.

    The origin has no finite threshold and is stored with null.
    """
    curve = points.select(
        "point_no", F.try_divide("fp", "negatives").alias("fpr"), F.try_divide("tp", "positives").alias("tpr"), "threshold", "points"
    )
    # Point i is kept if it is the whole part of some step of an even grid over 0..points.
    step = F.greatest(F.col("points") / F.lit(float(max_points - 1)), F.lit(1.0))
    j = F.ceil(F.col("point_no") / step)
    kept = curve.where((F.floor(j * step) == F.col("point_no")) | (F.col("point_no") == F.col("points"))).drop("points")
    origin = points.sparkSession.range(1).select(
        F.col("id").alias("point_no"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(None).cast("double").alias("threshold")
    )
    return origin.unionByName(kept)


def unknown_breakdown(df: DataFrame, by: str, score: str = "score", rejected: str = "rejected") -> DataFrame:
    """Per unknown class or subtype: support, detections, recall and score statistics (midpoint median)."""
    stats = df.groupBy(by).agg(
        F.count(F.lit(1)).alias("support"),
        F.count_if(F.col(rejected)).alias("detected_as_ood"),
        F.avg(F.col(rejected).cast("int")).alias("ood_recall"),
        F.avg(score).alias("score_mean"),
        F.min(score).alias("score_min"),
        F.max(score).alias("score_max"),
    )
    medians = group_medians(df, [by], score).select(by, F.col("median").alias("score_median"))
    return stats.join(medians, by)


def require_classes(df: DataFrame, column: str, classes: Sequence[int], where: str) -> None:
    """Error unless every class occurs; only the few class values reach the driver."""
    seen = {r[0] for r in df.where(F.col(column).isin(*classes)).select(column).distinct().collect()}
    absent = sorted(set(classes) - seen)
    if absent:
        raise ValueError(f"classes absent from {where}: {absent}")


def attach_subtypes(scored: DataFrame, sessions: DataFrame) -> DataFrame:
    """Bring the attack subtype of each scored row by session id."""
    return scored.join(sessions.select("session_id", "attack_subtype"), "session_id")
