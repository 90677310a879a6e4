"""Closed-set metrics from a confusion table in long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def confusion(df: DataFrame, label: str = "label", pred: str = "pred", group: Sequence[str] = ()) -> DataFrame:
    """(label, pred, n): the only pass over the rows; every report below reads this small table."""
    return df.groupBy(*group, F.col(label).alias("label"), F.col(pred).alias("pred")).agg(
        F.count(F.lit(1)).alias("n")
    )


def dense_confusion(conf: DataFrame, classes: Sequence[int]) -> DataFrame:
    """The same table with a row for every class pair."""
    pairs = [(int(a), int(b)) for a in classes for b in classes]
    grid = conf.sparkSession.createDataFrame(pairs, "label int, pred int")
    return grid.join(conf, ["label", "pred"], "left").na.fill(0, ["n"])


def ratio(a: Column, b: Column) -> Column:
    """a / b with 0/0 counted as 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def _per_class(conf: DataFrame, classes: Sequence[int]) -> DataFrame:
    """Support, predicted and hits per class, plus the table total, from one aggregate."""
    zero, n, hit = F.lit(0).cast("long"), F.col("n"), F.col("label") == F.col("pred")
    as_label = F.struct(
        F.col("label").alias("cls"), n.alias("support"), zero.alias("predicted"), F.when(hit, n).otherwise(zero).alias("tp")
    )
    as_pred = F.struct(F.col("pred").alias("cls"), zero.alias("support"), n.alias("predicted"), zero.alias("tp"))
    cells = conf.select(F.explode(F.array(as_label, as_pred)).alias("c"))
    sums = cells.groupBy(F.col("c.cls").alias("label")).agg(
        F.sum("c.support").alias("support"), F.sum("c.predicted").alias("predicted"), F.sum("c.tp").alias("tp")
    )
    every = conf.sparkSession.createDataFrame([(int(c),) for c in classes], "label int")
    total = conf.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    return (
        every.join(sums, "label", "left").na.fill(0, ["support", "predicted", "tp"]).join(F.broadcast(total))
    )


def classification_report(conf: DataFrame, classes: Sequence[int], fnr_from_recall: bool = False) -> DataFrame:
    """Per class: precision, recall, fnr, fpr, f1, support, predicted; 0/0 is 0.

    `fnr_from_recall` is the validation variant, in which an absent class has a false-negative rate of 1.
    """
    support, predicted, tp = (F.col(c).cast("double") for c in ("support", "predicted", "tp"))
    precision, recall = ratio(tp, predicted), ratio(tp, support)
    fnr = F.lit(1.0) - recall if fnr_from_recall else ratio(support - tp, support)
    return _per_class(conf, classes).select(
        "label",
        precision.alias("precision"),
        recall.alias("recall"),
        fnr.alias("fnr"),
        ratio(predicted - tp, F.col("total") - support).alias("fpr"),
        ratio(2 * precision * recall, precision + recall).alias("f1"),
        "support",
        "predicted",
        "tp",
        "total",
    )


def mcc(correct: Column, total: Column, cross: Column, predicted_sq: Column, support_sq: Column) -> Column:
    """Multiclass Matthews correlation from marginal sums, 0 when undefined."""
    top = correct * total - cross
    under = F.sqrt(F.greatest((total * total - predicted_sq) * (total * total - support_sq), F.lit(0.0)))
    return F.when(under > 0, top / under).otherwise(0.0)


def classification_summary(report: DataFrame) -> DataFrame:
    """Accuracy, macro means over all classes, macro recall over present ones, weighted F1 and MCC."""
    s, p, tp = (F.col(c).cast("double") for c in ("support", "predicted", "tp"))
    total = F.max("total").cast("double")
    return report.agg(
        F.max("total").alias("total_samples"),
        ratio(F.sum(tp), total).alias("accuracy"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.coalesce(F.avg(F.when(s > 0, F.col("recall"))), F.lit(0.0)).alias("present_recall"),
        F.avg("f1").alias("macro_f1"),
        ratio(F.sum(F.col("f1") * s), F.sum(s)).alias("weighted_f1"),
        mcc(F.sum(tp), total, F.sum(s * p), F.sum(p * p), F.sum(s * s)).alias("mcc"),
    )


def group_mcc(conf: DataFrame, group: Sequence[str]) -> DataFrame:
    """MCC per group over any set of labels and predictions, also when they differ (rejected = -1)."""
    group = list(group)
    cls = F.explode(F.array_distinct(F.array("label", "pred"))).alias("cls")
    cells = conf.select(*group, "label", "pred", "n", cls)
    hit = (F.col("cls") == F.col("label")) & (F.col("label") == F.col("pred"))
    margins = cells.groupBy(*group, "cls").agg(
        F.sum(F.when(F.col("cls") == F.col("label"), F.col("n")).otherwise(0)).cast("double").alias("s"),
        F.sum(F.when(F.col("cls") == F.col("pred"), F.col("n")).otherwise(0)).cast("double").alias("p"),
        F.sum(F.when(hit, F.col("n")).otherwise(0)).cast("double").alias("c"),
    )
    s, p = F.col("s"), F.col("p")
    return margins.groupBy(*group).agg(
        mcc(F.sum("c"), F.sum(s), F.sum(s * p), F.sum(p * p), F.sum(s * s)).alias("mcc")
    )


def known_degradation(df: DataFrame, group: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """What the shield costs on known rows: MCC before and after, rejections, agreement with the geometry.

    Needs label, pred, winner (geometric class) and rejected. A `weight` column counts a row as so many.
    """
    group = list(group)
    after = F.when(F.col("rejected"), F.lit(-1)).otherwise(F.col("pred"))
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    cells = df.groupBy(*group, "label", "pred", "winner", "rejected").agg(n.alias("n"))
    keyed = cells.withColumn("_after", after).withColumn("_all", F.lit(1))
    keys = group or ["_all"]

    def merged(pred: str) -> DataFrame:
        return keyed.groupBy(*keys, "label", F.col(pred).alias("pred")).agg(F.sum("n").alias("n"))

    before = group_mcc(merged("pred"), keys).withColumnRenamed("mcc", "mcc_before_shield")
    later = group_mcc(merged("_after"), keys).withColumnRenamed("mcc", "mcc_after_shield")
    n = F.col("n")
    sums = keyed.groupBy(*keys).agg(
        F.sum(n).alias("known_total"),
        F.sum(F.when(F.col("rejected"), n).otherwise(0)).alias("known_rejected"),
        (F.sum(F.when(F.col("pred") == F.col("winner"), n).otherwise(0)) / F.sum(n)).alias("geometry_agreement"),
        (F.sum(F.when(F.col("label") == F.col("winner"), n).otherwise(0)) / F.sum(n)).alias("geometric_accuracy"),
    )
    out = sums.join(before, keys).join(later, keys)
    return out.withColumn("mcc_delta", F.col("mcc_after_shield") - F.col("mcc_before_shield")).drop("_all")
