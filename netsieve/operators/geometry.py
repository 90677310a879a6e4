"""Class scatter statistics of embeddings."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

EPSILON = 1e-6


def _class_sums(df: DataFrame, vector: str, label: str) -> DataFrame:
    """(label, n, sums, norm): row count, sum vector and summed squared length per class, in one pass."""
    stats = (
        df.select(F.col(label).alias("label"), array_to_vector(vector).alias("v"))
        .groupBy("label")
        .agg(Summarizer.metrics("count", "sum", "normL2").summary(F.col("v")).alias("s"))
    )
    lengths = F.aggregate(vector_to_array("s.normL2"), F.lit(0.0), lambda acc, x: acc + x * x)
    return stats.select("label", F.col("s.count").alias("n"), vector_to_array("s.sum").alias("sums"), lengths.alias("norm"))


def _scatter(sums: DataFrame) -> DataFrame:
    """One row: classes, rows, total scatter within and between classes."""
    dims = sums.select("label", "n", "norm", F.posexplode("sums").alias("dim", "s"))
    per_dim = dims.groupBy("dim").agg(
        F.sum(F.col("s") * F.col("s") / F.col("n")).alias("own"),
        F.sum("s").alias("all"),
        F.sum("n").alias("rows"),
    )
    between = per_dim.agg(
        F.sum("own").alias("own"), F.sum(F.col("all") * F.col("all") / F.col("rows")).alias("common")
    )
    whole = sums.agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("rows"), F.sum("norm").alias("norm"))
    return whole.join(F.broadcast(between)).select(
        "classes",
        "rows",
        F.greatest(F.col("norm") - F.col("own"), F.lit(0.0)).alias("within"),
        F.greatest(F.col("own") - F.col("common"), F.lit(0.0)).alias("between"),
    )


def class_geometry(df: DataFrame, vector: str, label: str = "label") -> DataFrame:
    """Mean scatter inside and between classes and their ratio; zeros with fewer than two classes."""
    intra, inter = F.col("within") / F.col("rows"), F.col("between") / F.col("rows")
    enough = F.col("classes") >= 2
    return _scatter(_class_sums(df, vector, label)).select(
        F.when(enough, intra).otherwise(0.0).alias("intra_class_scatter"),
        F.when(enough, inter).otherwise(0.0).alias("inter_class_scatter"),
        F.when(enough, intra / (inter + EPSILON)).otherwise(0.0).alias("intra_inter_ratio"),
    )


def fisher_ratio(df: DataFrame, vector: str, label: str = "label", pred: str = "pred", eps: float = EPSILON) -> DataFrame:
    """Scatter ratio over correctly predicted rows; the inner scatter alone for one class, 0 for none."""
    right = df.where(F.col(label) == F.col(pred))
    intra, inter = F.col("within") / F.col("rows"), F.col("between") / F.col("rows")
    return _scatter(_class_sums(right, vector, label)).select(
        F.when(F.coalesce(F.col("classes"), F.lit(0)) == 0, 0.0)
        .when(F.col("classes") < 2, intra)
        .otherwise(intra / (inter + eps))
        .alias("fisher_ratio")
    )
