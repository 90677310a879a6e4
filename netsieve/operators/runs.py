"""Choosing among training epochs and threshold runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

DONE = ("OK", "SKIPPED_ALREADY_COMPLETE")
TIE = 1e-12


def pick_best(history: DataFrame, mcc: str = "mcc", loss: str = "loss", tie: float = TIE) -> DataFrame:
    """The row of highest MCC; among rows within `tie` of it the lowest loss."""
    best = history.agg(F.max(mcc).alias("_best"))
    near = history.join(F.broadcast(best)).where(F.col(mcc) >= F.col("_best") - tie).drop("_best")
    return near.orderBy(loss, F.desc(mcc)).limit(1)


def rank_runs(runs: DataFrame, run: str | None = None) -> DataFrame:
    """All finished runs, best first; missing metrics sort last, equal runs by `run`, the first column if not given."""
    keys = [F.desc_nulls_last(c) for c in ("binary_mcc", "balanced_accuracy", "ood_auroc", "ood_recall")]
    return runs.where(F.col("status").isin(*DONE)).orderBy(*keys, F.asc_nulls_last("known_frr"), run or runs.columns[0])


def sweep_status(records: DataFrame, status: str = "status") -> DataFrame:
    """Counts of finished, skipped and failed runs and the overall state."""
    s = F.col(status)
    counts = records.agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.count_if(s == DONE[0]).alias("ok_count"),
        F.count_if(s == DONE[1]).alias("skipped_count"),
        F.count_if(~F.coalesce(s.isin(*DONE), F.lit(False))).alias("error_count"),
    )
    state = F.when(F.col("error_count") > 0, "COMPLETED_WITH_ERRORS").otherwise("COMPLETED_OK")
    return counts.withColumn("status", state)


def pending_lambdas(candidates: DataFrame, results: DataFrame) -> DataFrame:
    """Candidates without a finished result."""
    done = results.where(F.col("status") == "OK").select("lambda")
    return candidates.join(done, "lambda", "left_anti")
