"""Validated min/max profile of the training sessions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from netsieve.operators import profile
from netsieve.operators.integrity import build_manifest, reconcile
from netsieve.schemas import KNOWN_CLASSES
from netsieve.session import stage_table


@dataclass
class TrainProfile:
    bounds: dict[str, float]
    counts: list[tuple[str, int]]


class InputChanged(RuntimeError):
    """The files of a fit were not the same before and after it."""


@contextmanager
def unchanged_files(spark: SparkSession, path: str) -> Iterator[DataFrame]:
    """Guard a job that reads the Parquet files below `path`: their manifest, which it yields, is taken before and after, and any
    file that is gone, new or different makes the job fail."""
    before = stage_table(build_manifest(spark, path), "manifest-before")
    yield before
    after = build_manifest(spark, path)
    checks = [("sha256", "sha256_mismatch"), ("size_bytes", "size_mismatch"), ("row_count", "rows_mismatch")]
    odd = reconcile(before, after, checks).where("status <> 'ok'").orderBy("path").limit(20).collect()
    if odd:
        raise InputChanged(f"files changed during the fit: {[(r['path'], r['status']) for r in odd]}")


def fit_profile(
    sessions: DataFrame,
    expected_counts: DataFrame | None = None,
    classes: Sequence[str] = tuple(KNOWN_CLASSES),
    files: str | None = None,
) -> TrainProfile:
    """Bounds of the train split; any invalid row, odd count or impossible bound is an error.

    Only the train split is read; validation failures come back with a few example ids per file. With `files`, the folder that
    `sessions` are read from, the fit is refused if a file there changes while it is read.
    """
    if files is not None:
        with unchanged_files(sessions.sparkSession, files):
            return fit_profile(sessions, expected_counts, classes)
    train = sessions.where(F.col("split") == "train_known")
    reason = profile.session_reason(classes)
    invalid = profile.validate_rows(train, reason, "source_capture", "session_id").limit(20).collect()
    if invalid:
        raise ValueError(f"invalid sessions: {[r.asDict() for r in invalid]}")
    counts = profile.class_counts(train)
    if expected_counts is not None:
        odd = profile.check_counts(counts, expected_counts, classes).where("status <> 'ok'").limit(20).collect()
        if odd:
            raise ValueError(f"class counts differ: {[r.asDict() for r in odd]}")
    row = profile.check_bounds(profile.profile_bounds(train), profile.SESSION_BOUND_CHECKS).first()
    if row["valid_sessions"] == 0:
        raise ValueError("no training session")
    return TrainProfile(row.asDict(), [(r["label"], r["n"]) for r in counts.orderBy("label").collect()])
