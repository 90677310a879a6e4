"""Manifest building, parsing, reconciliation and split discipline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from netsieve.functions.paths import CHECKSUM_LINE, is_data_path, line_digest, line_path, path_split
from netsieve.schemas import SPLITS
from netsieve.sources.digests import file_digests


def parse_manifest(lines: DataFrame, root: str = "data/processed/", suffix: str = ".hdf5") -> DataFrame:
    """Classify checksum lines (line_no, line): status ok, bad_format, duplicate or other_path.

    Blank and comment lines vanish. The first line of a path counts; later ones are duplicates, found by
    joining on (path, first line) so that a much repeated path stays spread out.
    """
    text = F.trim(F.col("line"))
    used = lines.withColumn("line", text).where((text != "") & ~text.startswith("#"))
    parsed = used.select(
        "line_no",
        "line",
        F.col("line").rlike(CHECKSUM_LINE).alias("_matches"),
        line_digest(F.col("line")).alias("sha256"),
        line_path(F.col("line")).alias("path"),
    ).withColumn("_data", F.col("_matches") & is_data_path(F.col("path"), root, suffix))
    first = (
        parsed.where("_data")
        .groupBy("path")
        .agg(F.min("line_no").alias("line_no"))
        .withColumn("_first", F.lit(True))
    )
    status = (
        F.when(~F.col("_matches"), "bad_format")
        .when(~F.col("_data"), "other_path")
        .when(F.col("_first").isNotNull(), "ok")
        .otherwise("duplicate")
    )
    return parsed.join(first, ["path", "line_no"], "left").select(
        "line_no",
        F.when(F.col("_matches"), F.col("path")).alias("path"),
        F.when(F.col("_matches"), F.col("sha256")).alias("sha256"),
        status.alias("status"),
    )


def reconcile(
    expected: DataFrame, actual: DataFrame, compare: Sequence[tuple[str, str]], key: str = "path"
) -> DataFrame:
    """Full comparison of two manifests by key: ok, missing, unexpected or the first differing column.

    `compare` pairs a column with the status its difference gets.
    """
    columns = [c for c, _ in compare]
    left = expected.select(key, F.lit(True).alias("_e"), *[F.col(c).alias(f"expected_{c}") for c in columns])
    right = actual.select(key, F.lit(True).alias("_a"), *[F.col(c).alias(f"actual_{c}") for c in columns])
    status = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "unexpected")
    for column, name in compare:
        status = status.when(~F.col(f"expected_{column}").eqNullSafe(F.col(f"actual_{column}")), name)
    return left.join(right, key, "full_outer").withColumn("status", status.otherwise("ok")).drop("_e", "_a")


def integrity_summary(
    reconciled: DataFrame, read_errors: DataFrame, splits: Sequence[str] = SPLITS, split: Column | None = None
) -> DataFrame:
    """Per split expected, actual, missing, unexpected, mismatched and error counts with an ok flag."""
    where = path_split(F.col("path")) if split is None else split
    status = F.col("status")
    counts = reconciled.groupBy(where.alias("split")).agg(
        F.count_if(status != "unexpected").alias("expected"),
        F.count_if(status != "missing").alias("actual"),
        F.count_if(status == "missing").alias("missing"),
        F.count_if(status == "unexpected").alias("unexpected"),
        F.count_if(~status.isin("ok", "missing", "unexpected")).alias("mismatched"),
    )
    errors = read_errors.groupBy(where.alias("split")).agg(F.count(F.lit(1)).alias("read_errors"))
    every = reconciled.sparkSession.createDataFrame([(s,) for s in splits], "split string")
    filled = every.join(counts, "split", "left").join(errors, "split", "left").na.fill(0)
    bad = F.col("missing") + F.col("unexpected") + F.col("mismatched") + F.col("read_errors")
    return filled.withColumn("integrity_ok", (bad == 0) & (F.col("expected") > 0))


def integrity_status(summary: DataFrame, manifest_errors: int = 0) -> DataFrame:
    """PASS only if something was expected and nothing differs anywhere."""
    bad = F.sum(F.col("missing") + F.col("unexpected") + F.col("mismatched") + F.col("read_errors"))
    clean = (F.sum("expected") > 0) & (bad == 0) & F.lit(manifest_errors == 0)
    return summary.agg(
        F.when(clean, "PASS").otherwise("FAIL").alias("status"),
        F.sum("expected").alias("expected_files"),
        F.sum("actual").alias("actual_files"),
        F.sum("missing").alias("missing_files"),
        F.sum("unexpected").alias("unexpected_files"),
        F.sum("mismatched").alias("mismatched_files"),
        F.sum("read_errors").alias("read_errors"),
    )


def build_manifest(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """(path, size_bytes, row_count, sha256) of the Parquet files below `path`, of any size; paths without their scheme."""
    rows = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .parquet(path)
        .groupBy(F.col("_metadata.file_path").alias("path"))
        .agg(F.count(F.lit(1)).alias("row_count"))
    )
    plain = F.regexp_replace(F.col("path"), "^[A-Za-z][A-Za-z0-9+.-]*:/*", "/")
    joined = file_digests(spark, path, pattern).withColumn("path", plain).join(rows.withColumn("path", plain), "path", "left")
    return joined.select("path", "size_bytes", F.coalesce("row_count", F.lit(0)).cast("long").alias("row_count"), "sha256")


def fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One hash of a table and its row count, independent of row order; repeated rows count.

    A row is the texts of its columns, each after its length in bytes, with `-` for null, so that no two rows look
    alike. The four 64-bit parts of the row hashes are summed, which keeps a constant state that combines before the
    shuffle; the sums and the count are hashed again.
    """
    texts = [F.col(c).cast("string") for c in columns]
    marked = F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])
    row = df.select(F.sha2(marked, 256).alias("h"))
    parts = [F.conv(F.substring("h", 1 + 16 * i, 16), 16, 10).cast("decimal(28,0)") for i in range(4)]
    sums = row.agg(
        F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.sum(p), F.lit(0)).cast("decimal(38,0)").alias(f"s{i}") for i, p in enumerate(parts)]
    )
    joined = F.concat_ws("|", *[F.col(c).cast("string") for c in ("rows", "s0", "s1", "s2", "s3")])
    return sums.select(F.sha2(joined, 256).alias("fingerprint"), "rows")


def split_violations(
    df: DataFrame, split: str, allowed: Sequence[object], label: str = "label", split_column: str = "split"
) -> DataFrame:
    """Rows of another split or with a label the split must not hold, counted by reason."""
    reason = F.when(F.col(split_column) != split, "wrong_split").when(
        ~F.coalesce(F.col(label).isin(*allowed), F.lit(False)), "label_not_allowed"
    )
    return df.withColumn("reason", reason).where("reason is not null").groupBy("reason").agg(
        F.count(F.lit(1)).alias("n")
    )
