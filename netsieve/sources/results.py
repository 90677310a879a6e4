"""Metric documents in and result tables out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Fixed paths of the metric documents: output column -> (path, type).
RESULT_FIELDS = {
    "pca_components_real": ("osr_configuration.pca_components", "int"),
    "pca_variance_actual": ("osr_configuration.pca_variance_actual", "double"),
    "selected_lambda_mad": ("osr_configuration.selected_lambda_mad", "double"),
    "val_frr": ("osr_configuration.selected_lambda_val_frr", "double"),
    "known_frr": ("metrics.binary_detection.known_false_rejection_rate", "double"),
    "ood_recall": ("metrics.binary_detection.ood_recall", "double"),
    "ood_precision": ("metrics.binary_detection.ood_precision", "double"),
    "ood_f1": ("metrics.binary_detection.ood_f1", "double"),
    "ood_auroc": ("metrics.binary_detection.ood_auroc", "double"),
    "ood_aupr": ("metrics.binary_detection.ood_aupr", "double"),
    "binary_mcc": ("metrics.binary_detection.binary_mcc", "double"),
    "balanced_accuracy": ("metrics.binary_detection.balanced_accuracy", "double"),
    "mcc_after_shield": ("metrics.known_degradation.mcc_after_shield", "double"),
    "known_rejected": ("metrics.known_degradation.known_rejected", "int"),
}


def finite_or_null(value: Column) -> Column:
    number = value.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def _document_schema() -> StructType:
    """Nested text fields of all wanted paths, plus the place for an unreadable document."""
    tree: dict = {}
    for path, _ in RESULT_FIELDS.values():
        node = tree
        for part in path.split("."):
            node = node.setdefault(part, {})

    def build(node: dict) -> StructType:
        return StructType([StructField(k, build(v) if v else StringType()) for k, v in node.items()])

    return build(tree).add("_broken", StringType())


def flatten_results(documents: DataFrame, text: str = "value") -> DataFrame:
    """Flat metric columns from JSON text; missing keys and non-finite numbers become null."""
    options = {"columnNameOfCorruptRecord": "_broken", "allowNonNumericNumbers": "true"}
    doc = documents.withColumn("_doc", F.from_json(F.col(text), _document_schema(), options))

    def field(path: str, kind: str) -> Column:
        value = F.col(f"_doc.{path}")
        return value.try_cast("int") if kind == "int" else finite_or_null(value)

    status = (
        F.when(F.col(text).isNull(), "MISSING_JSON")
        .when(F.col("_doc._broken").isNotNull(), "JSON_READ_ERROR")
        .otherwise("OK")
    )
    kept = [c for c in documents.columns if c != text]
    return doc.select(*kept, status.alias("status"), *[field(p, k).alias(n) for n, (p, k) in RESULT_FIELDS.items()])


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """One flat row per metric document file."""
    texts = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("result_json_path"), "value"
    )
    return flatten_results(texts)


def write_documents(documents: DataFrame, path: str, run: str = "run") -> None:
    """Write nested rows as JSON documents, one file below `path/run=<run>` for each; runs of `documents` that stand there are
    replaced and other runs stay. `run` names a document and must be unique."""
    body = F.to_json(F.struct(*[F.col(f"`{c}`") for c in documents.columns]))
    named = documents.select(F.col(run).alias("run"), body.alias("value"))
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").text(path)


def sorted_json(value: Column) -> Column:
    """A map as JSON text with its keys in order."""
    return F.to_json(F.map_from_entries(F.sort_array(F.map_entries(value))))


def plain_columns(df: DataFrame) -> DataFrame:
    """Maps become sorted JSON text, arrays and structs JSON text, so that flat formats can hold them."""
    out = []
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        c = F.col(f"`{field.name}`")
        if kind == "map":
            c = sorted_json(c).alias(field.name)
        elif kind in ("array", "struct"):
            c = F.to_json(c).alias(field.name)
        out.append(c)
    return df.select(*out)


def markdown_rows(df: DataFrame) -> DataFrame:
    """(line) of a Markdown table's body, one per row."""
    flat = plain_columns(df)
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in flat.columns]
    return flat.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def markdown_head(columns: list[str]) -> list[str]:
    return ["| " + " | ".join(columns) + " |", "|" + "|".join(["---"] * len(columns)) + "|"]


def write_results(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Write a result table as json, csv (with header) or markdown."""
    if fmt == "json":
        df.write.mode("overwrite").json(path)
    elif fmt == "csv":
        plain_columns(df).write.mode("overwrite").option("header", True).csv(path)
    elif fmt == "markdown":
        head = df.sparkSession.createDataFrame([(line,) for line in markdown_head(df.columns)], "line string").coalesce(1)
        head.unionByName(markdown_rows(df)).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown result format {fmt!r}")
