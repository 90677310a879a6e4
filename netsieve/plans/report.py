"""The nested metric document of an open-set evaluation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from netsieve.operators.mahalanobis import thresholds_for
from netsieve.plans.open_set import OpenSetResult

#: Version of the document's layout.
DOCUMENT_FORMAT = 3


def _by_name(df: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """One row with a map from the texts of `key` to a struct of `values`; a row of `df` for each class or subtype."""
    entry = F.struct(F.col(key).cast("string").alias("key"), F.struct(*values).alias("value"))
    return df.where(F.col(key).isNotNull()).agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("made"))


def _named(names: Mapping[str, int], index: Column) -> Column:
    """The name of a class; its number where it has none."""
    pairs = [F.lit(x) for name, i in names.items() for x in (int(i), name)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), index.cast("int")), index.cast("string"))


def metric_document(result: OpenSetResult, run: str, created_at: str, sample_counts: Mapping[str, int] | None = None, notes: Mapping[str, str] | None = None) -> DataFrame:
    """One row: the settings, calibration, chosen sweep row and all test metrics, nested as readers of result documents expect.

    Everything is taken from frames of one row, or of one row for each class or subtype; the curve has at most 5,000 points. A
    result without a selected lambda has no test metrics and is an error; its sweep is `sweep_document`.
    """
    if result.measured is None:
        raise ValueError("without a selected lambda there are no test metrics")
    settings, shield = result.settings, result.shield
    thresholds = thresholds_for(shield.calibration, settings.selected)
    names = {i: name for name, i in settings.known.items()}
    calibration = F.create_map(
        *[
            x
            for c, v in shield.calibration.items()
            for x in (
                F.lit(names.get(c, str(c))),
                F.struct(
                    F.lit(int(v.count)).cast("long").alias("count"), F.lit(v.median).alias("median"),
                    F.lit(v.mad).alias("mad"), F.lit(thresholds[c]).alias("threshold"),
                ),
            )
        ]
    )
    chosen = result.sweep.where(F.abs(F.col("lambda") - settings.selected) <= 1e-12)
    selected = chosen.select(F.struct(*chosen.columns).alias("selected_lambda_validation"), F.col("global_frr").alias("val_frr"))
    ranking = result.ranking.select(F.col("auroc").alias("ood_auroc"), F.col("average_precision").alias("ood_aupr"), F.col("fpr_at_tpr").alias("fpr_at_95_tpr"))
    raw = result.raw_ranking.select(F.col("auroc").alias("ood_auroc_raw_mahalanobis"))
    curve = result.roc.agg(F.sort_array(F.collect_list(F.struct("point_no", "fpr", "tpr", "threshold"))).alias("points"))
    curve = curve.select(F.struct(*[F.col(f"points.{c}").alias(c) for c in ("fpr", "tpr", "threshold")]).alias("roc_curve"))
    breakdown = ["support", "detected_as_ood", "ood_recall", "score_mean", "score_median"]
    by_class = result.by_class.withColumn("name", _named(settings.unknown, F.col("label")))
    per_class = _by_name(by_class, "name", [*breakdown, "score_min", "score_max"]).withColumnRenamed("made", "per_ood_class")
    parts = [result.binary, ranking, raw, curve, result.degradation, selected, per_class]
    if result.by_subtype is not None:
        parts.append(_by_name(result.by_subtype, result.subtype, breakdown).withColumnRenamed("made", "per_ood_subtype"))
    whole = parts[0]
    for part in parts[1:]:  # one row each
        whole = whole.join(F.broadcast(part))
    configuration = F.struct(
        F.lit("PCA -> quantiles -> Mahalanobis").alias("pipeline_order"), F.lit("train_known").alias("fit_split"),
        F.lit("val_known").alias("lambda_selection_split"), F.lit("test_known + test_ood").alias("final_test_split"),
        F.lit(len(shield.marks[0])).alias("quantile_count"), F.lit(settings.sample).cast("long").alias("quantile_subsample_size"),
        F.lit(float(settings.variance)).alias("pca_variance_target"), F.lit(shield.pca.retained).alias("pca_variance_actual"),
        F.lit(shield.pca.k).alias("pca_components"), F.lit(float(settings.epsilon)).alias("ridge_epsilon_init"),
        F.array(*[F.lit(float(x)) for x in settings.lambdas]).alias("lambda_candidates"),
        F.lit(float(settings.selected)).alias("selected_lambda_mad"), F.lit(float(settings.max_frr)).alias("max_val_known_frr"),
        F.col("val_frr").alias("selected_lambda_val_frr"), F.lit("score >= 1").alias("rejection_rule"),
    )
    detection = [*result.binary.columns, *ranking.columns, "roc_curve"]
    metrics = F.struct(
        F.struct(*detection).alias("binary_detection"),
        "ood_auroc_raw_mahalanobis",
        F.struct(*result.degradation.columns).alias("known_degradation"),
        "per_ood_class",
        *(["per_ood_subtype"] if result.by_subtype is not None else []),
    )
    extra = []
    if sample_counts:
        extra.append(F.struct(*[F.lit(int(n)).cast("long").alias(k) for k, n in sample_counts.items()]).alias("sample_counts"))
    if notes:
        extra.append(F.struct(*[F.lit(v).alias(k) for k, v in notes.items()]).alias("notes"))
    return whole.select(
        F.lit(DOCUMENT_FORMAT).alias("schema_version"),
        F.lit(run).alias("run"),
        F.lit(created_at).alias("created_at_utc"),
        F.map_from_entries(F.array(*[F.struct(F.lit(n), F.lit(int(i))) for n, i in settings.known.items()])).alias("class_to_idx"),
        F.map_from_entries(F.array(*[F.struct(F.lit(n), F.lit(int(i))) for n, i in settings.unknown.items()])).alias("ood_class_to_idx"),
        *extra,
        configuration.alias("osr_configuration"),
        calibration.alias("calibration_by_class"),
        "selected_lambda_validation",
        metrics.alias("metrics"),
    )


def sweep_document(result: OpenSetResult, run: str, created_at: str) -> DataFrame:
    """One row: the validation sweep, with a row for each candidate."""
    settings, shield = result.settings, result.shield
    columns = [c for c in result.sweep.columns if c != "lambda"]
    rows = F.sort_array(F.collect_list(F.struct(F.col("lambda").alias("lambda_mad"), *_plain(result.sweep, columns))))
    return result.sweep.agg(rows.alias("lambda_results")).select(
        F.lit(run).alias("run"),
        F.lit(created_at).alias("created_at_utc"),
        F.lit("val_known").alias("selection_split"),
        F.lit(False).alias("test_splits_used"),
        F.lit(float(settings.variance)).alias("pca_variance_target"),
        F.lit(shield.pca.retained).alias("pca_variance_actual"),
        F.lit(shield.pca.k).alias("pca_components"),
        F.lit(float(settings.max_frr)).alias("max_val_known_frr"),
        F.array(*[F.lit(float(x)) for x in settings.lambdas]).alias("lambda_candidates"),
        "lambda_results",
    )


def _plain(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Maps as sorted entries, since a struct with a map cannot be ordered."""
    maps = {f.name for f in df.schema.fields if f.dataType.typeName() == "map"}
    return [F.sort_array(F.map_entries(c)).alias(c) if c in maps else F.col(c) for c in columns]
