"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from netsieve.catalog import RUNNERS
from netsieve.session import local_session

HEADLINE = (
    "sessionize",
    "sessions",
    "session_packets",
    "session_tensor",
    "ingestion_report",
    "audit_sessions",
    "schedule_labels",
    "decode_headers",
    "byte_entropy",
    "split_routing",
    "capture_groups",
    "session_bounds",
    "row_validation",
    "manifest_reconciliation",
    "classification_summary",
    "ranking_metrics",
    "roc_curve",
    "unknown_breakdown",
    "class_geometry",
    "stratified_batches",
    "mean_covariance",
    "quantile_landmarks",
    "gaussianised",
    "nearest_class",
    "lambda_sweep",
    "lambda_grid",
    "open_set_evaluation",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = [a for a in sys.argv[1:] if a in RUNNERS] or HEADLINE
    spark = local_session("bench", cores, int(cores))
    spark.sparkContext.setLogLevel("ERROR")
    # One small query first, so that starting the workers is not charged to a headline query.
    RUNNERS["byte_entropy"](spark, sf_dir).limit(10).collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        RUNNERS[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
