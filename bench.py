"""Seconds per headline query. Prints one JSON line; folder in $BENCH_SF_DIR, cores in $BENCH_CPUS."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from wattloom import catalog  # noqa: E402
from wattloom.session import local_session  # noqa: E402

HEADLINE = [
    "hourly_rollup",
    "hourly_rollup_shipments",
    "calendar_enrich",
    "daily_total_window",
    "load_profile_by_hour",
    "total_by_slice",
    "weekday_slices",
    "hour_aggregation",
    "hour_profile",
    "weekday_deviation",
    "rolling_past_future",
    "spike_times",
    "range_of_work",
    "robust_change_by_hour",
    "feature_row",
    "econ_clean",
    "category_encode",
    "dense_ids",
    "stratified_folds",
    "fold_info",
    "label_feature_join",
    "macro_f1_multi",
    "roc_auc",
    "best_iteration",
    "importance_template",
    "oof_scores",
    "predict_table",
    "train_score_binary",
    "train_score_multi",
    "permutation_importance",
    "score_submission",
    "nullout_decode",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    spark = local_session(cores, memory=os.environ.get("BENCH_MEMORY", "12g"))
    queries = catalog.queries()
    seconds = {}
    for name in HEADLINE:
        best = None
        for _ in range(repeats):
            begin = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            spent = time.perf_counter() - begin
            best = spent if best is None else min(best, spent)
            # Each run reads and shuffles again.
            spark.catalog.clearCache()
        seconds[name] = round(best, 3)
    print(
        json.dumps(
            {
                "metric": "sum of best query seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name,
                "cores": cores,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
