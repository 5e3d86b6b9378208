"""Headline queries, timed; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tabulon.queries.catalog import QUERIES  # noqa: E402
from tabulon.session import local_session  # noqa: E402

HEADLINES = (
    "prepare_data", "dedupe", "clean_numeric_3sigma", "iqr_filter", "impute_median", "impute_ffill", "impute_table",
    "encode_onehot", "encode_label", "encode_target", "encode_target_crossfit", "scale_table", "scale_robust",
    "describe_numeric", "data_summary", "nunique", "categorical_topk", "correlation_matrix", "chi2_statistics",
    "crosstab", "recommend", "target_mean", "feat_polynomial", "select_kbest_mi", "select_kbest_f",
    "plot_histogram", "plot_box", "plot_kde", "split_holdout", "fold_stratified", "classification_metrics", "roc_auc",
    "roc_curve", "regression_metrics", "drift_ks", "knn_join", "latest_version", "keep_latest_n", "compare_models",
    "request_log_stats", "linear_regression", "ridge", "lasso", "elastic_net", "naive_bayes", "logistic_regression",
    "random_forest_regressor", "cross_val_score", "grid_search", "predict", "stream_request_stats",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session("bench", cores)
    QUERIES["shape"](spark, folder).collect()  # starts the executors
    wanted = sys.argv[1:] or HEADLINES
    times = {}
    for name in wanted:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cores": int(cores),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
