"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the local cores, ``BENCH_QUERIES`` a comma
separated choice of queries.
"""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from lumenframe.queries import QUERIES

HEADLINE = (
    "prof_column_info", "prof_describe_num", "prof_corr", "prof_value_counts", "prof_quality", "prof_outlier_count",
    "null_median", "null_iterative", "out_zscore", "out_iqr", "enc_label", "enc_tfidf", "norm_l2", "scale_standard",
    "scale_robust", "scale_quantile_uniform", "fs_anova", "fs_freg", "join_count_children", "join_fk_lookup", "join_knn",
    "join_range_eps", "agg_quantile", "agg_box", "agg_kde", "agg_treemap", "win_topn_per_group", "win_stratify",
    "split_holdout", "split_stratified", "cv_kfold", "met_class_report", "met_roc", "met_auc", "met_r2",
    "met_silhouette", "met_calinski", "fn_json_extract", "snk_blocks_from_html", "evt_status_apply", "rec_algorithm",
    "pipe_stats", "pipe_clean", "ml_linreg", "ml_dt_cls", "ml_knn_cls",
)


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = [n for n in (chosen.split(",") if chosen else HEADLINE) if n in QUERIES]
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.log.level", "ERROR").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    # One small query starts the executor threads and the reader before anything is timed.
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        try:
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
        except Exception:
            seconds[name] = None
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    total = round(sum(v for v in seconds.values() if v is not None), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
