"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES
(comma-separated names, default the list below).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "split_exact_lineitem",
    "split_stratified",
    "label_encode",
    "metrics_by_split",
    "bow_vocabulary",
    "bow_counts",
    "bow_ngrams",
    "bleu_corpus",
    "ter_corpus",
    "knn_distance",
    "knn_blocked",
    "logreg",
    "forest",
    "gbt",
    "text_pipeline",
    "pdp_linear",
    "pfi_linear",
    "shap_logistic",
    "tune_tpe",
    "leaderboard",
    "ingest_csv",
    "excel_scan",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from tablelab.catalog import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tablelab-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderstatus").count().collect()  # warm up
    times = {}
    for name in names:
        start = time.perf_counter()
        # every row and column is computed, nothing is written
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    print(json.dumps({
        "metric": "total wall-clock of the headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
