"""Time the headline queries and print one JSON line.

BENCH_SF_DIR  folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_QUERIES comma-separated names, or 'all'
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from counterpoise.plans import catalog

HEADLINE = [
    "class_distribution", "oversample", "oversample_fractional", "undersample", "smote_balanced", "knn_classify",
    "bootstrap", "stratified_partition", "multinomial", "describe", "partition_frequencies", "variance", "column_means",
    "info_gain", "cat_gain", "num_split", "forest_train_global", "forest_predict", "imbalance_metrics", "online_auc",
    "tokens", "dictionary", "tfidf_normalized", "collocations_llr", "hash_text", "dist_euclidean", "rowsim_cosine",
    "rowsim_threshold", "at_a_v", "project", "cg_solve", "ssvd_values",
]


WORK = "file:///tmp/checkpoints"


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    asked = os.environ.get("BENCH_QUERIES", "")
    names = HEADLINE if not asked else list(catalog.QUERIES) if asked == "all" else asked.split(",")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", WORK)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times, failed = {}, {}
    for name in names:
        start = time.perf_counter()
        try:
            catalog.QUERIES[name](spark, path).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
        except Exception as error:  # a failed query must not hide the others
            failed[name] = str(error)[:200]
        print(name, times.get(name, "failed"), file=sys.stderr, flush=True)
    line = {
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(path.rstrip("/")).removeprefix("sf"), "cpus": int(cpus), "driver_memory": "16g",
    }
    if failed:
        line["failed"] = failed
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
