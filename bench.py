"""Time the headline queries: BENCH_SF_DIR, BENCH_CPUS. Prints one JSON line.

Each query is built and run to the last row (results are discarded, not collected), once
to warm up and then BENCH_RUNS times; the median counts. Rounding for the comparison with
the second engine is left out.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from dataloom.plans.shared import clear_scratch  # noqa: E402
from dataloom.queries import all_queries, tables  # noqa: E402

HEADLINE = [
    "describe", "column_info_lineitem", "correlation_matrix", "duplicate_count",
    "distinct_profile", "quality_metrics_lineitem", "clean_lineitem", "transform", "engineer",
    "ts_month", "histogram", "box_summary", "group_describe", "outlier_report", "kde_by_group",
    "smoothed_sorted", "type_suggestions", "row_diff", "value_diff_positional", "content_hash",
    "train_test_sizes", "build_vocab", "encode_pairs", "job_latest_state", "log_tail",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("dataloom-bench")
        .config("spark.sql.shuffle.partitions", cores if cores != "*" else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    tables.ROUND = False
    queries = all_queries()
    times: dict[str, float] = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:]), 3)
        clear_scratch(spark)
    print(json.dumps({
        "metric": "sum of median seconds of the headline queries",
        "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "cpus": cores, "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
