"""Time the headline queries on local Spark; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 4) the threads,
BENCH_QUERIES a comma-separated choice of registered queries, BENCH_RUNS the runs of each: the last counts.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from rollbook import registry

HEADLINE = "student_day,short_horizon_dataset,chronic_20,chronic_year_20,lesson_dataset,asof_combined"


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus, runs = int(os.environ.get("BENCH_CPUS", "4")), int(os.environ.get("BENCH_RUNS", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(2 * cpus))
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found, seconds = registry.queries(), {}
    for name in os.environ.get("BENCH_QUERIES", HEADLINE).split(","):
        for _ in range(runs):
            began = time.perf_counter()
            found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - began, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline queries, warm, total", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir.rpartition("sf")[2]}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
