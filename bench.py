"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the number of local cores. Each
query runs once to warm up and up to ``BENCH_RUNS`` times for its median, but
only once after ``BENCH_SECONDS`` in all; ``runs`` says how many times each was timed. Rows go to the no-op sink: every column
is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from stepview.plans.queries import QUERIES


def timed(spark: SparkSession, name: str, sf: str) -> float:
    begun = time.perf_counter()
    QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begun


def main(names: list[str]) -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    until = time.perf_counter() + float(os.environ.get("BENCH_SECONDS", "240"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds, counted = {}, {}
    for name in names or QUERIES:
        timed(spark, name, sf)
        times = [timed(spark, name, sf)]
        while len(times) < runs and time.perf_counter() < until:
            times.append(timed(spark, name, sf))
        seconds[name], counted[name] = round(statistics.median(times), 3), len(times)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_median_seconds", "value": total, "unit": "sec", "queries": seconds, "runs": counted, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
