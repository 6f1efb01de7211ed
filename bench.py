"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line with the median of three warm runs each."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from transitlake.plans import catalog

HEADLINE = ("freeflow_percentiles", "stop_area_phases", "travel_time_decomposition", "nearest_stops", "run_bounds", "run_summary", "segment_summary", "gtfs_trip_signature")


def main() -> None:
    # Python workers import the library wherever the bench is started from.
    root = os.path.dirname(os.path.abspath(__file__))
    os.environ["PYTHONPATH"] = os.pathsep.join([root, *filter(None, [os.environ.get("PYTHONPATH")])])
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds, exchanges = {}, {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            began = time.perf_counter()
            df = catalog.QUERIES[name](spark, sf_dir)
            df.write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        df.collect()  # the plan as it ran, not timed
        seconds[name] = round(statistics.median(runs[1:]), 3)
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
        # Shuffles that ran; those that Spark used again count once.
        exchanges[name] = sum("Exchange hashpartitioning" in x and "ReusedExchange" not in x for x in plan)
    print(
        json.dumps(
            {
                "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
                "cores": int(cpus), "spark": spark.version, "exchanges": exchanges,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
