"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then $BENCH_RUNS times in full, written to the
``noop`` sink; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from hazeline.session import local_session
from hazeline.testbed.registry import QUERIES

HEADLINE = [
    "readings_clean", "pivot_daily", "pivot_best", "fact_daily", "fact_aggregated", "dim_dates",
    "quality_report", "focus_vs_peers", "ml_features", "projection_90d", "sensor_days",
    "city_feed_incremental", "anti_join_new", "regression_metrics", "trend_monthly", "coverage",
]
RUNS = int(os.environ.get("BENCH_RUNS", "2"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    timings = {}
    for name in names:
        runs = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(runs[1:] or runs), 3)
        print(name, [round(r, 2) for r in runs], file=sys.stderr, flush=True)
    total = round(sum(timings.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {"metric": "headline_total", "value": total, "unit": "sec", "queries": timings, "sf": sf}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
