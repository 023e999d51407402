"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. Each query runs once to warm up
and BENCH_RUNS times measured; the best run counts. Results are consumed in full by the
`noop` sink.
"""

from __future__ import annotations

import json
import os
import re
import tempfile
import time

from loadlens import session
from loadlens.plans.catalog import QUERIES

HEADLINE = [
    "campaign_window_counts",
    "enrich_with_campaign",
    "word_count_words",
    "word_count_spaces",
    "word_count_changelog",
    "points_within_radius",
    "avg_speed_windows",
    "densify_trajectory",
    "lag_quantile",
    "avg_over_time",
    "counter_rate",
    "event_type_runs",
    "ecdf",
    "resample_series",
    "loop_frames",
    "observed_recovery_time",
    "job_capacity",
    "forecast_trend",
    "fleet_plan",
    "stream_campaign_counts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = session.build(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        best = float("inf")
        for attempt in range(runs + 1):
            begin = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if attempt:
                best = min(best, time.perf_counter() - begin)
        seconds[name] = round(best, 3)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
