"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

import json
import os
import statistics
import time

from waymark.plans.catalogue import QUERIES
from waymark.session import build_session

HEADLINE = ["exposure_index", "interval_overlap_binned", "interval_overlap_theta", "annual_mean_of_daily_counts", "nearest_point_haversine", "nearest_within_tol", "quantile_class_ties", "pct_rank_average", "global_rank", "describe_exact", "evidence_rollup", "consecutive_gradient", "local_context", "topn_share", "threshold_sweep"]
RUNS = 2


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", int(cpus))
    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).collect()
            times.append(time.perf_counter() - start)
        took[name] = round(statistics.median(times[1:]), 4)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
