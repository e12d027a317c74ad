"""Bench: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and
print one JSON line. Each query is collected once to warm up and then timed
(best of $BENCH_REPEATS runs)."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from verdant.plans.catalog import QUERIES  # noqa: E402
from verdant.session import get_session  # noqa: E402

HEADLINE = [
    "peer_comparison", "esg_score", "latest_row", "profile_stats", "describe", "dq_duplicates",
    "trend_direction", "yoy_pivot", "benchmark_compare", "rank_solutions", "kpi_projection",
    "pii_scrub", "profile_extract", "intent_route", "json_extract", "latin1",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = get_session(f"local[{cpus}]", int(cpus) * 2,
                        extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEM", "16g")})
    names = [n for n in HEADLINE if n in QUERIES]
    times = {}
    for name in names:
        QUERIES[name](spark, sf_dir).collect()  # warm-up
        best = None
        for _ in range(repeats):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).collect()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
