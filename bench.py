"""Time the headline queries and print one JSON line.

Reads $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS].
"""

from __future__ import annotations

import json
import os
import statistics
import time

from dqspark.session import local_session
from dqspark.workload.queries import registry

HEADLINE = (
    "quality_summary_lineitem", "dedupe_rows_lineitem", "quality_summary", "quality_summary_orders",
    "column_report", "findings", "value_counts", "fuzzy_groups", "clean_run", "clean_run_crm",
    "dedupe_rows", "dedupe_subset_documents", "duplicate_count", "changed_cells", "fill_numeric_median",
    "load_csv",
)
RUNS = int(os.environ.get("BENCH_RUNS", "2"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    queries = registry()
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(RUNS + 1):  # one warm-up
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, total of medians", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
