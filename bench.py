"""Benchmark the headline queries; prints ONE JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (timed runs per query after one warm-up, default 5; the median is kept).
Each query is executed in full with the ``noop`` sink (no collect to the driver), on a copy of the
page table in 16 files: a single small file would be one task and another plan than a corpus gets.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = ["element_counts", "page_results", "message_classes", "totals_flat", "lint_messages",
            "page_counts"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    from markscope.session import build_session
    from markscope.plans.queries import QUERIES

    spark = build_session(f"local[{cpus}]", shuffle_partitions=cpus)
    files = tempfile.mkdtemp(prefix="markscope-bench-")
    spark.read.parquet(f"{sf_dir}/pages.parquet").repartition(16, "page_id").write.parquet(f"{files}/pages.parquet")
    sf_name, sf_dir = sf_dir, files
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    times: dict[str, float] = {}
    for name in HEADLINE:
        q = QUERIES[name]
        samples = []
        for i in range(runs + 1):
            t = time.perf_counter()
            q(spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:
                samples.append(time.perf_counter() - t)
        times[name] = round(statistics.median(samples), 3)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_name.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": total,
        "unit": "sec",
        "queries": times,
        "pages": pages,
        "pages_per_sec": {k: round(pages / v, 1) for k, v in times.items() if v > 0},
        "cpus": cpus,
        "sf": sf,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
