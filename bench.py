"""Headline queries, timed warm: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all cores), BENCH_RUNS (default 3).
"""

from __future__ import annotations

import json
import os
import statistics
import time

from sitequarry.plans.suite import QUERIES
from sitequarry.session import build_session

HEADLINE = [
    "category_statistics",
    "category_statistics_by_customer",
    "routes_dispatched",
    "retry_resolution",
    "page_assembly",
    "archived_records",
    "probe_classification",
    "resume_filter",
    "transfer_statistics",
    "posts_search",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        f"local[{cpus}]",
        app="bench",
        spark__ui__enabled="false",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "7g"),
    )
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in HEADLINE:
        once(name)
        seconds[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(folder.rstrip("/"))
    print(json.dumps({"metric": "total warm time of headline queries", "value": total, "unit": "sec",
                      "queries": seconds, "sf": scale}))


if __name__ == "__main__":
    main()
