"""Bench: run the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

Prints one JSON line::

    {"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Each query is forced to completion with the ``noop`` sink (the whole plan
runs, nothing is collected to the driver).  The first query also pays
for the JVM warm-up, so a throw-away warm-up query runs first.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "reading_sessions",
    "sessions_all_wikis",
    "graph_edges",
    "graph_nodes",
    "text_vectors",
    "more_like_this",
    "vector_neighbors",
    "next_page_metrics",
    "vector_metrics_by_split",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE

    from readpaths.session import get_spark

    parts = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", 4 * int(cpus)))
    spark = get_spark(master=f"local[{cpus}]", app_name="readpaths-bench", shuffle_partitions=parts)
    from readpaths.plans import catalog

    qs = catalog.queries()
    # warm-up: JVM, parquet footers, codegen caches
    qs["scan_pageviews"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
    }))


if __name__ == "__main__":
    main()
