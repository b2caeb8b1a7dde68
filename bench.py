"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Each query runs once to warm up and then BENCH_RUNS times (default 3); the median counts.
Results go to Spark's no-op sink, so every row and column is computed and none is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HEADLINE = [
    *[f"q{n:02d}_" for n in range(1, 23)],
    "s03_", "s06_", "r01_", "r05_", "r08_", "x05_", "x09_", "x10_", "e01_", "e02_", "e05_", "e07_", "e08_", "e11_",
    "d01_", "d05_", "d09_", "d13_",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

    from weftline.plans import QUERIES
    from weftline.session import build_session

    spark = build_session(
        app="bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    only = tuple(sys.argv[1:]) or tuple(HEADLINE)
    timings: dict[str, float] = {}
    for key, fn in QUERIES.items():
        if not key.startswith(only):
            continue
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            fn(spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        timings[key] = round(statistics.median(taken[1:]), 3)
        print(f"{key} first {taken[0]:.2f}s median {timings[key]:.2f}s", file=sys.stderr, flush=True)
    name = os.path.basename(folder.rstrip("/"))
    print(json.dumps({
        "metric": "total time of headline queries (median of warm runs)",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": float(name[2:]) if name.startswith("sf") else name,
        "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
