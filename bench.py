"""Time every registered query: ``BENCH_SF_DIR`` and ``BENCH_CPUS`` set folder and cores.

Each query writes all its rows to the no-op sink; the time is that of its second run.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tenderlake.plans.catalog import QUERIES
from tenderlake.session import build_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def run(spark, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main(names: list[str]) -> None:
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "12g",
            # Query building keeps no call sites: they cost more than most expressions.
            "spark.python.sql.dataFrameDebugging.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        first = run(spark, name)
        times[name] = round(min(first, run(spark, name)), 3)
        print(f"{name} {first:.2f} {times[name]}", file=sys.stderr, flush=True)
    scale = os.path.basename(os.path.normpath(FOLDER)).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale) if scale.replace(".", "").isdigit() else scale,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:] or list(QUERIES))
