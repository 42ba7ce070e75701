"""Time the queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the
local cores. Every query is computed completely and its rows are discarded. The
reported time is that of the first run, which also compiles generated code; the warm one stands beside it.
"""

from __future__ import annotations

import json
import os
import sys
import time

from trackmill.plans.registry import QUERIES
from trackmill.session import local_session

def run(spark, name: str, folder: str) -> float:
    """Seconds to compute one query."""
    started = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - started, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    names = sys.argv[1:] or list(QUERIES)
    spark = local_session(cores, partitions=int(cores) if cores.isdigit() else 8)
    first = {name: run(spark, name, folder) for name in names}
    warm = {name: run(spark, name, folder) for name in names}
    print(
        json.dumps(
            {
                "metric": "all_queries_total",
                "value": round(sum(first.values()), 3),
                "unit": "sec",
                "queries": first,
                "warm_total": round(sum(warm.values()), 3),
                "warm": warm,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
