"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import functions as F

from tributary import Predicate, join
from tributary.plans.queries import QUERIES
from tributary.session import local_session

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
HEADLINES = ("inner_simple_hash", "inner_sort_merge", "inner_block_nested_loop", "equi_composite_computed", "theta_interval_self", "anti_set", "anti_bag", "progressive_late", "stream_symmetric_hash")


def million(strategy: str):
    """The reference harness's shape: a million distinct ints against a hundred thousand, both shuffled."""
    shuffled = lambda s, n, c: s.range(n).select(F.col("id").cast("int").alias(c)).orderBy(F.xxhash64(c, F.lit(42)))
    return lambda s, _: join(shuffled(s, 1_000_000, "a"), shuffled(s, 100_000, "b"), Predicate.equi("a", "b"), strategy)


def main() -> None:
    spark = local_session(CPUS)
    spark.sparkContext.setLogLevel("ERROR")
    runs = {name: QUERIES[name] for name in HEADLINES} | {f"million_{s}": million(s) for s in ("sort_merge", "simple_hash")}
    times = {}
    for name, query in runs.items():
        took = []
        for _ in range(2 if name.startswith("stream") else 4):
            began = time.perf_counter()
            query(spark, SF).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        times[name] = round(statistics.median(took[1:]), 3)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(SF.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
