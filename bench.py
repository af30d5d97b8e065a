"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (data folder), BENCH_CPUS (local cores), BENCH_QUERIES (comma-separated names).
"""

from __future__ import annotations

import json
import os
import time

from stowline.session import local_session
from stowline.workload import load_all
from stowline.workload.registry import QUERIES, Tables

HEADLINE = (
    "confirmed_dups", "classify", "exclude_roots", "apply_delta", "extra_local", "replica_health", "goal_locations", "need_place",
    "choose_source", "admit_largest", "build_plan", "simulate", "check_space", "check_last_copy", "transition_audit", "public_items",
    "redact", "metric_rollup", "stream_inventory",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark = local_session(cpus, "bench")
    load_all()
    Tables(spark, sf_dir)("lineitem").count()
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](Tables(spark, sf_dir)).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    tables = Tables(spark, sf_dir)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus, "spark": spark.version,
        "rows": {n: tables(n).count() for n in ("lineitem", "documents", "events", "orders")},
    }), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
