"""Benchmark: derive and store the base table, then time every registered query.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPEAT (default 3; best of N per query), BENCH_CACHE (default 0: every
query reads the month-partitioned parquet; 1 keeps the base table cached in
executor memory, as the baseline probe did), BENCH_EVENTLOG (a folder:
write Spark's event log there for stage/task times; off by default). Prints
ONE JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = max(1, int(os.environ.get("BENCH_REPEAT", "3")))
    cache = os.environ.get("BENCH_CACHE", "0") == "1"

    extra = {"spark.checkpoint.dir": tempfile.mkdtemp(prefix="tierscope-bench-")}
    if os.environ.get("BENCH_EVENTLOG"):
        extra.update({"spark.eventLog.enabled": "true",
                      "spark.eventLog.dir": os.environ["BENCH_EVENTLOG"]})

    from tierscope.session import get_or_create_session
    spark = get_or_create_session(
        f"local[{cpus}]", shuffle_partitions=cpus, app_name="tierscope-bench", extra=extra)

    from tierscope.plans import maintained, registry
    from tierscope.sources.base_table import load_base_table

    t0 = time.perf_counter()
    base = load_base_table(spark, sf_dir)
    if cache:
        from pyspark import StorageLevel
        base.persist(StorageLevel.MEMORY_AND_DISK)
    n_rows = base.count()
    build = time.perf_counter() - t0

    times: dict[str, float] = {}
    cold: dict[str, float] = {}
    rows: dict[str, int] = {}
    kept = maintained.queries()
    for name, fn in (registry.queries() | kept).items():
        best = first = None
        for _ in range(repeat):
            t = time.perf_counter()
            out = fn(spark, sf_dir).collect()
            dt = time.perf_counter() - t
            first = dt if first is None else first
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)
        cold[name] = round(first, 3)
        rows[name] = len(out)

    sf = os.path.basename(os.path.normpath(sf_dir)).replace("sf", "")
    print(json.dumps({
        "metric": "sum_query_sec",
        "value": round(sum(t for n, t in times.items() if n not in kept), 3),
        "unit": "sec",
        "queries": {n: t for n, t in times.items() if n not in kept},
        "maintained_queries": {n: t for n, t in times.items() if n in kept},
        "first_run": cold,
        "build_base_table_sec": round(build, 3),
        "base_rows": n_rows,
        "result_rows": rows,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": cpus,
        "repeat": repeat,
        "base_cached": cache,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
