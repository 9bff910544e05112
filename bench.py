"""Benchmark: run the registered queries on $BENCH_SF_DIR (default /root/testdata/sf0.1) with
local[$BENCH_CPUS]; print one JSON line with per-query seconds and their total.

Each query is executed to completion through the no-op sink (the whole plan runs, nothing is
collected to the driver). Set BENCH_QUERIES=a,b,c to run a subset.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from worthrank.plans import REGISTRY
    from worthrank.session import build_session, checkpoint_dir

    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(2 * cpus, 8), app_name="worthrank-bench")
    checkpoint_dir(spark)
    wanted = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    names = wanted or list(REGISTRY)

    # warm-up: JVM, Python workers, file listing
    REGISTRY["ranking_metrics"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()

    timings: dict[str, float] = {}
    errors: dict[str, str] = {}
    for name in names:
        t0 = time.perf_counter()
        try:
            REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            timings[name] = round(time.perf_counter() - t0, 3)
        except Exception as e:  # noqa: BLE001
            errors[name] = f"{type(e).__name__}: {str(e)[:200]}"
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {"metric": "total_query_seconds", "value": round(sum(timings.values()), 3), "unit": "sec",
           "queries": timings, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
           "cpus": cpus, "spark": spark.version, "n_queries": len(timings)}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))


if __name__ == "__main__":
    main()
