"""Benchmark the headline queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is forced with Spark's ``noop`` sink (full computation, no driver
collect). Warm JVM: the same queries run once, untimed, on the smallest test
folder first (JIT and generated-code classes, which Spark caches by code
text), then each is timed once on ``BENCH_SF_DIR``. Times are seconds.
Set ``BENCH_WARMUP=0`` for a cold measurement.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "triage_sessions",
    "session_features",
    "placeholder_predictions",
    "kfold_assign",
    "fold_metrics",
    "assemble_submission",
    "cross_fit",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [a for a in sys.argv[1:]] or list(HEADLINE)
    from clickflow.config import local_session
    from clickflow.plans.queries import all_queries

    spark = local_session(cpus, max(cpus, 8))
    qs = all_queries()
    spark.read.parquet(os.path.join(sf_dir, "events.parquet")).count()
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    warm = os.environ.get("BENCH_WARMUP", "1") != "0" and os.path.isdir(warm_dir)
    if warm:
        for name in names:
            qs[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.time()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                "cpus": cpus,
                "warm": warm,
            }
        )
    )


if __name__ == "__main__":
    main()
