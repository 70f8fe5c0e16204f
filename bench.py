"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is timed to a full materialisation (written to Spark's no-op
sink, so nothing is collected to the driver).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cohortwise.plans.catalog import REGISTRY  # noqa: E402
from cohortwise.session import local_session  # noqa: E402

HEADLINE = ["cohort_scores", "radius_counts", "dedupe", "criteria_reason", "explanations", "rank_assign",
            "midrank_pct", "parcel_join", "route_fallback", "upsert", "link_windows", "page_text"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus=cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")))
    names = [n for n in HEADLINE if n in REGISTRY]
    # Two passes: the first pays JVM JIT and code generation for every plan
    # shape (reported as "cold"); the second is the steady state ("queries").
    cold, times, errors = {}, {}, {}
    for target in (cold, times):
        for name in names:
            t0 = time.time()
            try:
                REGISTRY[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
                target[name] = round(time.time() - t0, 3)
            except Exception as exc:  # noqa: BLE001 - report it, keep timing the rest
                target[name] = None
                errors[name] = f"{type(exc).__name__}: {exc}"[:300]
    total = round(sum(v for v in times.values() if v is not None), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times,
                      "sf": sf, "cpus": cpus,
                      "cold_total": round(sum(v for v in cold.values() if v is not None), 3), "cold": cold,
                      **({"errors": errors} if errors else {})}))


if __name__ == "__main__":
    main()
