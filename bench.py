"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the input folder, BENCH_CPUS the local cores. Each query runs once after a short
warm-up of the session; shared tables are built inside the first query that needs them, so every
second of work is counted.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from paytrace.plans.queries import QUERIES  # noqa: E402
from paytrace.sources.session import build_session  # noqa: E402

HEADLINE = (
    "val12_summary", "gr2_edges", "fa3_amounts", "fs1_transactional", "fs8_two_hour_counterparties", "fs11_inter_arrival",
    "fs12_same_day_turnover", "pt1_fan_in", "pt3_circular_flow", "pt5_rapid_movement", "pt6_structuring", "gr5_weak_components",
    "gr6_strong_components", "pt7_coordinated_networks", "gr11_pagerank", "gr12_two_hop", "gr13_triangles", "fl2_funding",
    "pt9_traced_chains", "fs20_feature_store", "cx1_location_takeover", "cx9_hundi_operators", "ml16_final_score", "rp1_evidence",
    "rp17_linked_transactions", "ev1_rules", "ev4_average_precision", "ev5_roc_auc", "st1_recent_day",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(cpus, shuffle_partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/events.parquet").groupBy("event_type").count().collect()
    times, failed = {}, {}
    for name in HEADLINE:
        start = time.perf_counter()
        try:
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
        except Exception as problem:  # keep timing the rest
            failed[name] = str(problem)[:200]
    out = {
        "metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    if failed:
        out["failed"] = failed
    print(json.dumps(out))


if __name__ == "__main__":
    main()
