"""Seconds per headline query, as one JSON line.

    BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 2: the
    first run is reported as cold, the best one as the time of the query)
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "check_split", "findings_agg", "check_dup_batch", "check_reference", "check_schema", "mask_table", "silver_upsert",
    "gold_risk_score", "gold_claims_summary", "gold_customer_360", "gold_fraud_watchlist", "alert_episodes",
    "incident_rollup", "lineage_downstream", "node_status", "throughput", "sla_status", "stream_checks",
]


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from tidewatch.plans.catalog import QUERIES
    from tidewatch.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    best, cold = {}, {}
    for key in HEADLINE:
        times = []
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        best[key], cold[key] = round(min(times), 3), round(times[0], 3)
    print(json.dumps({"metric": "headline queries, total of best runs", "value": round(sum(best.values()), 3), "unit": "sec",
                      "queries": best, "cold": cold, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
