"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the number of local cores and
BENCH_QUERIES (optional, comma-separated or ``all``) the queries.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from opscheck.plans.registered import QUERIES

HEADLINE = [
    "missing_allocations", "missing_shipment", "missing_trailer", "missing_trailer_capacity",
    "missing_hold_reason", "failed_transactions", "pending_backlog", "replenishment_blocked",
    "duplicate_groups", "stale_duplicates", "remediation_plan", "remediate_cases", "remediation_scripts",
    "latest_backtag", "hot_record", "raw_messages", "carcass_record", "vendor_lookup", "warehouse_codes",
    "order_payloads", "validate_orders", "load_wont_close_summary", "suite_findings",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("opscheck-bench")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.enabled", "false")
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
             .getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total wall time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
