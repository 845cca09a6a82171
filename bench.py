"""Seconds per headline query on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

Every query runs over its whole tables. One untimed query starts the JVM; each
query then runs twice with its full result computed and the faster run counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from timberline.checks.catalog import QUERIES  # noqa: E402
from timberline.session import builder  # noqa: E402

HEADLINE = [
    "access_entries", "error_entries", "container_entries", "api_entries", "database_entries", "syslog_entries", "csv_entries",
    "access_summary", "access_upstream_timing", "access_charts_top_ips", "access_charts_hourly_timeline",
    "access_charts_response_time_histogram", "access_tables_endpoint_performance", "access_tables_hourly_performance",
    "access_tables_ip_details", "access_tables_status_codes", "access_dimensions", "error_charts_top_messages",
    "container_tables_error_samples", "api_summary", "api_tables_endpoint_details", "database_summary",
    "database_normalized_queries", "database_duration_stats", "syslog_summary", "syslog_tables_anomaly_samples",
    "csv_tables_ip_details", "csv_summary", "detect_types", "batch_overview", "correlate_timeline", "error_context",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        builder("bench").master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g")).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.time() - start

    run("access_charts_method_distribution")
    seconds = {name: round(min(run(name), run(name)), 3) for name in HEADLINE}
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
