"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the data, BENCH_CPUS the local
cores. Each query is built and written to the `noop` sink: one warm-up run, then
the median of BENCH_RUNS (default 3).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from accesslens.session import spark_session  # noqa: E402
from contract.queries import QUERIES  # noqa: E402

HEADLINE = [
    "a4_full_scan",
    "a6_latest_rows",
    "r4_last_24h",
    "t1_traffic_per_day",
    "t2_traffic_per_hour",
    "t3_traffic_avg_per_hour",
    "t4_unique_users_per_day",
    "t5_traffic_and_users",
    "t6_hourly_trend",
    "v1_first_visits",
    "v3_visitor_counts",
    "v4_visitor_counts_24h",
    "v5_visitors_by_device",
    "v6_daily_visitors",
    "v7_environment_all",
    "v8_v9_v10_in_one_pass",
    "f4_referrer_counts",
    "f5_daily_referrers",
    "f7_top_referrers",
    "f8_channel_distribution",
    "f9_top_paths",
    "f11_daily_channel_pivot",
    "g2_geo_cube",
    "g6_country_counts",
    "g9_city_geocode",
    "g10_country_counts_24h",
    "h1_status_groups",
    "h5_status_shares",
    "h8_hourly_status_table",
    "h13_error_ips_by_class",
    "l3_sorted_by_os_desc",
    "l4_capped_search",
    "l5_page",
    "s1_streamed_hourly_counts",
]


def timed(run, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = spark_session(
        "accesslens-bench",
        master=f"local[{cpus}]",
        settings={
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        timed(QUERIES[name], spark, sf_dir)
        seconds[name] = round(
            statistics.median(timed(QUERIES[name], spark, sf_dir) for _ in range(runs)), 4
        )
    report = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 4),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
        "runs": runs,
    }
    print(json.dumps(report), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
