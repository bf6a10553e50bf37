"""Seconds per headline query at one scale: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local cores,
BENCH_REPEATS how often each query is timed (the median counts). Two queries run untimed first.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from tallyshop.plans.catalogue import spark_queries  # noqa: E402

HEADLINE = (
    "q01_median_gap", "q07_revenue_by_region", "q09_return_rate_by_size", "item_fact", "order_mart",
    "customer_360", "rfm_segments", "segment_summary", "pareto_customers", "cohort_retention",
    "promo_kpis", "promo_scorecard", "yearly_churn", "return_trend", "refund_pareto",
    "str_revenue_corr", "latest_stock_by_segment", "daily_customers", "processed_daily",
    "rule_check", "kruskal_price_by_segment", "market_basket_categories", "lag_features",
    "seasonal_growth_baseline",
)
WARM_UP = ("q07_revenue_by_region", "customer_360")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tallyshop-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = spark_queries(), {}
    names = sys.argv[1:] or HEADLINE

    def run(name: str) -> float:
        started = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    for name in WARM_UP:  # loads classes and compiles the common code paths
        run(name)
    for name in names:
        seconds[name] = round(statistics.median(run(name) for _ in range(repeats)), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": float(scale.group(1)) if scale else folder,
            }
        )
    )


if __name__ == "__main__":
    main()
