"""Registered queries against DuckDB at the smallest scale.

A cross-section runs by default; TALLYSHOP_ALL=1 runs every query.
"""

import os
import sys
from pathlib import Path

import duckdb
import pytest

from tallyshop.plans.catalogue import duckdb_queries, spark_queries

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
from check import TABLES, canonical  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
CROSS_SECTION = {
    "q01_median_gap", "q03_return_reasons", "q06_orders_per_customer_by_age", "q07_revenue_by_region", "q09_return_rate_by_size",
    "item_fact", "order_mart", "customer_360", "customer_distributions", "rfm_segments", "pareto_customers", "cohort_clv",
    "delivery_churn", "promo_kpis", "promo_scorecard", "yearly_churn", "at_risk_targets", "promo_reallocation", "churn_projection",
    "return_by_category", "refund_cutoff", "return_by_delivery_bucket", "str_comparison", "latest_stock_by_segment",
    "cancellation_rate_topk", "daily_customers", "daily_inventory", "daily_promotions", "rule_check", "orphan_keys",
    "iqr_outliers_sales", "monotonic_stock", "spearman_price_cogs", "kruskal_price_by_category", "mutual_information",
    "market_basket_categories", "lag_features", "lag_nearest", "time_series_folds", "seasonal_growth_baseline", "ratio_guard",
}
QUERIES, ORACLES = spark_queries(), duckdb_queries()
CHOSEN = sorted(QUERIES if os.environ.get("TALLYSHOP_ALL") else CROSS_SECTION)

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def test_cross_section_is_registered():
    assert CROSS_SECTION <= set(QUERIES)
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_oracle(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    mine = [tuple(row) for row in frame.collect()]
    if name not in ORACLES:
        assert frame.columns
        return
    cursor = duck.execute(ORACLES[name])
    theirs, columns = cursor.fetchall(), [d[0] for d in cursor.description]
    assert sorted(frame.columns) == sorted(columns)
    assert canonical(mine, frame.columns) == canonical(theirs, columns)
