"""What one task holds: plans that move rows before they group them, and results that stay the same."""

import re
from datetime import date

from tallyshop.operators import daily
from tallyshop.sources.retail_views import retail_catalog

SPEC = daily.DailySpec("2020-01-01", "2020-01-03", order_status=["a", "b"], payment_method=["p"], device_type=["m"], order_source=["s"])
SCHEMA = "order_id long, order_date date, customer_id long, order_status string, payment_method string, device_type string, order_source string"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_orders_of_a_day_count_customers_without_their_sums(spark):
    first, second = date(2020, 1, 1), date(2020, 1, 2)
    rows = [
        (1, first, 7, "a", "p", "m", "s"), (2, first, 7, "b", "p", "m", None), (2, first, 7, "b", "p", "m", None), (None, first, 8, "a", None, "m", "s"),
        (4, second, None, "b", "p", None, "s"), (5, None, 9, "a", "p", "m", "s"), (6, None, 9, "c", "p", "m", "s"),
    ]
    found = daily.orders_by_day(spark.createDataFrame(rows, SCHEMA), SPEC)
    assert {r.date: tuple(r)[1:] for r in found.collect()} == {first: (3, 2, 2, 2, 3, 4, 2), second: (1, 0, 0, 1, 1, 0, 1), None: (2, 1, 1, 0, 2, 2, 2)}
    by_customer = [keys for keys, sums in re.findall(r"Aggregate \[([^\]]*)\], \[(.*)\]", plan(found)) if "customer_id" in keys and "sum(" in sums]
    assert by_customer == [] and "RepartitionByExpression" in plan(found)


def test_lines_meet_by_order_before_they_are_summed(spark, tmp_path):
    line = "l_orderkey long, l_partkey long, l_quantity double, l_extendedprice double, l_discount double"
    rows = [(1, 10, 2.0, 30.0, 0.07), (1, 10, 1.0, 15.0, 0.0), (1, 11, 1.0, 5.0, 0.0), (None, 10, 1.0, 5.0, 0.0), (2, None, 4.0, 8.0, 0.1)]
    spark.createDataFrame(rows, line).repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    items = retail_catalog(spark, str(tmp_path)).order_items
    assert sorted((r.order_id or 0, r.product_id or 0, r.quantity, float(r.unit_price)) for r in items.collect()) == [
        (0, 10, 1, 5.0), (1, 10, 3, 15.0), (1, 11, 1, 5.0), (2, 0, 4, 2.0)
    ]
    physical = items.groupBy("order_id").sum("quantity")._jdf.queryExecution().sparkPlan().toString()
    assert "l_orderkey" in physical[physical.index("Exchange" if "Exchange" in physical else "Repartition"):]


def test_days_are_joined_by_number(spark):
    """A broadcast keyed by a date is a page of 64 MB in every task, whatever its rows; eleven of them are joined in the daily table."""
    day = [date(2020, 1, d) for d in (1, 2, 3)]
    left = spark.createDataFrame([(day[0], 1), (day[1], 2), (day[2], 3), (None, 4)], "date date, a int")
    right = spark.createDataFrame([(day[0], 10), (day[1], 20), (day[1], 21), (None, 40)], "date date, b int")
    found = daily.join_by_day(left, right)
    assert found.columns == ["date", "a", "b"]
    assert sorted((r.a, r.b or 0) for r in found.collect()) == [(1, 10), (2, 20), (2, 21), (3, 0), (4, 0)]
    orders = spark.createDataFrame([(1, day[0], 7, "a", "p", "m", "s"), (2, None, 8, "b", "p", "m", "s")], SCHEMA)
    reviews = spark.createDataFrame([(day[0], 1, 7, 3, 5, "Bad")], "review_date date, order_id long, customer_id long, product_id long, rating int, review_title string")
    for joined in (found, daily.orders_by_day(orders, SPEC), daily.reviews_by_day(reviews, SPEC)):
        keys = re.findall(r"BroadcastExchange HashedRelationBroadcastMode\(List\((.*?)\),", joined._jdf.queryExecution().executedPlan().toString())
        assert keys and all("bigint" in k or "int" in k for k in keys) and not any("date" in k for k in keys)
