"""What keeps the churn queries cheap, with results that stay the same."""

import re

from pyspark.sql import functions as F

from tallyshop.operators import marts, models
from tallyshop.session import sorted_groups


def test_the_forest_keeps_the_nodes_its_rows_have_reached(spark):
    rows = spark.range(400).selectExpr(
        "id AS customer_id", *[f"cast((id * {k}) % 17 AS double) AS {c}" for k, c in enumerate(models.CHURN_FEATURES, 3)],
        "cast(id % 3 = 0 AS double) AS label", "id % 5 > 0 AS is_train",
    ).repartition(4)
    churn = models.churn_classifier(rows, trees=5, depth=3)
    assert churn.model.stages[-1].getCacheNodeIds()
    assert churn.confusion().groupBy().sum("customers").first()[0] == 80


def test_sorted_groups_leave_the_session_as_it_was(spark):
    name = "spark.sql.execution.useObjectHashAggregateExec"
    before = spark.conf.get(name)
    with sorted_groups(spark):
        kept = spark.range(9).selectExpr("id % 2 AS k", "id % 3 AS v").groupBy("k").agg({"v": "collect_set"})
        assert "ObjectHashAggregate" not in kept._jdf.queryExecution().executedPlan().toString()
        assert sorted((r[0], sorted(r[1])) for r in kept.collect()) == [(0, [0, 1, 2]), (1, [0, 1, 2])]
    assert spark.conf.get(name) == before


def test_lines_are_summed_before_they_meet_orders(catalog, spark):
    """Repeated orders, shipments and products, and missing keys, give the sums of the item fact."""
    items = spark.createDataFrame(
        [(1, 10, 2, 5.0, 1.0, "P"), (1, 11, 1, 7.0, 0.0, None), (2, 10, 3, 5.0, 0.0, None), (3, 12, 1, 2.0, 0.5, None), (None, 10, 1, 5.0, 0.0, None), (4, None, 1, 1.0, 0.0, None)],
        "order_id long, product_id long, quantity long, unit_price double, discount_amount double, promo_id string",
    ).selectExpr("order_id", "product_id", "quantity", "cast(unit_price AS decimal(12,2)) AS unit_price", "cast(discount_amount AS decimal(18,4)) AS discount_amount", "promo_id", "cast(null AS string) AS promo_id_2")
    day = "date '2020-01-0{}'"
    orders = spark.createDataFrame([(1, 7, 1), (1, 8, 2), (2, 7, 3), (4, None, 4), (None, 9, 5)], "order_id long, customer_id long, d int").selectExpr(
        "order_id", "customer_id", "date_add(date '2020-01-01', d) AS order_date", "'m' AS device_type", "'s' AS order_source", "1L AS zip")
    shipments = spark.createDataFrame([(1, 2), (1, 3), (1, None), (2, 4), (None, 1)], "order_id long, d int").selectExpr(
        "order_id", f"{day.format(1)} AS ship_date", f"date_add({day.format(1)}, d) AS delivery_date", "0 AS shipping_fee")
    products = spark.createDataFrame([(10, "A", 1), (11, "B", 2), (11, "C", 3)], "product_id long, category string, cogs int").selectExpr("*", "'x' AS segment")
    returns = spark.createDataFrame([(1, 10, 1), (1, 10, 1), (2, 99, 5)], "order_id long, product_id long, return_quantity long").selectExpr("*", "cast(2 AS decimal(18,4)) AS refund_amount")
    reviews = spark.createDataFrame([(1, 11, 5), (2, 10, 3), (2, 10, 4)], "order_id long, product_id long, rating int")
    cat = catalog(order_items=items, orders=orders, shipments=shipments, products=products, returns=returns, reviews=reviews)
    found = marts.order_rows(cat)
    lines = marts.item_fact(cat, ("orders", "shipments", "returns", "reviews", "products"))
    sums = ("quantity", "net_value", "profit", "discount_amount", "delivery_days", "rating", "return_qty", "refund_amount")
    plain = lines.groupBy("order_id").agg(
        *[F.min(c).alias(c) for c in ("customer_id", "order_date", "device_type", "order_source")], *[F.sum(c).alias(c) for c in sums],
        F.count("delivery_days").alias("delivery_n"), F.count("rating").alias("rating_n"), F.sum(F.col("used_promo").cast("int")).alias("promo_lines"),
        F.count("product_id").alias("total_lines"), F.collect_set("category").alias("categories"),
    )
    assert [(f.name, f.dataType) for f in found.schema] == [(f.name, f.dataType) for f in plain.schema]

    def rows(df):
        return sorted((tuple(r)[:-1] + (sorted(r.categories),) for r in df.collect()), key=str)

    assert rows(found) == rows(plain) and len(rows(found)) == 5
    joins = [n for n in re.split(r"\n", found._jdf.queryExecution().optimizedPlan().toString()) if "Join" in n or "Aggregate" in n]
    assert "Aggregate" in joins[0] and "Join" in joins[1] and "Join" in joins[2] and "collect_set" in joins[3]
