"""Item fact, order mart, customer mart and their KPIs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyshop.functions.columns import (
    count_if,
    dbl,
    flag,
    gross_value,
    margin,
    mean_exact,
    money,
    r6,
    ratio,
)
from tallyshop.functions.scale import lookup, percentile_scalar, salted_lookup
from tallyshop.operators.quality import histograms
from tallyshop.session import materialise, sorted_groups
from tallyshop.sources.tables import Catalog

PROMO_FIELDS = (
    "promo_name", "promo_type", "discount_value", "start_date", "end_date",
    "applicable_category", "promo_channel", "stackable_flag", "min_order_value",
)
LOOKUPS = (
    "orders", "customers", "geography", "products", "returns", "reviews", "shipments",
    "payments", "promotions",
)


def returns_per_line(returns: DataFrame) -> DataFrame:
    """Returns collapsed to one row per (order, product)."""
    return returns.groupBy("order_id", "product_id").agg(
        F.sum("return_quantity").alias("return_qty"), F.sum("refund_amount").alias("refund_amount")
    )


def reviews_per_line(reviews: DataFrame) -> DataFrame:
    """Reviews collapsed to one row per (order, product)."""
    return reviews.groupBy("order_id", "product_id").agg(
        mean_exact("rating").alias("rating"), F.count("rating").alias("review_count")
    )


def raw_returned_lines(order_items: DataFrame, returns: DataFrame) -> DataFrame:
    """Order lines joined to return events one by one: a line repeats per event."""
    events = returns.select("order_id", "product_id", "return_quantity", "refund_amount")
    return order_items.join(events, ["order_id", "product_id"], "left")


def item_fact(cat: Catalog, parts: Iterable[str] = LOOKUPS, salted: bool = False) -> DataFrame:
    """One row per order line with the attributes and measures of the chosen lookups.

    Every lookup has one row per key, so the number of lines never changes; naming fewer
    ``parts`` drops whole joins (and their shuffles) without changing the other columns.
    The order_id joins share one shuffle of the lines; customers meet the orders, not the lines. ``salted`` spreads hot
    customers and products over many tasks where those dimensions are too large to broadcast
    and AQE's split of skewed partitions is off or too coarse; products then meet the lines first, while these are
    narrow, since finding the hot keys reads them once more and each salted join moves them.
    """
    parts = set(parts)

    def by_entity(fact: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
        return salted_lookup(fact, dimension, key) if salted else lookup(fact, dimension, [key])

    def with_products(fact: DataFrame) -> DataFrame:
        products = cat.products.select("product_id", "category", "segment", "cogs")
        return by_entity(fact, products, "product_id")

    out = with_products(cat.order_items) if salted and "products" in parts else cat.order_items
    if parts & {"orders", "customers", "geography"}:
        orders = cat.orders.select(
            "order_id", "customer_id", "order_date", "device_type", "order_source", "zip"
        )
        if "customers" in parts:
            customers = cat.customers.select("customer_id", "gender", "age_group", "acquisition_channel")
            orders = by_entity(orders, customers, "customer_id")
        out = lookup(out, orders, ["order_id"]).withColumns(
            {
                "order_year": F.year("order_date"),
                "order_month": F.month("order_date"),
                "order_weekday": F.weekday("order_date"),
            }
        )
    out = out.withColumns(  # after the joins that may move the lines
        {
            "gross_value": gross_value(),
            "net_value": gross_value() - F.col("discount_amount"),
            "used_promo": F.col("promo_id").isNotNull() | F.col("promo_id_2").isNotNull(),
        }
    )
    if "shipments" in parts:
        shipments = cat.shipments.select("order_id", "ship_date", "delivery_date", "shipping_fee")
        out = lookup(out, shipments, ["order_id"]).withColumn(
            "delivery_days", F.datediff("delivery_date", "ship_date")
        )
    if "payments" in parts:
        out = lookup(out, cat.payments.select("order_id", "payment_value"), ["order_id"])
        out = out.withColumn("payment_value_filled", F.coalesce("payment_value", F.lit(0)))
    if "returns" in parts:
        out = lookup(out, returns_per_line(cat.returns), ["order_id", "product_id"]).withColumns(
            {
                "return_qty": F.coalesce("return_qty", F.lit(0)),
                "refund_amount": F.coalesce("refund_amount", F.lit(0)),
            }
        )
        out = out.withColumns(
            {
                "is_returned": flag(F.col("return_qty") > 0),
                "realized_revenue": F.col("net_value") - F.col("refund_amount"),
            }
        )
    if "reviews" in parts:
        out = lookup(out, reviews_per_line(cat.reviews), ["order_id", "product_id"])
    if "geography" in parts:
        out = lookup(out, cat.geography.select("zip", "region"), ["zip"])
    if "products" in parts:
        out = out if salted else with_products(out)
        out = out.withColumn("cogs_total", F.col("quantity") * F.col("cogs"))
        out = out.withColumn("profit", F.col("net_value") - F.col("cogs_total"))
        if "returns" in parts:
            out = out.withColumn("realized_profit", F.col("profit") - F.col("refund_amount"))
    if "promotions" in parts:
        for prefix, key in (("p1_", "promo_id"), ("p2_", "promo_id_2")):
            role = cat.promotions.select(
                F.col("promo_id").alias(key), *[F.col(c).alias(prefix + c) for c in PROMO_FIELDS]
            )
            out = lookup(out, role, [key])
        stackable = (F.col("p1_stackable_flag") == 1) | (F.col("p2_stackable_flag") == 1)
        out = out.withColumn("is_stackable", F.coalesce(stackable, F.lit(False)))
    return out


def order_mart(cat: Catalog) -> DataFrame:
    """One row per order.

    Order attributes are the same on all lines of an order, so any value (here the smallest)
    is both the first and the modal one.
    """
    lines = item_fact(cat, ("orders", "shipments", "payments", "returns", "reviews", "products"))
    return lines.groupBy("order_id").agg(
        F.min("customer_id").alias("customer_id"),
        F.min("order_date").alias("order_date"),
        F.sum("quantity").alias("total_items"),
        F.sum("net_value").alias("total_revenue"),
        F.sum("profit").alias("total_profit"),
        F.max("is_returned").alias("return_flag"),
        F.avg("rating").alias("avg_rating"),
        F.min("payment_value").alias("payment_value"),
        mean_exact("delivery_days").alias("delivery_days"),
        F.min("device_type").alias("device_type"),
        F.min("order_source").alias("order_source"),
    )


def modal_value(df: DataFrame, key: str, column: str, name: str) -> DataFrame:
    """Most frequent value per key, the smallest on ties.

    Counting (key, value) first spreads a hot key over its values and combines map-side.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(key, column).agg(F.count("*").alias("_n"))
    best = F.min_by(column, F.struct((-F.col("_n")).alias("n"), F.col(column).alias("v")))
    return counts.groupBy(key).agg(best.alias(name))


def order_rows(cat: Catalog) -> DataFrame:
    """Sums and counts of the item fact per order, and the categories of the order.

    Lines are summed per order before they meet orders and shipments, which say the same of all lines of an order, and once more after,
    since an order or shipment listed twice repeats the lines. All of it is partitioned by order_id, so this needs no shuffle of its own.
    """
    lines = item_fact(cat, ("returns", "reviews", "products"))
    sums = ("quantity", "net_value", "profit", "discount_amount", "rating", "return_qty", "refund_amount")
    counts = ("rating_n", "promo_lines", "total_lines")
    attributes = ("customer_id", "order_date", "device_type", "order_source")
    per_order = lines.groupBy("order_id").agg(
        *[F.sum(c).alias(c) for c in sums], F.count("rating").alias("rating_n"), count_if(F.col("used_promo")).alias("promo_lines"),
        F.count("product_id").alias("total_lines"), F.collect_set("category").alias("categories"), F.count("*").alias("_lines"),
    )
    shipments = cat.shipments.select("order_id", F.datediff("delivery_date", "ship_date").alias("_days"))
    joined = lookup(lookup(per_order, cat.orders.select("order_id", *attributes), ["order_id"]), shipments, ["order_id"])
    total = {c: F.sum(c).cast(per_order.schema[c].dataType).alias(c) for c in (*sums, *counts)}
    total["delivery_days"] = F.sum(F.col("_days") * F.col("_lines")).alias("delivery_days")
    return joined.groupBy("order_id").agg(
        *[F.min(c).alias(c) for c in attributes],
        *[total[c] for c in ("quantity", "net_value", "profit", "discount_amount", "delivery_days", "rating", "return_qty", "refund_amount")],
        F.sum(F.when(F.col("_days").isNotNull(), F.col("_lines")).otherwise(0)).alias("delivery_n"),
        *[total[c] for c in counts], F.any_value("categories").alias("categories"),
    )


def kept_order_rows(cat: Catalog) -> DataFrame:
    """The order rows, written once; the joins have sorted the lines by order, so each order is summed as it comes."""
    with sorted_groups(cat.spark):
        return materialise(order_rows(cat))


def customer_base(cat: Catalog, orders: DataFrame | None = None) -> DataFrame:
    """Aggregates per customer from order rows, combined map-side before they travel.

    The order rows are written once: sums read them, and so does the count of categories, which
    goes over distinct (customer, category) pairs.
    """
    orders = kept_order_rows(cat) if orders is None else orders
    customers = orders.groupBy("customer_id").agg(
        F.count("*").alias("total_orders"),
        F.sum("quantity").alias("total_items"),
        F.sum("net_value").alias("total_revenue"),
        F.sum("profit").alias("total_profit"),
        F.sum("discount_amount").alias("total_discount"),
        ratio(F.sum("delivery_days"), F.sum("delivery_n")).alias("avg_delivery_days"),
        ratio(F.sum("rating"), F.sum("rating_n")).alias("avg_rating"),
        F.sum("return_qty").alias("total_return_qty"),
        F.sum("refund_amount").alias("total_refund"),
        F.sum("promo_lines").alias("promo_lines"),
        F.sum("total_lines").alias("total_lines"),
        F.min("order_date").alias("first_order"),
        F.max("order_date").alias("last_order"),
    )
    pairs = orders.select("customer_id", F.explode("categories").alias("category")).distinct()
    diversity = pairs.groupBy("customer_id").agg(F.count("*").alias("category_diversity"))
    return customers.join(diversity, "customer_id", "left").fillna(0, ["category_diversity"])


def customer_value(cat: Catalog) -> DataFrame:
    """Recency, orders and revenue per customer: the columns RFM needs, and nothing else."""
    per_order = cat.order_items.groupBy("order_id").agg(
        F.sum(gross_value() - F.col("discount_amount")).alias("revenue")
    )
    joined = cat.orders.select("order_id", "customer_id", "order_date").join(per_order, "order_id")
    base = joined.groupBy("customer_id").agg(
        F.count("*").alias("F"), F.sum("revenue").alias("M"), F.max("order_date").alias("last_order")
    )
    newest = base.agg(F.max("last_order").alias("d")).scalar()
    return base.select(
        "customer_id", F.datediff(newest, F.col("last_order")).alias("R"), "F", "M"
    )


def customer_360(cat: Catalog, churn_days: int = 90, top_share: float = 0.2, bargain: float = 0.3) -> DataFrame:
    """Customer mart: behaviour, value, experience, returns, promotions, time and channels."""
    orders = kept_order_rows(cat)
    base = materialise(customer_base(cat, orders))
    threshold = percentile_scalar(base, "total_profit", 1 - top_share)
    newest = base.agg(F.max("last_order").alias("d")).scalar()
    spend = F.col("total_revenue") + F.col("total_discount")
    months = F.greatest(F.col("tenure"), F.lit(1)) / 30
    out = base.withColumns(
        {
            "recency": F.datediff(newest, F.col("last_order")),
            "tenure": F.datediff("last_order", "first_order"),
            "AOV": ratio("total_revenue", "total_orders"),
            "return_rate": ratio("total_return_qty", "total_items"),
            "discount_rate": ratio("total_discount", F.when(spend == 0, 1).otherwise(spend)),
            "promo_usage_rate": ratio("promo_lines", "total_lines"),
            "CLV": F.col("total_profit"),
        }
    )
    out = out.withColumns(
        {
            "freq_per_month": F.col("total_orders") / months,
            "repeat_flag": flag(F.col("total_orders") > 1),
            "is_churn_risk": flag(F.col("recency") > churn_days),
            "is_high_value": flag(dbl("CLV") >= threshold),
            "is_bargain": flag(F.col("discount_rate") > bargain),
        }
    )
    channels = lookup(out, cat.customers.select("customer_id", "acquisition_channel"), ["customer_id"])
    for column, name in (("device_type", "dominant_device"), ("order_source", "dominant_source")):
        counts = orders.groupBy("customer_id", column).agg(F.sum("total_lines").alias("_n"))
        best = F.min_by(column, F.struct((-F.col("_n")).alias("n"), F.col(column).alias("v")))
        channels = channels.join(counts.groupBy("customer_id").agg(best.alias(name)), "customer_id", "left")
    return channels


def customer_kpis(cat: Catalog) -> DataFrame:
    """Customers, mean CLV, mean orders and repeat rate in one row."""
    lines = item_fact(cat, ("orders", "products"))
    base = lines.groupBy("customer_id").agg(
        F.count_distinct("order_id").alias("orders"), F.sum("profit").alias("clv")
    )
    return base.agg(
        F.count("*").alias("total_customers"),
        r6(mean_exact("clv")).alias("avg_clv"),
        r6(mean_exact("orders")).alias("avg_orders"),
        r6(ratio(count_if(F.col("orders") > 1), F.count("*")) * 100).alias("repeat_rate_pct"),
    )


def fanout_check(before: DataFrame, after: DataFrame) -> DataFrame:
    """Row counts before and after a chain of joins."""
    n = F.count("*")
    return before.agg(n.alias("rows_before")).select(
        "rows_before", after.agg(n.alias("n")).scalar().alias("rows_after")
    ).withColumn("fanout", F.col("rows_after") - F.col("rows_before"))


def assert_customer_rules(customers: DataFrame) -> DataFrame:
    """The mart itself, failing at run time where a row has no orders or a negative recency."""
    ok = (F.col("total_orders") >= 1) & (F.col("recency") >= 0)
    broken = F.raise_error(F.lit("customer mart: total_orders < 1 or recency < 0")).cast("int")
    return customers.withColumn("rules_hold", F.when(ok, 1).otherwise(broken))


def long_counts(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Frequencies of several columns in one pass over the table (long layout)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.inline(pairs)).groupBy("dimension", "value").agg(F.count("*").alias("n"))


def customer_distributions(customers: DataFrame, geography: DataFrame) -> DataFrame:
    """Customers by region, channel, gender, age band and sign-up year."""
    enriched = lookup(customers, geography.select("zip", "region"), ["zip"])
    enriched = enriched.withColumn("signup_year", F.year("signup_date"))
    return long_counts(enriched, ["region", "acquisition_channel", "gender", "age_group", "signup_year"])


BEHAVIOUR_BINS = {"total_orders": 30, "AOV": 30, "freq_per_month": 30, "category_diversity": 20, "promo_usage_rate": 20}


def customer_behaviour(customers: DataFrame, bins: dict[str, int] | None = None) -> DataFrame:
    """How customers buy: histograms of orders, order value, frequency, categories and promotion use, and repeat against one-time buyers."""
    shapes = histograms(customers, bins or BEHAVIOUR_BINS)
    repeat = customers.groupBy(F.col("repeat_flag").cast("long").alias("bin")).agg(F.count("*").alias("n"))
    return shapes.unionByName(repeat.select(F.lit("repeat_flag").alias("measure"), "bin", dbl("bin").alias("low"), "n"))


def geography_distributions(geography: DataFrame) -> DataFrame:
    return long_counts(geography, ["region", "city", "district"])


def product_distributions(products: DataFrame) -> DataFrame:
    return long_counts(products, ["category", "segment", "size", "color"])


def promotion_distributions(promotions: DataFrame) -> DataFrame:
    """Promotions and mean discount by start year, channel, type and targeting."""
    targeting = F.when(F.col("applicable_category").isNull(), "All Category").otherwise("Targeted")
    pairs = F.array(
        F.struct(F.lit("year").alias("dimension"), F.year("start_date").cast("string").alias("value")),
        F.struct(F.lit("channel").alias("dimension"), F.col("promo_channel").alias("value")),
        F.struct(F.lit("type").alias("dimension"), F.col("promo_type").alias("value")),
        F.struct(F.lit("targeting").alias("dimension"), targeting.alias("value")),
    )
    return (
        promotions.select("discount_value", F.inline(pairs))
        .groupBy("dimension", "value")
        .agg(F.count("*").alias("promotions"), r6(mean_exact("discount_value")).alias("avg_discount"))
    )


def product_margin_distribution(products: DataFrame) -> DataFrame:
    """Mean price, cost and margin by category and segment."""
    return products.groupBy("category", "segment").agg(
        F.count("*").alias("products"),
        r6(mean_exact("price")).alias("avg_price"),
        r6(mean_exact("cogs")).alias("avg_cogs"),
        r6(F.avg(margin("price", "cogs"))).alias("avg_margin"),
    )


def item_fact_output(fact: DataFrame) -> DataFrame:
    """The item fact with money shown as doubles, in a stable column order."""
    amounts = (
        "gross_value", "net_value", "cogs_total", "profit", "refund_amount", "realized_revenue",
        "realized_profit", "payment_value_filled", "discount_amount", "shipping_fee",
    )
    plain = (
        "order_id", "product_id", "quantity", "customer_id", "order_date", "device_type",
        "order_source", "gender", "age_group", "acquisition_channel", "region", "category", "segment",
        "return_qty", "is_returned", "review_count", "ship_date", "delivery_date", "delivery_days",
        "p1_promo_name", "p2_promo_name", "order_year", "order_month", "order_weekday",
    )
    return fact.select(
        *plain,
        *[money(a).alias(a) for a in amounts],
        r6("rating").alias("rating"),
        flag(F.col("used_promo")).alias("used_promo"),
        flag(F.col("is_stackable")).alias("is_stackable"),
    )
