"""Ten short questions about the raw tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyshop.functions.columns import (
    flag,
    margin,
    mean_exact,
    money,
    net_value,
    r6,
    ratio,
)


def order_gaps(orders: DataFrame) -> DataFrame:
    """How often each gap in days between consecutive orders of a customer occurs.

    Orders are collapsed to (customer, day) before the window, so a customer with a third of
    all orders still has at most one row per calendar day; further orders of a day are gaps of 0.
    """
    days = orders.groupBy("customer_id", "order_date").agg(F.count("*").alias("n"))
    previous = F.lag("order_date").over(Window.partitionBy("customer_id").orderBy("order_date"))
    gaps = days.select(F.datediff("order_date", previous).alias("gap"), (F.col("n") - 1).alias("same_day"))
    parts = F.array(
        F.struct(F.col("gap").alias("gap"), F.lit(1).cast("long").alias("n")),
        F.struct(F.lit(0).alias("gap"), F.col("same_day").alias("n")),
    )
    return (
        gaps.select(F.inline(parts))
        .where("gap IS NOT NULL AND n > 0")
        .groupBy("gap")
        .agg(F.sum("n").alias("n"))
    )


def median_order_gap(orders: DataFrame) -> DataFrame:
    """Median days between consecutive orders; the gap domain is bounded by the calendar."""
    return order_gaps(orders).agg(F.percentile("gap", F.lit(0.5), F.col("n")).alias("median_gap_days"))


def segment_margin(products: DataFrame) -> DataFrame:
    """Mean product margin by segment, highest first."""
    return (
        products.groupBy("segment")
        .agg(r6(F.avg(margin("price", "cogs"))).alias("avg_margin"))
        .orderBy(F.desc("avg_margin"), "segment")
    )


def return_reasons_of(returns: DataFrame, products: DataFrame, category: str) -> DataFrame:
    """Return reasons of one category, most frequent first."""
    kept = products.where(F.col("category") == category).select("product_id")
    return (
        returns.select("product_id", "return_reason")
        .join(kept, "product_id")
        .groupBy("return_reason")
        .agg(F.count("*").alias("events"))
        .orderBy(F.desc("events"), "return_reason")
    )


def bounce_by_source(web_traffic: DataFrame) -> DataFrame:
    """Mean bounce rate by traffic source, lowest first."""
    return (
        web_traffic.groupBy("traffic_source")
        .agg(r6(F.avg("bounce_rate")).alias("avg_bounce_rate"))
        .orderBy("avg_bounce_rate", "traffic_source")
    )


def promo_line_share(order_items: DataFrame) -> DataFrame:
    """Percentage of order lines that carry a promotion."""
    used = F.sum(flag(F.col("promo_id").isNotNull()))
    return order_items.agg(r6(ratio(used, F.count("*")) * 100).alias("promo_line_pct"))


def orders_per_customer_by_age(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Mean orders per customer by age group, customers without an age group left out.

    Orders are counted per customer before the join.
    """
    counts = orders.groupBy("customer_id").agg(F.count("*").alias("orders"))
    known = customers.where("age_group IS NOT NULL").select("customer_id", "age_group")
    return (
        counts.join(known, "customer_id")
        .groupBy("age_group")
        .agg(r6(mean_exact("orders")).alias("avg_orders"))
        .orderBy(F.desc("avg_orders"), "age_group")
    )


def revenue_by_region(orders: DataFrame, order_items: DataFrame, geography: DataFrame) -> DataFrame:
    """Net revenue by region, highest first.

    Lines are summed per order and per zip before the join to geography.
    """
    per_order = order_items.groupBy("order_id").agg(F.sum(net_value()).alias("revenue"))
    per_zip = (
        orders.select("order_id", "zip").join(per_order, "order_id", "left")
        .groupBy("zip").agg(F.sum("revenue").alias("revenue"))
    )
    return (
        per_zip.join(geography.select("zip", "region"), "zip", "left")
        .where("region IS NOT NULL")
        .groupBy("region")
        .agg(money(F.sum("revenue")).alias("revenue"))
        .orderBy(F.desc("revenue"), "region")
    )


def cancelled_payment_methods(orders: DataFrame, payments: DataFrame) -> DataFrame:
    """Payment methods (of the payment) of cancelled orders, most frequent first."""
    cancelled = orders.where(F.col("order_status") == "cancelled").select("order_id")
    return (
        cancelled.join(payments.select("order_id", "payment_method"), "order_id", "left")
        .where("payment_method IS NOT NULL")
        .groupBy("payment_method")
        .agg(F.count("*").alias("orders"))
        .orderBy(F.desc("orders"), "payment_method")
    )


def return_rate_by_size(returns: DataFrame, order_items: DataFrame, products: DataFrame) -> DataFrame:
    """Return events over order lines by size, the two counts aligned on size."""
    sizes = products.select("product_id", "size")

    def by_size(lines: DataFrame, name: str) -> DataFrame:
        per_product = lines.groupBy("product_id").agg(F.count("*").alias("n"))
        sized = per_product.join(sizes, "product_id", "left").where("size IS NOT NULL")
        return sized.groupBy("size").agg(F.sum("n").alias(name))

    return (
        by_size(returns, "returned")
        .join(by_size(order_items, "sold"), "size", "full")
        .select("size", "returned", "sold", r6(ratio("returned", "sold")).alias("return_rate"))
        .orderBy(F.desc_nulls_last("return_rate"), "size")
    )


def payment_by_installments(payments: DataFrame) -> DataFrame:
    """Mean payment value by number of installments, highest first."""
    return (
        payments.groupBy("installments")
        .agg(r6(mean_exact("payment_value")).alias("avg_payment"))
        .orderBy(F.desc("avg_payment"), "installments")
    )


def best_of(df: DataFrame, label: str, value: str, lowest: bool = False) -> DataFrame:
    """The group with the highest (or lowest) value: the answer to a question above."""
    order = F.col(value).asc_nulls_last() if lowest else F.col(value).desc_nulls_last()
    return df.orderBy(order, label).limit(1)
