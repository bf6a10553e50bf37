"""Supply chain: sell-through, stock, order status, cancellations, returns per order, traffic."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyshop.functions.columns import (
    count_if,
    dbl,
    flag,
    mean_exact,
    money,
    month_of,
    r6,
    ratio,
    total_of,
)
from tallyshop.functions.scale import lookup

STATUSES = ("delivered", "returned", "cancelled", "shipped")


def sell_through_by(inventory: DataFrame, *keys: str) -> DataFrame:
    """Mean sell-through rate by snapshot month, year, segment, category or any mix."""
    rows = inventory.withColumn("snapshot_month", month_of("snapshot_date"))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("snapshots"), r6(F.avg("sell_through_rate")).alias("avg_sell_through")
    )


def sell_through_top_categories(inventory: DataFrame, k: int = 5) -> DataFrame:
    """Monthly mean sell-through of the k categories with the highest overall mean."""
    best = sell_through_by(inventory, "category").orderBy(F.desc("avg_sell_through"), "category").limit(k)
    kept = inventory.join(best.select("category"), "category", "left_semi")
    return sell_through_by(kept, "snapshot_month", "category")


def loss_months(sales: DataFrame) -> DataFrame:
    """Months with at least one day on which COGS exceeded revenue."""
    return sales.where("Revenue < COGS").select(month_of("Date").alias("month")).distinct()


def top_profit_months(sales: DataFrame, k: int = 10) -> DataFrame:
    """The k months with the highest gross profit."""
    monthly = sales.groupBy(month_of("Date").alias("month")).agg(F.sum(F.col("Revenue") - F.col("COGS")).alias("p"))
    return monthly.orderBy(F.desc("p"), "month").limit(k).select("month")


def sell_through_in_months(inventory: DataFrame, months: DataFrame) -> DataFrame:
    """Monthly sell-through inside a set of months."""
    rows = inventory.withColumn("month", month_of("snapshot_date")).join(months, "month", "left_semi")
    return rows.groupBy("month").agg(F.avg("sell_through_rate").alias("avg_sell_through"))


def sell_through_in_months_output(inventory: DataFrame, months: DataFrame) -> DataFrame:
    return sell_through_in_months(inventory, months).select(
        F.date_format("month", "yyyy-MM").alias("period"), r6("avg_sell_through").alias("avg_sell_through")
    )


def sell_through_comparison(inventory: DataFrame, sales: DataFrame) -> DataFrame:
    """Overall mean sell-through beside loss months and top-profit months (means of months)."""
    overall = inventory.agg(F.avg("sell_through_rate").alias("v")).select(F.lit("overall").alias("months"), "v")
    parts = [("loss", loss_months(sales)), ("top_profit", top_profit_months(sales))]
    for name, months in parts:
        mean = sell_through_in_months(inventory, months).agg(F.avg("avg_sell_through").alias("v"))
        overall = overall.unionByName(mean.select(F.lit(name).alias("months"), "v"))
    return overall.select("months", r6("v").alias("avg_sell_through"))


def sell_through_revenue_correlation(inventory: DataFrame, sales: DataFrame) -> DataFrame:
    """Pearson correlation of monthly sell-through and monthly revenue."""
    stock = inventory.groupBy(month_of("snapshot_date").alias("month")).agg(F.avg("sell_through_rate").alias("s"))
    money_in = sales.groupBy(month_of("Date").alias("month")).agg(dbl(F.sum("Revenue")).alias("v"))
    return stock.join(money_in, "month").agg(F.count("*").alias("months"), r6(F.corr("s", "v")).alias("pearson_r"))


def latest_stock_by(inventory: DataFrame, dimension: str) -> DataFrame:
    """Stock on hand at each product's last snapshot, summed by an attribute.

    ``max_by`` combines map-side, so no window sorts the history of a product.
    """
    last = inventory.groupBy("product_id").agg(
        F.max_by(F.struct("stock_on_hand", dimension), "snapshot_date").alias("s")
    )
    return last.groupBy(F.col(f"s.{dimension}").alias(dimension)).agg(F.sum("s.stock_on_hand").alias("stock_on_hand"))


def order_status_rates(orders: DataFrame) -> DataFrame:
    """Orders per year and status with delivered, returned and cancelled percentages."""
    counts = orders.groupBy(F.year("order_date").alias("order_year")).agg(
        *[count_if(F.col("order_status") == s).alias(s) for s in STATUSES], F.count("*").alias("total_orders")
    )
    return counts.withColumns(
        {f"{s}_rate": r6(ratio(s, "total_orders") * 100) for s in ("delivered", "returned", "cancelled")}
    )


def _orders_by_place(orders: DataFrame, geography: DataFrame, place: str) -> DataFrame:
    """Orders and cancellations by year and place; counted per zip before the lookup."""
    per_zip = orders.groupBy(F.year("order_date").alias("order_year"), "zip").agg(
        F.count("*").alias("total_orders"), count_if(F.col("order_status") == "cancelled").alias("cancelled_orders")
    )
    placed = lookup(per_zip, geography.select("zip", place), ["zip"])
    return placed.groupBy("order_year", place).agg(
        F.sum("total_orders").alias("total_orders"), F.sum("cancelled_orders").alias("cancelled_orders")
    )


def cancelled_by_city_year(orders: DataFrame, geography: DataFrame, years: tuple[int, int]) -> DataFrame:
    """Cancelled orders by year and city within a range of years."""
    counts = _orders_by_place(orders, geography, "city").where(F.col("order_year").between(*years))
    return counts.where("cancelled_orders > 0").select(
        "order_year", "city", F.col("cancelled_orders").alias("cancelled_count")
    )


def mean_cancelled_per_city(cancelled: DataFrame) -> DataFrame:
    return cancelled.groupBy("order_year").agg(r6(mean_exact("cancelled_count")).alias("avg_cancelled"))


def cancellation_rate_topk(orders: DataFrame, geography: DataFrame, years: tuple[int, int], k: int = 5) -> DataFrame:
    """Per year the k cities with the highest cancellation rate."""
    rates = _orders_by_place(orders, geography, "city").where(F.col("order_year").between(*years))
    rates = rates.withColumn("rate", ratio("cancelled_orders", "total_orders") * 100)
    order = Window.partitionBy("order_year").orderBy(F.desc("rate"), "city")  # one row per city
    return rates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "order_year", "rank", "city", "cancelled_orders", "total_orders", r6("rate").alias("cancellation_rate")
    )


def cancelled_by_region(orders: DataFrame, geography: DataFrame, years: tuple[int, int]) -> DataFrame:
    """Cancelled orders by region: one column per year (0-filled) and the mean of the years present."""
    counts = _orders_by_place(orders, geography, "region").where(
        F.col("order_year").between(*years) & (F.col("cancelled_orders") > 0)
    )
    span = range(years[0], years[1] + 1)
    return counts.groupBy("region").agg(
        r6(mean_exact("cancelled_orders")).alias("avg_cancelled"),
        *[F.sum(F.when(F.col("order_year") == y, F.col("cancelled_orders")).otherwise(0)).alias(f"y{y}") for y in span],
    )


def ordered_and_returned(orders: DataFrame, order_items: DataFrame, returns: DataFrame, period: str) -> DataFrame:
    """Returned (ordered quantity of returned lines) over ordered (distinct products per order).

    The two sides use different units, as published; ``return_by('month')`` is the consistent rate.
    """
    bucket = month_of if period == "month" else F.year
    products = order_items.groupBy("order_id").agg(F.count_distinct("product_id").alias("n"))
    ordered = orders.join(products, "order_id", "left").groupBy(bucket("order_date").alias(period)).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("ordered_products")
    )
    events = returns.join(order_items.select("order_id", "product_id", "quantity"), ["order_id", "product_id"], "left")
    returned = events.groupBy(bucket("return_date").alias(period)).agg(F.sum("quantity").alias("returned_products"))
    both = ordered.join(returned, period, "full").fillna(0, ["ordered_products", "returned_products"])
    return both.withColumn("return_rate_pct", r6(ratio("returned_products", "ordered_products") * 100))


def traffic_by_source(web_traffic: DataFrame) -> DataFrame:
    """Sessions, their share, mean bounce rate and mean session length by source."""
    agg = web_traffic.groupBy("traffic_source").agg(
        F.sum("sessions").alias("total_sessions"), r6(F.avg("bounce_rate")).alias("avg_bounce_rate"),
        r6(F.avg("avg_session_duration_sec")).alias("avg_duration_sec"),
    )
    return agg.withColumn("session_share_pct", r6(ratio("total_sessions", total_of("total_sessions")) * 100))


def reviews_enriched(reviews: DataFrame, orders: DataFrame, geography: DataFrame) -> DataFrame:
    """Reviews with their order and the place it was sent to."""
    kept = orders.select("order_id", "order_date", "zip", "order_status")
    placed = lookup(kept, geography.select("zip", "city", "region"), ["zip"])
    return lookup(reviews, placed, ["order_id"])


def stock_rates(inventory: DataFrame) -> DataFrame:
    """Share of snapshots with a stock-out, an overstock and a reorder flag."""
    flags = ("stockout_flag", "overstock_flag", "reorder_flag")
    return inventory.agg(
        F.count("*").alias("snapshots"),
        *[r6(ratio(F.sum(flag(F.col(c) == 1)), F.count("*")) * 100).alias(f"{c}_pct") for c in flags],
    )


def sales_totals(sales: DataFrame) -> DataFrame:
    """Revenue, COGS and gross profit per year."""
    yearly = sales.groupBy(F.year("Date").alias("year")).agg(F.sum("Revenue").alias("r"), F.sum("COGS").alias("c"))
    return yearly.select(
        "year", money("r").alias("revenue"), money("c").alias("cogs"), money(F.col("r") - F.col("c")).alias("gross_profit")
    )


def sessions_by_weekday(web_traffic: DataFrame) -> DataFrame:
    """Mean daily sessions by weekday, in weekday order."""
    days = web_traffic.groupBy("date").agg(F.sum("sessions").alias("sessions"))
    return (
        days.groupBy(F.weekday("date").alias("weekday"), F.date_format("date", "EEEE").alias("day_name"))
        .agg(r6(mean_exact("sessions")).alias("avg_sessions"))
        .orderBy("weekday")
    )
