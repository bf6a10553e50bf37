"""Customer analyses: RFM, Pareto, cohorts, churn diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyshop.functions.columns import (
    count_if,
    dbl,
    edge_score,
    flag,
    mean_exact,
    money,
    month_number,
    month_of,
    net_value,
    r6,
    ratio,
)
from tallyshop.functions.scale import (
    global_running,
    percentile_edges,
    small_domain_edges,
    with_row_number,
)
from tallyshop.operators.marts import customer_value, item_fact
from tallyshop.session import materialise
from tallyshop.sources.tables import Catalog

QUINTILES = [0.2, 0.4, 0.6, 0.8]


def rfm_scores(value: DataFrame) -> DataFrame:
    """Quintile scores of recency, frequency and monetary value.

    Edges are exact percentiles and bands are closed on the right. Frequency is scored on its
    row rank (ties in customer order), so its edges follow from the number of customers; recency
    has one value per calendar day at most.
    """
    value = materialise(value)  # three orderings read it
    ranked = with_row_number(value, ["F", "customer_id"], "F_rank")
    n = value.agg(F.count("*").alias("n")).scalar()
    rank_edges = F.array(*[F.lit(1) + (n - 1) * F.lit(q) for q in QUINTILES])
    return ranked.select(
        "customer_id", "R", "F", "M",
        edge_score("R", small_domain_edges(value, "R", QUINTILES), [5, 4, 3, 2, 1]).alias("R_score"),
        edge_score("F_rank", rank_edges, [1, 2, 3, 4, 5]).alias("F_score"),
        edge_score("M", percentile_edges(value, "M", QUINTILES), [1, 2, 3, 4, 5]).alias("M_score"),
    )


def segment_of(r: Column, f: Column, m: Column) -> Column:
    """Segment by the first rule that holds."""
    return (
        F.when((r >= 4) & (f >= 4), "VIP")
        .when((r < 4) & (f >= 4), "Loyal")
        .when((r >= 4) & (f < 4) & (m >= 4), "New Potential")
        .when(r <= 2, "Churn Risk")
        .when(m >= 4, "Big Spender")
        .otherwise("Regular")
    )


def rfm_segments(value: DataFrame) -> DataFrame:
    """RFM scores and the segment of every customer."""
    return rfm_scores(value).withColumn(
        "segment", segment_of(F.col("R_score"), F.col("F_score"), F.col("M_score"))
    )


def value_of(base: DataFrame) -> DataFrame:
    """Recency, orders and revenue per customer from the customer base, in place of a second pass over the lines."""
    newest = base.agg(F.max("last_order").alias("d")).scalar()
    return base.select(
        "customer_id", F.datediff(newest, F.col("last_order")).alias("R"), F.col("total_orders").alias("F"), F.col("total_revenue").alias("M")
    )


def segments(cat: Catalog) -> DataFrame:
    return rfm_segments(customer_value(cat))


def segment_summary(rfm: DataFrame, customers: DataFrame) -> DataFrame:
    """Size, value and behaviour of each segment."""
    joined = rfm.join(customers, "customer_id", "left")
    out = joined.groupBy("segment").agg(
        F.count("customer_id").alias("customers"),
        F.sum("total_revenue").alias("revenue"),
        F.sum("total_profit").alias("profit"),
        F.avg(ratio("total_revenue", "total_orders")).alias("avg_AOV"),
        mean_exact("total_orders").alias("avg_orders"),
        F.avg("avg_rating").alias("avg_rating"),
        F.avg(ratio("total_return_qty", "total_items")).alias("return_rate"),
        mean_exact("R").alias("avg_recency"),
        mean_exact("F").alias("avg_frequency"),
        mean_exact("M").alias("avg_monetary"),
    )
    whole = Window.partitionBy()  # six segments
    return out.select(
        "segment", "customers", money("revenue").alias("revenue"), money("profit").alias("profit"),
        *[r6(c).alias(c) for c in ("avg_AOV", "avg_orders", "avg_rating", "return_rate",
                                   "avg_recency", "avg_frequency", "avg_monetary")],
        r6(ratio("revenue", F.sum("revenue").over(whole)) * 100).alias("revenue_pct"),
        r6(ratio("customers", F.sum("customers").over(whole)) * 100).alias("customer_pct"),
    )


def pareto(df: DataFrame, key: str, value: str) -> DataFrame:
    """Cumulative share of a value over keys from the largest down (ties in key order)."""
    running = global_running(
        df, [(value, "desc"), key], {"position": F.lit(1).cast("long"), "cumulative": value}
    )
    last = running.agg(F.max(F.struct("position", "cumulative")).alias("s")).scalar()
    return running.withColumns(
        {
            "cum_pct": ratio("cumulative", last["cumulative"]),
            "position_pct": ratio("position", last["position"]),
        }
    )


def pareto_customers(rfm: DataFrame) -> DataFrame:
    """Pareto curve of customers with their segment and the running sum inside the segment.

    The segment sums run in the same global order: one conditional total per segment, so the
    largest segment is no single-task window.
    """
    names = ["VIP", "Loyal", "New Potential", "Churn Risk", "Big Spender", "Regular"]
    sums = {f"_s{i}": F.when(F.col("segment") == n, F.col("M")).otherwise(0) for i, n in enumerate(names)}
    running = global_running(
        rfm.select("customer_id", "segment", "M"),
        [("M", "desc"), "customer_id"],
        {"position": F.lit(1).cast("long"), "cum_revenue": "M", **sums},
    )
    last = running.agg(F.max(F.struct("position", "cum_revenue")).alias("s")).scalar()
    inside = F.coalesce(*[F.when(F.col("segment") == n, F.col(f"_s{i}")) for i, n in enumerate(names)])
    return running.select(
        "customer_id", "segment", "position",
        money("M").alias("revenue"),
        money("cum_revenue").alias("cum_revenue"),
        r6(ratio("cum_revenue", last["cum_revenue"])).alias("cum_pct"),
        r6(ratio("position", last["position"])).alias("customer_pct"),
        flag(F.col("segment") == "VIP").alias("is_vip"),
        money(inside).alias("segment_cum_revenue"),
    )


def rfm_heatmap(rfm: DataFrame) -> DataFrame:
    """Mean monetary value by recency score (rows) and frequency score (columns)."""
    wide = rfm.groupBy("R_score").pivot("F_score", [1, 2, 3, 4, 5]).agg(mean_exact("M"))
    return wide.select("R_score", *[r6(str(i)).alias(f"F{i}") for i in range(1, 6)])


# --- cohorts ---------------------------------------------------------------------------------


def cohort_months(orders: DataFrame) -> DataFrame:
    """Cohort month and month distance for each active month of a customer.

    The first month joins back at (customer, month) grain, after days were collapsed.
    """
    months = orders.groupBy("customer_id", month_of("order_date").alias("month")).agg(
        F.count("*").alias("orders")
    )
    first = orders.groupBy("customer_id").agg(month_of(F.min("order_date")).alias("cohort_month"))
    return months.join(first, "customer_id").withColumn(
        "cohort_index", month_number("month") - month_number("cohort_month")
    )


def orders_with_lines(cat: Catalog) -> DataFrame:
    """Orders that have lines, with their net revenue."""
    per_order = cat.order_items.groupBy("order_id").agg(F.sum(net_value()).alias("revenue"))
    return cat.orders.select("order_id", "customer_id", "order_date", "order_status").join(per_order, "order_id")


def cohort_retention(orders: DataFrame) -> DataFrame:
    """Customers by cohort and month index, and their share of the cohort's first month."""
    active = cohort_months(orders).groupBy("cohort_month", "cohort_index").agg(
        F.count("*").alias("customers")
    )
    first = F.first("customers").over(Window.partitionBy("cohort_month").orderBy("cohort_index"))
    return active.withColumn("retention", r6(ratio("customers", first)))


def cohort_retention_wide(orders: DataFrame, months: int) -> DataFrame:
    """Retention matrix: one row per cohort, one column per month index of a calendar of ``months`` months."""
    wide = cohort_retention(orders).groupBy("cohort_month").pivot("cohort_index", list(range(months))).agg(
        F.max("retention")
    )
    return wide.select("cohort_month", *[F.col(str(i)).alias(f"m{i}") for i in range(months)])


def cohort_clv(orders: DataFrame) -> DataFrame:
    """Revenue per cohort customer by month index, cumulative value and revenue retention."""
    monthly = orders.groupBy("customer_id", month_of("order_date").alias("month")).agg(
        F.sum("revenue").alias("revenue")
    )
    first = orders.groupBy("customer_id").agg(month_of(F.min("order_date")).alias("cohort_month"))
    sizes = first.groupBy("cohort_month").agg(F.count("*").alias("cohort_size"))
    cells = (
        monthly.join(first, "customer_id")
        .withColumn("cohort_index", month_number("month") - month_number("cohort_month"))
        .groupBy("cohort_month", "cohort_index")
        .agg(F.sum("revenue").alias("revenue"))
        .join(sizes, "cohort_month")
    )
    by_index = Window.partitionBy("cohort_month").orderBy("cohort_index")  # months, not customers
    so_far = F.sum("revenue").over(by_index.rowsBetween(Window.unboundedPreceding, 0))
    return cells.select(
        "cohort_month", "cohort_index", "cohort_size",
        money("revenue").alias("revenue"),
        r6(ratio("revenue", "cohort_size")).alias("clv"),
        r6(ratio(so_far, "cohort_size")).alias("clv_cumulative"),
        r6(ratio("revenue", F.first("revenue").over(by_index))).alias("revenue_retention"),
    )


# --- churn diagnostics -------------------------------------------------------------------------


def _segment_lines(cat: Catalog, rfm: DataFrame, segment: str, parts: tuple[str, ...]) -> DataFrame:
    chosen = rfm.where(F.col("segment") == segment).select("customer_id")
    return item_fact(cat, parts).join(chosen, "customer_id", "left_semi")


def churn_by_category(cat: Catalog, rfm: DataFrame, segment: str = "Churn Risk") -> DataFrame:
    """Returned over sold quantity by category for one segment."""
    lines = _segment_lines(cat, rfm, segment, ("orders", "products", "returns"))
    return lines.groupBy("category").agg(
        F.sum("quantity").alias("total_items"), F.sum("return_qty").alias("returned_items")
    ).withColumn("return_rate", r6(ratio("returned_items", "total_items")))


def churn_by_region(cat: Catalog, rfm: DataFrame, segment: str = "Churn Risk") -> DataFrame:
    """Returned lines over orders by region for one segment."""
    lines = _segment_lines(cat, rfm, segment, ("orders", "geography", "returns"))
    return lines.groupBy("region").agg(
        F.count_distinct("order_id").alias("total_orders"), F.sum("is_returned").alias("returned_orders")
    ).withColumn("order_return_rate", r6(ratio("returned_orders", "total_orders")))


def churn_reasons(cat: Catalog, rfm: DataFrame, segment: str = "Churn Risk") -> DataFrame:
    """Return reasons of one segment's orders with their shares."""
    orders = _segment_lines(cat, rfm, segment, ("orders",)).select("order_id")
    counts = cat.returns.join(orders, "order_id", "left_semi").groupBy("return_reason").agg(
        F.count("*").alias("events")
    )
    whole = F.sum("events").over(Window.partitionBy())  # one row per reason
    return counts.withColumn("pct", r6(ratio("events", whole) * 100))


def last_order_delivery(cat: Catalog) -> DataFrame:
    """Delivery days of each customer's newest order with lines (highest order_id on ties)."""
    lines = cat.order_items.select("order_id").distinct()
    newest = (
        cat.orders.join(lines, "order_id", "left_semi")
        .groupBy("customer_id")
        .agg(F.max_by("order_id", F.struct("order_date", "order_id")).alias("order_id"))
    )
    days = cat.shipments.select("order_id", F.datediff("delivery_date", "ship_date").alias("delivery_days"))
    return newest.join(days, "order_id", "left").select("customer_id", "delivery_days")


def delivery_churn(cat: Catalog, rfm: DataFrame, min_lines: int = 100) -> DataFrame:
    """Rating by delivery days, and churn share of customers by their last delivery."""
    lines = item_fact(cat, ("shipments", "reviews"))
    stats = lines.where("delivery_days IS NOT NULL").groupBy("delivery_days").agg(
        r6(F.avg("rating")).alias("avg_rating"), F.count("order_id").alias("total_lines")
    )
    last = last_order_delivery(cat).where("delivery_days IS NOT NULL")
    churn = last.join(rfm.select("customer_id", "segment"), "customer_id", "left").groupBy("delivery_days").agg(
        r6(ratio(count_if(F.col("segment") == "Churn Risk"), F.count("*"))).alias("churn_rate"),
        F.count("customer_id").alias("customer_count"),
    )
    return stats.join(churn, "delivery_days").where(F.col("total_lines") > min_lines)


SEGMENT_COLUMNS = {
    "VIP": "vip", "Loyal": "loyal", "New Potential": "new_potential", "Churn Risk": "churn_risk",
    "Big Spender": "big_spender", "Regular": "regular",
}


def delivery_segment_mix(cat: Catalog, rfm: DataFrame) -> DataFrame:
    """Customers by last delivery days and segment: counts, row percentages and totals."""
    last = last_order_delivery(cat).where("delivery_days IS NOT NULL")
    joined = last.join(rfm.select("customer_id", "segment"), "customer_id", "left")
    counts = joined.groupBy("delivery_days").agg(
        *[count_if(F.col("segment") == s).alias(f"{c}_count") for s, c in SEGMENT_COLUMNS.items()],
        F.count("*").alias("total_customers"),
    )
    return counts.withColumns(
        {f"{c}_pct": r6(ratio(f"{c}_count", "total_customers") * 100) for c in SEGMENT_COLUMNS.values()}
    )


def promo_usage_compare(rfm: DataFrame, customers: DataFrame, names: tuple[str, ...] = ("New Potential", "VIP")) -> DataFrame:
    """Mean promotion usage of some segments."""
    joined = customers.join(rfm.where(F.col("segment").isin(*names)).select("customer_id", "segment"), "customer_id")
    return joined.groupBy("segment").agg(
        F.count("*").alias("customers"), r6(F.avg(ratio("promo_lines", "total_lines"))).alias("avg_promo_usage")
    )


def promo_value_correlation(customers: DataFrame) -> DataFrame:
    """Pearson correlation of revenue and promotion usage over customers, with its t statistic."""
    out = customers.agg(
        F.count("*").alias("n"), F.corr(dbl("total_revenue"), ratio("promo_lines", "total_lines")).alias("r")
    )
    t = F.col("r") * F.sqrt(ratio(F.col("n") - 2, 1 - F.col("r") * F.col("r")))
    return out.select("n", r6("r").alias("pearson_r"), r6(t).alias("t_statistic"))


def customer_chart_sample(customers: DataFrame, share: float = 0.2) -> DataFrame:
    """A scatter-plot sample: the ``share`` of the customers whose multiplied id is smallest modulo a prime."""
    spread = F.pmod(F.col("customer_id") * F.lit(48271), F.lit(65521))
    return customers.where(spread < F.lit(int(share * 65521)))
