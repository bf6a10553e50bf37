"""The daily feature table: one row per calendar day, one summary per source."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyshop.functions.columns import (
    col,
    flag,
    mean_exact,
    one_hot_counts,
    slug,
)
from tallyshop.functions.spine import as_of_daily, date_spine, explode_interval
from tallyshop.sources.tables import Catalog


@dataclass(frozen=True)
class DailySpec:
    """Calendar and category values of a daily table (fixed lists keep its schema stable)."""

    start: str
    end: str
    order_status: list[str] = field(default_factory=list)
    payment_method: list[str] = field(default_factory=list)
    device_type: list[str] = field(default_factory=list)
    order_source: list[str] = field(default_factory=list)
    review_title: list[str] = field(default_factory=list)
    gender: list[str] = field(default_factory=list)
    age_group: list[str] = field(default_factory=list)
    acquisition_channel: list[str] = field(default_factory=list)
    promo_type: list[str] = field(default_factory=list)
    category: list[str] = field(default_factory=list)
    segment: list[str] = field(default_factory=list)
    traffic_source: list[str] = field(default_factory=list)


def domain_values(df: DataFrame, column: str) -> list[str]:
    """Sorted distinct values of a category column; each becomes a column of the daily table."""
    rows = df.select(column).where(F.col(column).isNotNull()).distinct().collect()
    return sorted(row[0] for row in rows)


def daily_spec(cat: Catalog, start: str, end: str) -> DailySpec:
    """Spec with the values found in the tables (lists of category names only)."""
    places = {
        "order_status": "orders", "payment_method": "orders", "device_type": "orders", "order_source": "orders",
        "review_title": "reviews", "gender": "customers", "age_group": "customers",
        "acquisition_channel": "customers", "promo_type": "promotions", "category": "products",
        "segment": "products", "traffic_source": "web_traffic",
    }
    return DailySpec(start, end, **{c: domain_values(cat[t], c) for c, t in places.items()})


def day_number(column: Column | str) -> Column:
    """Days since 1970 as a whole number."""
    return F.unix_date(col(column).cast("date")).cast("long")


def join_by_day(left: DataFrame, right: DataFrame) -> DataFrame:
    """``left`` with the columns of ``right`` for its ``date``.

    ``right`` has one row per day whatever the data, so it is broadcast: a chain of sorted joins would hold a page of memory per sort. Days are
    compared as whole numbers: a broadcast by a whole number takes the room of its rows, one by a date a page of 64 MB for itself.
    """
    days = right.select(day_number("date").alias("_day"), *[c for c in right.columns if c != "date"])
    return left.join(F.broadcast(days), day_number("date") == F.col("_day"), "left").drop("_day")


def on_spine(cat: Catalog, spec: DailySpec, *summaries: DataFrame) -> DataFrame:
    """Daily summaries left-joined to the calendar, missing numbers as 0."""
    return zero_filled(reduce(join_by_day, summaries, date_spine(cat.spark, spec.start, spec.end)))


def zero_filled(df: DataFrame) -> DataFrame:
    numeric = ("long", "integer", "double", "decimal")
    names = [f.name for f in df.schema.fields if f.dataType.typeName().split("(")[0] in numeric]
    return df.withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in names}) if names else df


def returns_by_day(returns: DataFrame) -> DataFrame:
    return returns.groupBy(F.col("return_date").alias("date")).agg(
        F.sum("return_quantity").alias("total_quantity_return"), F.sum("refund_amount").alias("total_refund_amount")
    )


def orders_by_day(orders: DataFrame, spec: DailySpec) -> DataFrame:
    """Orders and distinct customers, and counts of every status, method, device and source.

    Orders and counts are summed per day as they are read. Distinct customers are rows of a (day, customer) table that moves before it is
    made distinct: nearly every pair is new, so a scan that collected them first would hold all it reads. order_id is the key of the table,
    so orders need no distinct count.
    """
    hot = [c for a in ("order_status", "payment_method", "device_type", "order_source") for c in one_hot_counts(a, getattr(spec, a))]
    date = F.col("order_date").alias("date")
    rest = orders.groupBy(date).agg(F.count("order_id").alias("order_id"), *hot)
    pairs = orders.select(F.col("order_date").alias("_date"), "customer_id").where("customer_id IS NOT NULL")
    customers = pairs.repartition("_date", "customer_id").distinct().groupBy("_date").agg(F.count("*").alias("customer_id"))
    undated = F.lit(1 << 40)  # a number that no day has
    days = customers.select(F.coalesce(day_number("_date"), undated).alias("_day"), "customer_id")  # one row per day
    joined = rest.join(F.broadcast(days), F.coalesce(day_number("date"), undated) == F.col("_day"), "left")
    names = [c for c in rest.columns if c not in ("date", "order_id")]
    return joined.select("date", "order_id", F.coalesce("customer_id", F.lit(0).cast("long")).alias("customer_id"), *names)


def shipments_by_day(shipments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Shipped orders and fees by ship date; delivered orders by delivery date."""
    shipped = shipments.groupBy(F.col("ship_date").alias("date")).agg(
        F.count("order_id").alias("shipped_orders_count"), F.sum("shipping_fee").alias("total_shipping_fee")
    )
    delivered = shipments.groupBy(F.col("delivery_date").alias("date")).agg(
        F.count("order_id").alias("delivered_orders_count")
    )
    return shipped, delivered


def payments_by_day(orders: DataFrame, payments: DataFrame, spec: DailySpec) -> DataFrame:
    """Mean payment and installments per order date, and counts of the order's payment method."""
    paid = orders.select("order_id", "order_date", "payment_method").join(
        payments.select("order_id", "payment_value", "installments"), "order_id", "left"
    )
    return paid.groupBy(F.col("order_date").alias("date")).agg(
        mean_exact("payment_value").alias("payment_value"), mean_exact("installments").alias("installments"),
        *one_hot_counts("payment_method", spec.payment_method),
    )


def order_items_summary(order_items: DataFrame) -> DataFrame:
    """Per order: quantity, distinct products, mean discount, promotion flag."""
    return order_items.groupBy("order_id").agg(
        F.sum("quantity").alias("total_quantity_order_items"),
        F.count_distinct("product_id").alias("unique_products_count"),
        mean_exact("discount_amount").alias("avg_discount_amount"),
        F.max(flag(F.col("promo_id").isNotNull())).alias("has_promo_id"),
    )


def reviews_by_day(reviews: DataFrame, spec: DailySpec) -> DataFrame:
    """Distinct reviewed orders, customers and products, mean rating, title counts.

    Distinct ids are rows of a (day, kind, id) table, so a day with many reviews spreads over tasks.
    """
    date, kinds = F.col("review_date").alias("date"), ("order_id", "customer_id", "product_id")
    ids = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("id")) for k in kinds])
    pairs = reviews.select(date, F.inline(ids)).where("id IS NOT NULL").distinct()
    distinct = pairs.groupBy("date").agg(*[F.count_if(F.col("kind") == k).alias(f"{k}_reviews") for k in kinds])
    rest = reviews.groupBy(date).agg(mean_exact("rating").alias("rating"), *one_hot_counts("review_title", spec.review_title))
    return join_by_day(rest, distinct).select("date", *[f"{k}_reviews" for k in kinds], *rest.columns[1:])


def daily_customers(cat: Catalog, spec: DailySpec) -> DataFrame:
    """Sign-ups per day, and customers, attribute counts and cities known before each day.

    Sign-ups before the calendar count on its first day. A city counts from the day after its
    first sign-up, which makes the running distinct count a running sum.
    """
    attributes = ("gender", "age_group", "acquisition_channel")
    first, last = F.lit(spec.start).cast("date"), F.lit(spec.end).cast("date")
    hot = [c for a in attributes for c in one_hot_counts(a, getattr(spec, a))]
    names = [f"{a}_{slug(v)}" for a in attributes for v in getattr(spec, a)]
    # everything before the calendar is folded into the day before it
    bucket = F.greatest(F.date_sub(first, 1), F.col("signup_date"))
    signups = cat.customers.where(F.col("signup_date") <= last).groupBy(bucket.alias("date")).agg(
        F.count("*").alias("customer_daily_signup"), *hot
    )
    new_cities = cat.customers.groupBy("city").agg(F.min("signup_date").alias("d")).groupBy(
        F.greatest(F.date_sub(first, 1), F.col("d")).alias("date")
    ).agg(F.count("city").alias("new_cities"))
    day_before = F.date_format(F.date_sub(first, 1), "yyyy-MM-dd")
    spine = cat.spark.range(1).select(F.explode(F.sequence(F.to_date(day_before), last)).alias("date"))
    days = zero_filled(join_by_day(join_by_day(spine, signups), new_cities))
    before = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)  # calendar days
    known = {
        "customer_cumulative": "customer_daily_signup", "unique_cities_cumulative": "new_cities",
        **{f"{n}_cumulative": n for n in names},
    }
    out = days.withColumns({new: F.sum(old).over(before) for new, old in known.items()})
    return out.where(F.col("date") >= first).select("date", "customer_daily_signup", *known)


def promotions_in_use(cat: Catalog) -> Catalog:
    """The catalogue with only those promotions that an order line names."""
    named = cat.order_items.select("promo_id").distinct()
    return cat.replaced(promotions=cat.promotions.join(named, "promo_id", "left_semi"))


def daily_promotions(cat: Catalog, spec: DailySpec) -> DataFrame:
    """Whether any promotion runs, mean discount, minimum-order flag and types per day."""
    active = explode_interval(cat.promotions, "start_date", "end_date")
    types = [F.max(flag(F.col("promo_type") == v)).alias(f"promo_type_{slug(v)}") for v in spec.promo_type]
    per_day = active.groupBy("date").agg(
        F.max(flag(F.col("promo_id").isNotNull())).alias("promo_flag"),
        mean_exact("discount_value").alias("avg_discount_value"),
        F.max(flag(F.col("min_order_value") > 0)).alias("flag_min_order_value"), *types,
    )
    return on_spine(cat, spec, per_day)


INVENTORY_MEASURES = (
    "unique_products_in_stock", "total_stock_on_hand", "total_units_received", "total_units_sold",
    "avg_days_of_supply", "avg_fill_rate", "total_stockout_flags", "total_overstock_flags", "avg_sell_through_rate",
)


def inventory_snapshots(inventory: DataFrame, spec: DailySpec) -> DataFrame:
    """Stock totals and means per snapshot date, with products per category and segment.

    A product's first row of a date counts it: rows are sorted as they are, where a distinct count would keep all these sums per product and date.
    """
    same = Window.partitionBy("snapshot_date", "product_id").orderBy("product_id")  # one row, unless a product is listed twice
    first = (F.row_number().over(same) == 1) & F.col("product_id").isNotNull()
    return inventory.withColumn("_first", first).groupBy("snapshot_date").agg(
        F.count_if("_first").alias("unique_products_in_stock"),
        F.sum("stock_on_hand").alias("total_stock_on_hand"), F.sum("units_received").alias("total_units_received"),
        F.sum("units_sold").alias("total_units_sold"), F.avg("days_of_supply").alias("avg_days_of_supply"),
        F.avg("fill_rate").alias("avg_fill_rate"), F.sum("stockout_flag").alias("total_stockout_flags"),
        F.sum("overstock_flag").alias("total_overstock_flags"),
        F.avg("sell_through_rate").alias("avg_sell_through_rate"),
        *one_hot_counts("category", spec.category), *one_hot_counts("segment", spec.segment),
    )


def daily_inventory(cat: Catalog, spec: DailySpec) -> DataFrame:
    """Last known snapshot per day (known from the day after), its age, and age copies."""
    snapshots = inventory_snapshots(cat.inventory, spec)
    columns = [c for c in snapshots.columns if c != "snapshot_date"]
    spine = date_spine(cat.spark, spec.start, spec.end)
    days = zero_filled(as_of_daily(spine, snapshots, "date", "snapshot_date", columns))
    return days.withColumns({f"{c}_gap": F.col("days_since_snapshot") for c in columns})


def web_by_day(web_traffic: DataFrame, spec: DailySpec) -> DataFrame:
    """One row per day: metrics added up or averaged over sources, and sources present."""
    return web_traffic.groupBy("date").agg(
        F.sum("sessions").alias("sessions"), F.sum("unique_visitors").alias("unique_visitors"),
        F.sum("page_views").alias("page_views"), F.avg("bounce_rate").alias("bounce_rate"),
        F.avg("avg_session_duration_sec").alias("avg_session_duration_sec"),
        *one_hot_counts("traffic_source", spec.traffic_source, "traffic"),
    )


def daily_web(cat: Catalog, spec: DailySpec) -> DataFrame:
    """Web metrics on the calendar; days before the first real one are marked as simulated."""
    first = cat.web_traffic.agg(F.min("date").alias("d")).scalar()
    return on_spine(cat, spec, web_by_day(cat.web_traffic, spec)).withColumn(
        "is_web_data_simulated", F.coalesce(flag(F.col("date") < first), F.lit(0))
    )


def daily_returns(cat: Catalog, spec: DailySpec) -> DataFrame:
    return on_spine(cat, spec, returns_by_day(cat.returns))


def daily_shipments(cat: Catalog, spec: DailySpec) -> DataFrame:
    return on_spine(cat, spec, *shipments_by_day(cat.shipments))


def daily_reviews(cat: Catalog, spec: DailySpec) -> DataFrame:
    return on_spine(cat, spec, reviews_by_day(cat.reviews, spec))


def daily_master(cat: Catalog, spec: DailySpec) -> DataFrame:
    """Customer and promotion columns on one calendar."""
    return join_by_day(daily_customers(cat, spec), daily_promotions(cat, spec))


def processed_daily(cat: Catalog, spec: DailySpec, legacy: bool = False) -> DataFrame:
    """The full daily feature table with the sales target; ``legacy`` leaves out the master columns.

    Every part has one row per calendar day, so this is a chain of joins of small tables after
    each fact was aggregated once.
    """
    payments = payments_by_day(cat.orders, cat.payments, spec).select("date", "payment_value", "installments")
    sales = cat.sales.select(F.col("Date").alias("date"), "Revenue", "COGS")
    out = on_spine(
        cat, spec, orders_by_day(cat.orders, spec), payments, returns_by_day(cat.returns),
        *shipments_by_day(cat.shipments), reviews_by_day(cat.reviews, spec), sales,
    )
    parts = [] if legacy else [daily_customers(cat, spec), daily_promotions(cat, spec)]
    return reduce(join_by_day, [*parts, daily_inventory(cat, spec), daily_web(cat, spec)], out)
