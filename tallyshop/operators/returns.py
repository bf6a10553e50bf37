"""Returns analyses: rates by any attribute, trends, profit impact, refund concentration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyshop.functions.columns import cut, flag, money, month_of, net_value, r6, ratio, total_of
from tallyshop.functions.scale import lookup, percentile_scalar
from tallyshop.operators.customers import pareto
from tallyshop.operators.marts import returns_per_line
from tallyshop.sources.tables import Catalog

DIMENSIONS = {
    "order": ("order_id",), "category": ("category",), "product": ("product_name",), "size": ("size",),
    "category_size": ("category", "size"), "region": ("region",), "promo": ("has_promo",), "month": ("month",),
}


def returned_lines(cat: Catalog) -> DataFrame:
    """Order lines with their returns summed per line, and net revenue."""
    lines = cat.order_items.select(
        "order_id", "product_id", "quantity", net_value().alias("revenue"),
        flag(F.col("promo_id").isNotNull()).alias("has_promo"),
    )
    return lookup(lines, returns_per_line(cat.returns), ["order_id", "product_id"]).withColumns(
        {
            "return_qty": F.coalesce("return_qty", F.lit(0)),
            "refund_amount": F.coalesce("refund_amount", F.lit(0)),
        }
    )


def return_kpis(lines: DataFrame) -> DataFrame:
    """Sold, returned, return rate, refund and refund ratio over everything."""
    agg = lines.agg(
        F.sum("quantity").alias("total_sold"), F.sum("return_qty").alias("total_returned"),
        F.sum("refund_amount").alias("refund"), F.sum("revenue").alias("revenue"),
    )
    return agg.select(
        "total_sold", "total_returned", r6(ratio("total_returned", "total_sold")).alias("return_rate"),
        money("refund").alias("total_refund"), money("revenue").alias("total_revenue"),
        r6(ratio("refund", "revenue")).alias("refund_ratio"),
    )


def return_by(cat: Catalog, dimension: str) -> DataFrame:
    """Return rate and refund by an attribute of the order, product, place or promotion."""
    lines, keys = returned_lines(cat), list(DIMENSIONS[dimension])
    if dimension in ("region", "month"):
        orders = cat.orders.select("order_id", "zip", month_of("order_date").alias("month"))
        lines = lines.join(orders, "order_id")
    if dimension in ("category", "product", "size", "category_size"):
        per_product = lines.groupBy("product_id").agg(
            *[F.sum(c).alias(c) for c in ("quantity", "return_qty", "refund_amount")]
        )  # a best-seller is one row before the lookup
        products = cat.products.select("product_id", "product_name", "category", "size")
        lines = lookup(per_product, products, ["product_id"])
    if dimension == "region":
        per_zip = lines.groupBy("zip").agg(*[F.sum(c).alias(c) for c in ("quantity", "return_qty", "refund_amount")])
        lines = lookup(per_zip, cat.geography.select("zip", "region"), ["zip"])
    agg = lines.groupBy(*keys).agg(
        F.sum("quantity").alias("sold_qty"), F.sum("return_qty").alias("return_qty"),
        F.sum("refund_amount").alias("refund"),
    )
    present = agg.dropna(subset=keys)
    return present.select(
        *keys, "sold_qty", "return_qty", r6(ratio("return_qty", "sold_qty")).alias("return_rate"),
        money("refund").alias("refund_amount"),
    )


def return_rate_grid(cat: Catalog, sizes: tuple[str, ...] = ("S", "M", "L", "XL")) -> DataFrame:
    """Return rate by category (rows) and size (columns)."""
    cells = return_by(cat, "category_size")
    wide = cells.groupBy("category").pivot("size", list(sizes)).agg(F.max("return_rate"))
    return wide.select("category", *[F.col(s).alias(f"rate_{s}") for s in sizes])


def top_products_by_rate(products: DataFrame, k: int = 15) -> DataFrame:
    return products.orderBy(F.desc("return_rate"), "product_name").limit(k)


def reliable_product_returns(products: DataFrame, quantile: float = 0.75, k: int = 15) -> DataFrame:
    """Highest return rates among products sold at least as much as the given percentile."""
    threshold = percentile_scalar(products, "sold_qty", quantile)
    return top_products_by_rate(products.where(F.col("sold_qty") >= threshold), k)


def return_trend(cat: Catalog) -> DataFrame:
    """Monthly sold and returned quantity, revenue, refund and both rates."""
    lines = returned_lines(cat)
    measures = ("quantity", "return_qty", "refund_amount", "revenue")
    monthly = (
        lines.join(cat.orders.select("order_id", month_of("order_date").alias("month")), "order_id")
        .groupBy("month")
        .agg(*[F.sum(c).alias(c) for c in measures])
    )
    return monthly.select(
        "month", F.col("quantity").alias("sold_qty"), "return_qty",
        r6(ratio("return_qty", "quantity")).alias("return_rate"), money("revenue").alias("revenue"),
        money("refund_amount").alias("refund"), r6(ratio("refund_amount", "revenue")).alias("refund_rate"),
    )


def return_reasons(returns: DataFrame) -> DataFrame:
    """Events, returned quantity and share of quantity per reason."""
    agg = returns.where("return_quantity > 0").groupBy("return_reason").agg(
        F.count("*").alias("events"), F.sum("return_quantity").alias("return_qty")
    )
    return agg.withColumn("share", r6(ratio("return_qty", total_of("return_qty"))))


def return_by_delivery_bucket(cat: Catalog) -> DataFrame:
    """Return rate by delivery band; deliveries outside the bands are left out."""
    days = F.datediff("delivery_date", "ship_date")
    bands = cat.shipments.select(
        "order_id", cut(days, [0, 2, 4, 5, 7], ["0-2d", "2-4d", "4-5d", "5-7d"]).alias("delivery_bucket")
    ).where("delivery_bucket IS NOT NULL")
    agg = returned_lines(cat).join(bands, "order_id").groupBy("delivery_bucket").agg(
        F.sum("quantity").alias("total_qty"), F.sum("return_qty").alias("return_qty")
    )
    return agg.withColumn("return_rate", r6(ratio("return_qty", "total_qty")))


def profit_impact(cat: Catalog) -> DataFrame:
    """Profit before and after refunds, in long form."""
    per_product = returned_lines(cat).groupBy("product_id").agg(
        *[F.sum(c).alias(c) for c in ("quantity", "revenue", "refund_amount")]
    )
    costed = lookup(per_product, cat.products.select("product_id", "cogs"), ["product_id"])
    totals = costed.agg(
        F.sum(F.col("revenue") - F.col("quantity") * F.col("cogs")).alias("before"),
        F.sum("refund_amount").alias("refund"),
    ).select(
        money("before").alias("total_profit_before"),
        money(F.col("before") - F.col("refund")).alias("total_profit_after"),
    )
    return totals.unpivot([], ["total_profit_before", "total_profit_after"], "metric", "value")


def refund_pareto(cat: Catalog) -> DataFrame:
    """Products from the largest refund down, with their cumulative share."""
    per_product = returned_lines(cat).groupBy("product_id").agg(F.sum("refund_amount").alias("refund"))
    curve = pareto(per_product, "product_id", "refund")
    named = lookup(curve, cat.products.select("product_id", "product_name"), ["product_id"])
    return named.select(
        "product_id", "product_name", "position", money("refund").alias("total_refund"),
        money("cumulative").alias("cum_refund"), r6("cum_pct").alias("cum_pct"),
    )


def refund_cutoff(cat: Catalog, share: float = 0.8) -> DataFrame:
    """How many products make up the given share of refunds."""
    per_product = returned_lines(cat).groupBy("product_id").agg(F.sum("refund_amount").alias("refund"))
    curve = pareto(per_product, "product_id", "refund")
    return curve.agg(
        F.min(F.when(F.col("cum_pct") >= share, F.col("position"))).alias("products_to_cutoff"),
        F.max("position").alias("products"),
    ).withColumn("share_of_products", r6(ratio("products_to_cutoff", "products")))
