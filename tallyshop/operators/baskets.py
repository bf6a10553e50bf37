"""Market baskets: frequent itemsets, association rules, buyers of a pair."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyshop.functions.columns import total_of
from tallyshop.session import materialise
from tallyshop.sources.tables import Catalog


def basket_items(cat: Catalog, item: str, status: str | None = "delivered") -> DataFrame:
    """Distinct (order, item) rows of one order status; every item takes part, whatever its sales.

    Rare items cost little: the miner drops those below its support, exactly.
    """
    orders = cat.orders.where(F.col("order_status") == status) if status else cat.orders
    lines = cat.order_items.select("order_id", "product_id").join(orders.select("order_id"), "order_id", "left_semi")
    named = lines.join(cat.products.select("product_id", F.col(item).alias("item")), "product_id")
    return named.where(F.col("item").isNotNull()).select("order_id", "item").distinct()


def frequent_itemsets(items: DataFrame, min_support: float = 0.005) -> tuple[DataFrame, DataFrame]:
    """Itemsets (sorted) with their frequency, and a one-row table with the number of baskets."""
    baskets = materialise(items.groupBy("order_id").agg(F.collect_list("item").alias("items")))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=0.0).fit(baskets)
    sets = materialise(model.freqItemsets.select(F.sort_array("items").alias("items"), "freq"))
    return sets, baskets.agg(F.count("*").alias("baskets"))


def association_rules(sets: DataFrame, baskets: DataFrame, min_confidence: float, min_lift: float) -> DataFrame:
    """Rules of every split of an itemset, consequents of any size.

    A frequent itemset is split by bit masks; supports of both sides come from the table of
    itemsets by equality joins (every subset of a frequent set is in it).
    """
    n = baskets.select("baskets").scalar()
    size = F.size("items")
    masks = F.sequence(F.lit(1), (F.pow(F.lit(2), size) - 2).cast("int"))
    splits = sets.where(size > 1).withColumn("_mask", F.explode(masks))

    def side(inside: int):
        def picked(_, i):
            return F.expr("_mask").bitwiseAND(F.pow(F.lit(2), i).cast("int")) > 0 if inside else (
                F.expr("_mask").bitwiseAND(F.pow(F.lit(2), i).cast("int")) == 0
            )

        return F.filter("items", picked)

    rules = splits.select(
        side(1).alias("antecedent"), side(0).alias("consequent"), F.col("freq").alias("both")
    )
    left = sets.select(F.col("items").alias("antecedent"), F.col("freq").alias("freq_a"))
    right = sets.select(F.col("items").alias("consequent"), F.col("freq").alias("freq_c"))
    joined = rules.join(left, "antecedent").join(right, "consequent")
    measured = joined.select(
        F.concat_ws(", ", "antecedent").alias("antecedent"), F.concat_ws(", ", "consequent").alias("consequent"),
        (F.col("both") / n).alias("support"), (F.col("both") / F.col("freq_a")).alias("confidence"),
        (F.col("both") * n / (F.col("freq_a").cast("double") * F.col("freq_c"))).alias("lift"),
    )
    kept = measured.where((F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift))
    return kept.withColumn("rule", F.concat_ws(" → ", "antecedent", "consequent"))


def market_basket(
    cat: Catalog, item: str = "product_name", min_support: float = 0.005, min_lift: float = 1.2,
    min_confidence: float = 0.3, status: str | None = "delivered",
) -> DataFrame:
    """Association rules of a product attribute over the baskets of one order status."""
    sets, baskets = frequent_itemsets(basket_items(cat, item, status), min_support)
    return association_rules(sets, baskets, min_confidence, min_lift)


def pair_buyers(cat: Catalog, first: str, second: str, status: str | None = "delivered") -> DataFrame:
    """Customers with at least one order that holds both products (by name)."""
    orders = cat.orders.where(F.col("order_status") == status) if status else cat.orders
    products = cat.products.where(F.col("product_name").isin(first, second)).select("product_id", "product_name")
    lines = cat.order_items.select("order_id", "product_id").join(products, "product_id")
    both = lines.groupBy("order_id").agg(
        F.bool_or(F.col("product_name") == first).alias("a"), F.bool_or(F.col("product_name") == second).alias("b")
    ).where("a AND b")
    return orders.join(both, "order_id", "left_semi").select("customer_id").distinct()


def pair_buyer_profile(buyers: DataFrame, attributes: DataFrame, columns: list[str]) -> DataFrame:
    """Counts and shares of the buyers by each attribute (channel, source, segment)."""
    joined = attributes.join(buyers, "customer_id", "left_semi")
    pairs = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns])
    counts = joined.select(F.inline(pairs)).groupBy("dimension", "value").agg(F.count("*").alias("customers"))
    whole = total_of(F.when(F.col("dimension") == columns[0], F.col("customers")).otherwise(0))
    return counts.withColumn("pct", F.try_divide(F.col("customers").cast("double"), whole) * 100)
