"""Profiling, quality checks and cleaning."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyshop.functions.columns import (
    col,
    count_if,
    dbl,
    flag,
    money,
    month_of,
    net_value,
    r6,
    ratio,
)
from tallyshop.functions.scale import lookup, percentile_table
from tallyshop.functions.spine import spine_of
from tallyshop.session import materialise

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def long_values(df: DataFrame, columns: Iterable[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Numeric columns as (column, value) rows, so that one pass serves them all."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), dbl(c).alias("value")) for c in columns])
    return df.select(*by, F.inline(pairs))


def profile_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, standard deviation, minimum, quartiles and maximum per column."""
    rows = long_values(df, columns)
    basic = rows.groupBy("column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    return basic.join(percentile_table(rows, "value", QUARTILES, ("column",), few_groups=True), "column", "left")


def profile_categorical(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, distinct values, most frequent value (smallest on ties) and its frequency."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    counts = df.select(F.inline(pairs)).where("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n"))
    return counts.groupBy("column").agg(
        F.sum("n").alias("count"), F.count("*").alias("unique"),
        F.min_by("value", F.struct((-F.col("n")).alias("n"), F.col("value").alias("v"))).alias("top"),
        F.max("n").alias("freq"),
    )


def null_counts(df: DataFrame) -> DataFrame:
    """NULLs per column, one row per column, in one pass."""
    names = df.columns
    wide = df.agg(*[count_if(F.col(c).isNull()).alias(c) for c in names])
    return wide.unpivot([], names, "column", "nulls")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row in every column (NULLs equal)."""
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    return groups.agg(F.sum("_n").alias("rows"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def duplicate_key_count(df: DataFrame, *keys: str) -> DataFrame:
    """Number of rows that repeat an earlier row's key."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeats"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Frequency and share of every value, NULL included, most frequent first."""
    counts = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    total = df.select(F.count("*").alias("rows")).scalar()
    return counts.withColumn("pct", r6(ratio("n", total) * 100)).orderBy(F.desc("n"), "value")


def crosstab(df: DataFrame, row: str, column: str) -> DataFrame:
    """Counts of two columns with row percentages and row totals (long form: a row per cell)."""
    cells = df.where(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(row, column).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(row))  # one row per value of the column
    return cells.withColumns({"row_total": total, "row_pct": r6(ratio("n", total) * 100)})


def domain_listing(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values per column, and how many there are."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    values = df.select(F.inline(pairs)).where("value IS NOT NULL").distinct()
    sizes = values.groupBy("column").agg(F.count("*").alias("distinct_values"))
    return lookup(values, sizes, ["column"]).orderBy("column", "value")


def orphan_keys(fact: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Fact keys missing from the dimension, rows affected, unused dimension keys, matches.

    Both sides are reduced to one row per key before they meet.
    """
    left = fact.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("rows"))
    right = dimension.where(F.col(key).isNotNull()).select(key, F.lit(1).alias("known")).distinct()
    both = left.join(right, key, "full")
    missing, unused = F.col("known").isNull(), F.col("rows").isNull()
    return both.agg(
        count_if(missing).alias("orphan_keys"), F.coalesce(F.sum(F.when(missing, F.col("rows"))), F.lit(0)).alias("orphan_rows"),
        count_if(unused).alias("unused_keys"), count_if(~missing & ~unused).alias("matched_keys"),
    )


# --- rules -------------------------------------------------------------------------------------

RULES: dict[str, dict[str, str]] = {
    "order_items": {
        "quantity_negative": "quantity < 0", "unit_price_negative": "unit_price < 0",
        "discount_above_value": "discount_amount > quantity * unit_price",
    },
    "payments": {"payment_negative": "payment_value < 0", "installments_below_one": "installments < 1"},
    "shipments": {"fee_negative": "shipping_fee < 0", "delivered_before_shipped": "delivery_date < ship_date"},
    "returns": {"quantity_not_positive": "return_quantity <= 0", "refund_negative": "refund_amount < 0"},
    "reviews": {"rating_out_of_range": "rating < 1 OR rating > 5"},
    "sales": {"cogs_above_revenue": "COGS > Revenue"},
    "products": {"cogs_not_below_price": "cogs >= price"},
    "inventory": {"sold_above_received": "units_sold > units_received"},
}


def rule_check(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Rows breaking each rule, all rules in one pass over the table."""
    wide = df.agg(*[count_if(F.expr(text)).alias(name) for name, text in rules.items()])
    return wide.unpivot([], list(rules), "rule", "violations")


def rule_violations(df: DataFrame, condition: str) -> DataFrame:
    """The rows that break one rule."""
    return df.where(condition)


def check_all_rules(cat) -> DataFrame:
    """Every rule over its table, in one (table, rule, violations) listing."""
    out = None
    for table, rules in RULES.items():
        part = rule_check(cat[table], rules).select(F.lit(table).alias("table"), "rule", "violations")
        out = part if out is None else out.unionByName(part)
    return out


def status_rule_check(shipments: DataFrame, orders: DataFrame, allowed: tuple[str, ...] = ("shipped", "delivered", "returned")) -> DataFrame:
    """Shipments of orders whose status does not allow one."""
    bad = orders.where(~F.col("order_status").isin(*allowed)).select("order_id", "order_status")
    return shipments.select("order_id", "ship_date").join(bad, "order_id")


def payment_method_mismatch(orders: DataFrame, payments: DataFrame) -> DataFrame:
    """Orders whose payment names another method (a missing side differs too)."""
    paid = payments.select("order_id", F.col("payment_method").alias("payment_method_paid"))
    joined = orders.select("order_id", "payment_method").join(paid, "order_id", "left")
    same = F.coalesce(F.col("payment_method") == F.col("payment_method_paid"), F.lit(False))
    return joined.where(~same)


def order_payment_reconcile(order_items: DataFrame, payments: DataFrame, eps: float = 1e-8) -> DataFrame:
    """Orders whose lines do not add up to the payment."""
    per_order = order_items.groupBy("order_id").agg(F.sum(net_value()).alias("total_price"))
    joined = per_order.join(payments.select("order_id", "payment_value"), "order_id", "left")
    distance = F.abs(dbl(F.col("total_price") - F.col("payment_value")))
    return joined.withColumn("distance", distance).where(F.col("distance") > eps)


def missing_days(df: DataFrame, date: str) -> DataFrame:
    """Calendar days between the first and last day that the table lacks."""
    seen = df.select(F.col(date).alias("date"))
    return spine_of(df, date, "date").join(seen, "date", "left_anti")


def day_coverage(df: DataFrame, date: str) -> DataFrame:
    """Expected, seen and missing days."""
    return df.agg(
        (F.datediff(F.max(date), F.min(date)) + 1).alias("expected_days"), F.count_distinct(date).alias("seen_days")
    ).withColumn("missing_days", F.col("expected_days") - F.col("seen_days"))


def duplicate_dates(df: DataFrame, date: str) -> DataFrame:
    return duplicate_keys(df, date)


def derived_column_check(inventory: DataFrame) -> DataFrame:
    """Rows whose stored year or month is not that of the snapshot date."""
    return inventory.agg(
        F.count("*").alias("rows"), count_if(F.col("year") != F.year("snapshot_date")).alias("year_mismatches"),
        count_if(F.col("month") != F.month("snapshot_date")).alias("month_mismatches"),
    )


def recompute_check(inventory: DataFrame, atol: float = 0.1, rtol: float = 1e-5) -> DataFrame:
    """Share of rows whose days of supply equal stock over daily sales (0 when nothing sold)."""
    daily = ratio("units_sold", F.lit(30))
    again = F.coalesce(F.try_divide(dbl("stock_on_hand"), daily), F.lit(0.0))
    close = F.abs(again - F.col("days_of_supply")) <= atol + rtol * F.abs(F.col("days_of_supply"))
    return inventory.agg(F.count("*").alias("rows"), count_if(close).alias("matches")).withColumn(
        "match_pct", r6(ratio("matches", "rows") * 100)
    )


def all_month_end(inventory: DataFrame) -> DataFrame:
    """Whether every snapshot is a month end, and how many months there are."""
    return inventory.agg(
        flag(F.bool_and(F.col("snapshot_date") == F.last_day("snapshot_date"))).alias("all_month_end"),
        F.count_distinct(month_of("snapshot_date")).alias("months"),
    )


def functional_dependency(df: DataFrame, key: str, attribute: str) -> DataFrame:
    """Keys with more than one value of an attribute that should depend on them."""
    pairs = df.select(key, attribute).where(F.col(attribute).isNotNull()).distinct()
    return pairs.groupBy(key).agg(F.count("*").alias("values")).where("values > 1")


VARIANT_ATTRIBUTES = ("category", "segment", "size", "color")


def duplicate_name_groups(products: DataFrame) -> DataFrame:
    """Names shared by several products: how many, first and last id, differing attributes."""
    return products.groupBy("product_name").agg(
        F.count("*").alias("products"), F.min("product_id").alias("first_id"), F.max("product_id").alias("last_id"),
        *[F.count_distinct(a).alias(f"{a}_values") for a in VARIANT_ATTRIBUTES],
    ).where("products > 1")


def duplicate_name_ids(products: DataFrame) -> DataFrame:
    """The ids behind each shared name, one row per id (a list would grow with the name's use)."""
    shared = products.groupBy("product_name").agg(F.count("*").alias("products")).where("products > 1")
    return lookup(products.select("product_name", "product_id"), shared, ["product_name"], "inner")


def referenced_products(*tables: DataFrame) -> DataFrame:
    """Distinct product ids used in any of the tables."""
    used = None
    for table in tables:
        ids = table.select("product_id").distinct()
        used = ids if used is None else used.union(ids)
    return used.distinct()


def drop_unreferenced_duplicates(products: DataFrame, *facts: DataFrame) -> DataFrame:
    """Products without those that share a name and appear in no fact."""
    shared = products.groupBy("product_name").agg(F.count("*").alias("_n")).where("_n > 1").select("product_name")
    unused = products.join(referenced_products(*facts), "product_id", "left_anti")
    gone = unused.join(shared, "product_name", "left_semi").select("product_id")
    return products.join(gone, "product_id", "left_anti")


def price_anomaly(products: DataFrame, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """Products priced far from the median of their name group."""
    medians = percentile_table(products, "price", {"median_price": 0.5}, ("product_name",))
    joined = lookup(products.select("product_id", "product_name", "price"), medians, ["product_name"])
    price = dbl("price")
    return joined.where((price < low * F.col("median_price")) | (price > high * F.col("median_price"))).select(
        "product_id", "product_name", money("price").alias("price"), r6("median_price").alias("median_price")
    )


def iqr_bounds(df: DataFrame, columns: list[str], factor: float = 1.5) -> DataFrame:
    """Quartiles and outlier bounds per column."""
    return _bounds(long_values(df, columns), factor)


def _bounds(rows: DataFrame, factor: float = 1.5) -> DataFrame:
    """Quartiles and outlier bounds of (column, value) rows."""
    return percentile_table(rows, "value", {"q1": 0.25, "q3": 0.75}, ("column",), few_groups=True).withColumns(
        {
            "lower": F.col("q1") - factor * (F.col("q3") - F.col("q1")),
            "upper": F.col("q3") + factor * (F.col("q3") - F.col("q1")),
        }
    )


def iqr_outliers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Bounds and number of values outside them, per column. The values are read twice, so they are written once."""
    values = materialise(long_values(df, columns))
    rows = values.join(F.broadcast(_bounds(values)), "column", "left")  # one row per column
    return rows.groupBy("column").agg(
        F.max("q1").alias("q1"), F.max("q3").alias("q3"), F.max("lower").alias("lower"), F.max("upper").alias("upper"),
        count_if(F.col("value") < F.col("lower")).alias("below"), count_if(F.col("value") > F.col("upper")).alias("above"),
    )


def upper_outliers_by_month(inventory: DataFrame, column: str = "sell_through_rate") -> DataFrame:
    """Rows above the upper bound, counted by year and month, most first."""
    upper = iqr_bounds(inventory, [column]).select("upper").scalar()
    return (
        inventory.where(F.col(column) > upper).groupBy("year", "month")
        .agg(F.count("*").alias("outlier_count")).orderBy(F.desc("outlier_count"), "year", "month")
    )


def monotonic_stock(inventory: DataFrame) -> DataFrame:
    """Products whose stock ever falls, with the number of falls (one row per month and product)."""
    before = F.lag("stock_on_hand").over(Window.partitionBy("product_id").orderBy("snapshot_date"))
    steps = inventory.select("product_id", flag(F.col("stock_on_hand") < before).alias("fall"))
    return steps.groupBy("product_id").agg(F.sum("fall").alias("falls")).where("falls > 0")


def monotonic_summary(inventory: DataFrame) -> DataFrame:
    """Whether no product's stock ever falls, and how many violate it."""
    return monotonic_stock(inventory).agg(
        flag(F.count("*") == 0).alias("all_increasing"), F.count("*").alias("violating_products")
    )


def fill_default(df: DataFrame, column: str, value: object) -> DataFrame:
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(value)))


def feature_group_quality(daily: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Share of zero and of NULL cells per named group of daily columns."""
    parts = []
    for name, columns in groups.items():
        cells = F.lit(len(columns)) * F.count("*")
        zero = sum((F.sum(flag(F.col(c) == 0)) for c in columns), F.lit(0))
        null = sum((F.sum(flag(F.col(c).isNull())) for c in columns), F.lit(0))
        parts.append(
            F.struct(F.lit(name).alias("feature_group"), F.lit(len(columns)).alias("columns"),
                     r6(ratio(zero, cells) * 100).alias("zero_pct"), r6(ratio(null, cells) * 100).alias("null_pct"))
        )
    return daily.agg(F.array(*parts).alias("parts")).select(F.inline("parts"))


def feature_group_activity(daily: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Share of days per month on which a group has any value other than zero."""
    active = {
        name: flag(F.greatest(*[F.abs(F.coalesce(dbl(c), F.lit(0.0))) for c in [*columns, columns[0]]]) > 0)
        for name, columns in groups.items()
    }
    monthly = daily.withColumns({f"_{n}": c for n, c in active.items()}).groupBy(F.last_day("date").alias("month_end")).agg(
        *[r6(ratio(F.sum(f"_{n}"), F.count("*")) * 100).alias(n) for n in groups]
    )
    return monthly


def gross_loss_days(sales: DataFrame) -> DataFrame:
    """Days on which COGS exceeded revenue: total and share, and counts by year, month, weekday."""
    loss = flag(F.col("Revenue") < F.col("COGS"))
    parts = F.array(
        F.struct(F.lit("all").alias("grain"), F.lit(0).alias("bucket")),
        F.struct(F.lit("year").alias("grain"), F.year("Date").alias("bucket")),
        F.struct(F.lit("month").alias("grain"), F.month("Date").alias("bucket")),
        F.struct(F.lit("weekday").alias("grain"), F.weekday("Date").alias("bucket")),
    )
    days = sales.select("Date", loss.alias("loss"), F.inline(parts))
    return days.groupBy("grain", "bucket").agg(F.count("*").alias("days"), F.sum("loss").alias("loss_days")).withColumn(
        "loss_pct", r6(ratio("loss_days", "days") * 100)
    )


def histogram(df: DataFrame, value: Column | str, bins: int) -> DataFrame:
    """Equal-width bins over the range of a column; the maximum belongs to the last bin."""
    rows = df.select(dbl(value).alias("v")).where("v IS NOT NULL")
    edge = rows.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi")).alias("s")).scalar()
    step = F.try_divide(edge["hi"] - edge["lo"], F.lit(float(bins)))
    bucket = F.least(F.coalesce(F.floor(F.try_divide(col("v") - edge["lo"], step)), F.lit(0)), F.lit(bins - 1))
    return rows.groupBy(bucket.alias("bin")).agg(F.count("*").alias("n"))


def histograms(df: DataFrame, bins: dict[str, int]) -> DataFrame:
    """Equal-width bins over the range of several columns in one pass: (measure, bin, low, n). The maximum belongs to the last bin.

    A column with one value has one bin. Null values are left out.
    """
    values = long_values(df, list(bins)).where("value IS NOT NULL")
    counts = F.create_map(*[F.lit(v) for pair in bins.items() for v in pair])
    ends = values.groupBy("column").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).withColumn("_bins", F.try_element_at(counts, F.col("column")))
    step = F.try_divide(F.col("hi") - F.col("lo"), F.col("_bins").cast("double"))
    at = F.least(F.coalesce(F.floor(F.try_divide(F.col("value") - F.col("lo"), step)), F.lit(0)), F.col("_bins") - 1)
    binned = values.join(F.broadcast(ends), "column")  # one row per measure
    return binned.groupBy(F.col("column").alias("measure"), at.cast("long").alias("bin")).agg(F.min("value").alias("low"), F.count("*").alias("n"))


def box_summary(df: DataFrame, value: str, *groups: str) -> DataFrame:
    """Five-number summary per group."""
    ends = df.groupBy(*groups).agg(dbl(F.min(value)).alias("min"), dbl(F.max(value)).alias("max"), F.count(value).alias("n"))
    return ends.join(percentile_table(df, value, QUARTILES, groups), list(groups))


