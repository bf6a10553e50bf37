"""Queries for profiling, quality checks and cleaning."""

from pyspark.sql import functions as F

from tallyshop.functions.columns import shown
from tallyshop.operators import quality as op
from tallyshop.plans.daily import SOURCES, daily_table, source_columns
from tallyshop.plans.registry import big, money, query, r6


def _union(parts) -> str:
    return " UNION ALL ".join(parts)


_INVENTORY_NUMBERS = ["stock_on_hand", "units_received", "units_sold", "days_of_supply", "fill_rate", "sell_through_rate"]


@query(
    "profile_numeric",
    _union(
        f"""SELECT '{c}' AS "column", count({c}) AS count, {r6(f'avg({c})')} AS mean, {r6(f'stddev_samp({c})')} AS std, {r6(f'min({c})')} AS min, {r6(f'max({c})')} AS max,
            {r6(f'quantile_cont(cast({c} AS double), 0.25)')} AS q1, {r6(f'quantile_cont(cast({c} AS double), 0.5)')} AS median, {r6(f'quantile_cont(cast({c} AS double), 0.75)')} AS q3 FROM r_inventory"""
        for c in _INVENTORY_NUMBERS
    ),
)
def _(cat):
    return shown(op.profile_numeric(cat.inventory, _INVENTORY_NUMBERS))


_TOP = """SELECT '{c}' AS "column", cast(sum(n) AS bigint) AS count, count(*) AS "unique", (SELECT cast({c} AS string) FROM r_products WHERE {c} IS NOT NULL GROUP BY {c}
          ORDER BY count(*) DESC, cast({c} AS string) LIMIT 1) AS top, max(n) AS freq FROM (SELECT {c}, count(*) AS n FROM r_products WHERE {c} IS NOT NULL GROUP BY {c}) x"""
_ATTRIBUTES = ["product_name", "category", "segment", "size", "color"]


@query("profile_categorical", _union(_TOP.format(c=c) for c in _ATTRIBUTES))
def _(cat):
    return op.profile_categorical(cat.products, _ATTRIBUTES)


_PROMO_COLUMNS = ["order_id", "product_id", "quantity", "unit_price", "discount_amount", "promo_id", "promo_id_2"]


@query(
    "null_counts",
    _union(f"""SELECT '{c}' AS "column", count(*) - count({c}) AS nulls FROM r_order_items""" for c in _PROMO_COLUMNS),
)
def _(cat):
    return op.null_counts(cat.order_items.select(*_PROMO_COLUMNS))


@query(
    "duplicate_rows",
    """SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem) d) AS duplicates FROM lineitem""",
)
def _(cat):
    return op.duplicate_rows(cat.spark.read.parquet(cat.source("lineitem")))


@query(
    "duplicate_lines_of_a_part",
    """SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey, l_returnflag FROM lineitem) d) AS duplicates FROM lineitem""",
)
def _(cat):
    lines = cat.spark.read.parquet(cat.source("lineitem"))
    return op.duplicate_rows(lines.select("l_orderkey", "l_partkey", "l_returnflag"))


@query("duplicate_keys", "SELECT product_name, count(*) AS n FROM r_products GROUP BY product_name HAVING count(*) > 1")
def _(cat):
    return op.duplicate_keys(cat.products, "product_name")


@query(
    "duplicate_key_count",
    "SELECT count(*) - count(DISTINCT (order_id, product_id)) AS repeats FROM r_returns",
)
def _(cat):
    return op.duplicate_key_count(cat.returns, "order_id", "product_id")


@query("duplicate_dates", "SELECT date, count(*) AS n FROM r_web_traffic GROUP BY date HAVING count(*) > 1")
def _(cat):
    return op.duplicate_dates(cat.web_traffic, "date")


@query(
    "value_counts",
    f"""SELECT cast(promo_id AS string) AS value, count(*) AS n, {r6('count(*) / cast(sum(count(*)) OVER () AS double) * 100')} AS pct FROM r_order_items GROUP BY promo_id""",
)
def _(cat):
    return op.value_counts(cat.order_items, "promo_id")


@query(
    "crosstab",
    f"""SELECT age_group, acquisition_channel, count(*) AS n, cast(sum(count(*)) OVER (PARTITION BY age_group) AS bigint) AS row_total,
               {r6('count(*) / cast(sum(count(*)) OVER (PARTITION BY age_group) AS double) * 100')} AS row_pct
        FROM r_customers WHERE age_group IS NOT NULL GROUP BY age_group, acquisition_channel""",
)
def _(cat):
    return op.crosstab(cat.customers, "age_group", "acquisition_channel")


@query(
    "parse_dates",
    """SELECT year(d) AS year, count(*) AS orders FROM (
         SELECT cast(try_strptime(CASE WHEN order_id % 7 = 0 THEN strftime(order_date, '%d/%m/%Y') ELSE strftime(order_date, '%Y-%m-%d') END, '%Y-%m-%d') AS date) AS d FROM r_orders) x GROUP BY 1""",
)
def _(cat):
    from tallyshop.sources.tables import parse_date_strict

    text = F.when(F.col("order_id") % 7 == 0, F.date_format("order_date", "dd/MM/yyyy")).otherwise(F.date_format("order_date", "yyyy-MM-dd"))
    parsed = cat.orders.select(parse_date_strict(text).alias("d"))
    return parsed.groupBy(F.year("d").alias("year")).agg(F.count("*").alias("orders"))


@query(
    "domain_listing",
    _union(
        f"""SELECT '{c}' AS "column", cast({c} AS string) AS value, cast(count(*) OVER () AS bigint) AS distinct_values FROM (SELECT DISTINCT {c} FROM r_inventory) x"""
        for c in ("category", "segment", "year")
    ),
)
def _(cat):
    return op.domain_listing(cat.inventory, ["category", "segment", "year"])


@query(
    "orphan_keys",
    f"""SELECT (SELECT count(DISTINCT order_id) FROM r_order_items WHERE order_id NOT IN (SELECT order_id FROM r_shipments)) AS orphan_keys,
               (SELECT count(*) FROM r_order_items WHERE order_id NOT IN (SELECT order_id FROM r_shipments)) AS orphan_rows,
               (SELECT count(DISTINCT order_id) FROM r_shipments WHERE order_id NOT IN (SELECT order_id FROM r_order_items)) AS unused_keys,
               {big('(SELECT count(DISTINCT order_id) FROM r_shipments WHERE order_id IN (SELECT order_id FROM r_order_items))')} AS matched_keys""",
)
def _(cat):
    return op.orphan_keys(cat.order_items, cat.shipments, "order_id")


@query(
    "rule_check",
    _union(
        f"""SELECT '{t}' AS "table", '{name}' AS rule, count(*) FILTER ({text}) AS violations FROM r_{t}"""
        for t, rules in op.RULES.items()
        for name, text in rules.items()
    ),
)
def _(cat):
    return op.check_all_rules(cat.kept("orders", "order_items"))


@query(
    "rule_violations",
    """SELECT snapshot_date, product_id, units_sold, units_received FROM r_inventory WHERE units_sold > units_received""",
)
def _(cat):
    bad = op.rule_violations(cat.inventory, op.RULES["inventory"]["sold_above_received"])
    return bad.select("snapshot_date", "product_id", "units_sold", "units_received")


@query(
    "status_rule_check",
    """SELECT s.order_id, ship_date, order_status FROM r_shipments s JOIN r_orders o ON o.order_id = s.order_id
       WHERE order_status NOT IN ('shipped', 'delivered', 'returned')""",
)
def _(cat):
    return op.status_rule_check(cat.shipments, cat.orders)


@query(
    "payment_method_mismatch",
    """SELECT o.order_id, o.payment_method, p.payment_method AS payment_method_paid FROM r_orders o LEFT JOIN r_payments p ON p.order_id = o.order_id
       WHERE o.payment_method IS NULL OR p.payment_method IS NULL OR o.payment_method <> p.payment_method""",
)
def _(cat):
    return op.payment_method_mismatch(cat.orders, cat.payments)


@query(
    "order_payment_reconcile",
    f"""SELECT i.order_id, {money('total_price')} AS total_price, {money('payment_value')} AS payment_value, {r6('abs(cast(total_price - payment_value AS double))')} AS distance
        FROM (SELECT order_id, sum(cast(quantity * unit_price AS decimal(18,4)) - discount_amount) AS total_price FROM r_order_items GROUP BY order_id) i
        LEFT JOIN r_payments p ON p.order_id = i.order_id WHERE abs(cast(total_price - payment_value AS double)) > 1e-8""",
)
def _(cat):
    return shown(op.order_payment_reconcile(cat.order_items, cat.payments))


_SPAN = "(SELECT min(Date) AS lo, max(Date) AS hi FROM r_sales)"


@query(
    "missing_days",
    f"""SELECT cast(d AS date) AS date FROM (SELECT unnest(generate_series(lo, hi, interval 1 day)) AS d FROM {_SPAN} s) g
        WHERE cast(d AS date) NOT IN (SELECT Date FROM r_sales)""",
)
def _(cat):
    return op.missing_days(cat.sales, "Date")


@query(
    "day_coverage",
    """SELECT date_diff('day', min(Date), max(Date)) + 1 AS expected_days, count(DISTINCT Date) AS seen_days,
              date_diff('day', min(Date), max(Date)) + 1 - count(DISTINCT Date) AS missing_days FROM r_sales""",
)
def _(cat):
    return op.day_coverage(cat.sales, "Date")


@query(
    "date_spine",
    f"SELECT cast(unnest(generate_series(lo, hi, interval 1 day)) AS date) AS date FROM {_SPAN} s",
)
def _(cat):
    from tallyshop.functions.spine import spine_of

    return spine_of(cat.sales, "Date")


@query(
    "align_to_calendar",
    f"""SELECT g.date AS date, {money('Revenue')} AS revenue FROM (SELECT cast(unnest(generate_series(lo, hi, interval 1 day)) AS date) AS date FROM {_SPAN} s) g
        LEFT JOIN r_sales s ON s.Date = g.date""",
)
def _(cat):
    from tallyshop.functions.spine import align_to_calendar

    sales = cat.sales.select(F.col("Date").alias("date"), F.col("Revenue").alias("revenue"))
    return shown(align_to_calendar(sales, "date"))


@query(
    "explode_interval",
    """SELECT promo_id, cast(unnest(generate_series(start_date, end_date, interval 1 day)) AS date) AS date FROM r_promotions
       WHERE promo_id IN (SELECT promo_id FROM r_order_items)""",
)
def _(cat):
    from tallyshop.functions.spine import explode_interval

    used = cat.promotions.join(cat.order_items.select("promo_id").distinct(), "promo_id", "left_semi")
    return explode_interval(used, "start_date", "end_date").select("promo_id", "date")


@query(
    "derived_column_check",
    """SELECT count(*) AS rows, count(*) FILTER (year <> year(snapshot_date)) AS year_mismatches, count(*) FILTER (month <> month(snapshot_date)) AS month_mismatches FROM r_inventory""",
)
def _(cat):
    return op.derived_column_check(cat.inventory)


@query(
    "recompute_check",
    f"""SELECT rows, matches, {r6('matches / cast(rows AS double) * 100')} AS match_pct FROM (
          SELECT count(*) AS rows, count(*) FILTER (abs(coalesce(stock_on_hand / nullif(units_sold / cast(30 AS double), 0), 0) - days_of_supply) <= 0.1::double + 1e-5 * abs(days_of_supply)) AS matches
          FROM r_inventory) x""",
)
def _(cat):
    return op.recompute_check(cat.inventory)


@query(
    "all_month_end",
    "SELECT cast(bool_and(snapshot_date = last_day(snapshot_date)) AS int) AS all_month_end, count(DISTINCT date_trunc('month', snapshot_date)) AS months FROM r_inventory",
)
def _(cat):
    return op.all_month_end(cat.inventory)


@query(
    "functional_dependency",
    "SELECT product_name, count(DISTINCT category) AS \"values\" FROM r_products GROUP BY product_name HAVING count(DISTINCT category) > 1",
)
def _(cat):
    return op.functional_dependency(cat.products, "product_name", "category")


@query(
    "duplicate_name_groups",
    "SELECT product_name, count(*) AS products, min(product_id) AS first_id, max(product_id) AS last_id, "
    + ", ".join(f"count(DISTINCT {a}) AS {a}_values" for a in op.VARIANT_ATTRIBUTES)
    + " FROM r_products GROUP BY product_name HAVING count(*) > 1",
)
def _(cat):
    return op.duplicate_name_groups(cat.products)


@query(
    "duplicate_name_ids",
    "SELECT product_name, product_id, products FROM r_products JOIN (SELECT product_name, count(*) AS products FROM r_products GROUP BY 1 HAVING count(*) > 1) d USING (product_name)",
)
def _(cat):
    return op.duplicate_name_ids(cat.products)


@query(
    "drop_unreferenced_duplicates",
    """SELECT product_id, product_name FROM r_products p WHERE NOT (
         product_id NOT IN (SELECT product_id FROM r_order_items UNION SELECT product_id FROM r_returns UNION SELECT product_id FROM r_inventory UNION SELECT product_id FROM r_reviews)
         AND product_name IN (SELECT product_name FROM r_products GROUP BY product_name HAVING count(*) > 1))""",
)
def _(cat):
    kept = op.drop_unreferenced_duplicates(cat.products, cat.order_items, cat.returns, cat.inventory, cat.reviews)
    return kept.select("product_id", "product_name")


@query(
    "referenced_products",
    "SELECT product_id FROM r_order_items UNION SELECT product_id FROM r_returns UNION SELECT product_id FROM r_inventory UNION SELECT product_id FROM r_reviews",
)
def _(cat):
    return op.referenced_products(cat.order_items, cat.returns, cat.inventory, cat.reviews)


@query(
    "price_anomaly",
    f"""SELECT product_id, product_name, {money('price')} AS price, {r6('m')} AS median_price FROM r_products
        JOIN (SELECT product_name, quantile_cont(cast(price AS double), 0.5) AS m FROM r_products GROUP BY 1) x USING (product_name)
        WHERE cast(price AS double) < 0.95::double * m OR cast(price AS double) > 1.05::double * m""",
)
def _(cat):
    # prices here lie within a narrow band, so the factors are narrower than the defaults
    return op.price_anomaly(cat.products, 0.95, 1.05)


def _iqr(column: str, table: str) -> str:
    v = f"cast({column} AS double)"
    return f"""SELECT '{column}' AS "column", {r6('q1')} AS q1, {r6('q3')} AS q3, {r6('q1 - 1.5 * (q3 - q1)')} AS lower, {r6('q3 + 1.5 * (q3 - q1)')} AS upper,
                      (SELECT count(*) FROM {table} WHERE {v} < q1 - 1.5 * (q3 - q1)) AS below, (SELECT count(*) FROM {table} WHERE {v} > q3 + 1.5 * (q3 - q1)) AS above
               FROM (SELECT quantile_cont({v}, 0.25) AS q1, quantile_cont({v}, 0.75) AS q3 FROM {table}) e"""


@query("iqr_outliers", _union(_iqr(c, "r_inventory") for c in ("sell_through_rate", "days_of_supply")))
def _(cat):
    return shown(op.iqr_outliers(cat.inventory, ["sell_through_rate", "days_of_supply"]))


@query("iqr_outliers_sales", _union(_iqr(c, "r_sales") for c in ("Revenue", "COGS")))
def _(cat):
    return shown(op.iqr_outliers(cat.sales, ["Revenue", "COGS"]))


@query("iqr_outliers_payments", _iqr("payment_value", "r_payments"))
def _(cat):
    return shown(op.iqr_outliers(cat.payments, ["payment_value"]))


@query(
    "upper_outliers_by_month",
    """SELECT year, month, count(*) AS outlier_count FROM r_inventory, (SELECT quantile_cont(days_of_supply, 0.25) AS q1, quantile_cont(days_of_supply, 0.75) AS q3 FROM r_inventory) e
       WHERE days_of_supply > q3 + 1.5 * (q3 - q1) GROUP BY year, month""",
)
def _(cat):
    return op.upper_outliers_by_month(cat.inventory, "days_of_supply")


_FALLS = """(SELECT product_id, count(*) FILTER (stock_on_hand < before) AS falls FROM (
    SELECT product_id, stock_on_hand, lag(stock_on_hand) OVER (PARTITION BY product_id ORDER BY snapshot_date) AS before FROM r_inventory) s GROUP BY product_id)"""


@query("monotonic_stock", f"SELECT product_id, falls FROM {_FALLS} x WHERE falls > 0")
def _(cat):
    return op.monotonic_stock(cat.inventory)


@query("monotonic_summary", f"SELECT cast(count(*) = 0 AS int) AS all_increasing, count(*) AS violating_products FROM {_FALLS} x WHERE falls > 0")
def _(cat):
    return op.monotonic_summary(cat.inventory)


@query(
    "fill_default",
    "SELECT coalesce(applicable_category, 'all') AS applicable_category, count(*) AS lines FROM r_order_items JOIN r_promotions USING (promo_id) GROUP BY 1",
)
def _(cat):
    lines = cat.order_items.join(op.fill_default(cat.promotions, "applicable_category", "all"), "promo_id")
    return lines.groupBy("applicable_category").agg(F.count("*").alias("lines"))


def _long(mart: str) -> str:
    """Oracle text: every column of a daily mart as (date, f, v) rows."""
    return f"(SELECT * FROM (UNPIVOT (SELECT date, CAST(COLUMNS(* EXCLUDE (date)) AS DOUBLE) FROM {mart}) ON COLUMNS(* EXCLUDE (date)) INTO NAME f VALUE v) u)"


_GROUP_QUALITY = _union(
    f"""SELECT '{g}' AS feature_group, cast(count(DISTINCT f) AS int) AS columns, {r6('count(*) FILTER (v = 0) / cast(count(*) AS double) * 100')} AS zero_pct, {r6('0')} AS null_pct FROM {_long(t)} x"""
    for g, (t, _) in SOURCES.items()
)


@query("feature_group_quality", _GROUP_QUALITY)
def _(cat):
    return op.feature_group_quality(daily_table(cat), source_columns(cat))


@query(
    "feature_group_activity",
    "SELECT * FROM " + " JOIN ".join(
        f"""(SELECT last_day(date) AS month_end, {r6('count(*) FILTER (a > 0) / cast(count(*) AS double) * 100')} AS {g} FROM (SELECT date, max(abs(v)) AS a FROM {_long(t)} x GROUP BY date) d GROUP BY 1) {g}_x"""
        + (" USING (month_end)" if i else "")
        for i, (g, (t, _)) in enumerate(SOURCES.items())
    ),
)
def _(cat):
    return op.feature_group_activity(daily_table(cat), source_columns(cat))


@query(
    "gross_loss_days",
    _union(
        f"""SELECT '{g}' AS grain, {e} AS bucket, count(*) AS days, count(*) FILTER (Revenue < COGS) AS loss_days, {r6('count(*) FILTER (Revenue < COGS) / cast(count(*) AS double) * 100')} AS loss_pct
            FROM r_sales GROUP BY {e if g != 'all' else 'ALL'}"""
        for g, e in (("all", "0"), ("year", "year(Date)"), ("month", "month(Date)"), ("weekday", "isodow(Date) - 1"))
    ),
)
def _(cat):
    return op.gross_loss_days(cat.sales)


@query(
    "histogram",
    """SELECT cast(least(floor((v - lo) / ((hi - lo) / 50.0::double)), 49) AS bigint) AS bin, count(*) AS n
       FROM (SELECT cast(payment_value AS double) AS v FROM r_payments) x, (SELECT min(cast(payment_value AS double)) AS lo, max(cast(payment_value AS double)) AS hi FROM r_payments) e GROUP BY 1""",
)
def _(cat):
    return op.histogram(cat.payments, "payment_value", 50)


@query(
    "box_summary",
    f"""SELECT category, size, {r6('min(price)')} AS min, {r6('max(price)')} AS max, count(price) AS n, {r6('quantile_cont(cast(price AS double), 0.25)')} AS q1,
               {r6('quantile_cont(cast(price AS double), 0.5)')} AS median, {r6('quantile_cont(cast(price AS double), 0.75)')} AS q3 FROM r_products GROUP BY category, size""",
)
def _(cat):
    return shown(op.box_summary(cat.products, "price", "category", "size"))


@query("feature_groups_of_daily_table", _GROUP_QUALITY)
def _(cat):
    daily = daily_table(cat)
    return op.feature_group_quality(daily, source_columns(cat))
