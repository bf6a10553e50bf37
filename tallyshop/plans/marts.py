"""Queries for the marts, and the SQL marts the oracles share."""

from pyspark.sql import functions as F

from tallyshop.functions.columns import money as money_col
from tallyshop.functions.columns import r6 as r6_col
from tallyshop.operators import marts as op
from tallyshop.plans.registry import ORACLE_MARTS, big, money, query, r6

ORACLE_MARTS["m_item"] = """
SELECT i.order_id, i.product_id, i.quantity, i.promo_id, i.promo_id_2, i.discount_amount,
       o.customer_id, o.order_date, o.device_type, o.order_source, o.zip,
       c.gender, c.age_group, c.acquisition_channel, g.region, p.category, p.segment, p.cogs,
       p.product_name, p.size,
       coalesce(rt.return_qty, 0) AS return_qty, coalesce(rt.refund_amount, 0) AS refund_amount,
       CASE WHEN rt.return_qty > 0 THEN 1 ELSE 0 END AS is_returned,
       rv.rating, rv.review_count, s.ship_date, s.delivery_date, s.shipping_fee,
       date_diff('day', s.ship_date, s.delivery_date) AS delivery_days, y.payment_value,
       cast(i.quantity * i.unit_price AS decimal(18,4)) AS gross_value,
       cast(i.quantity * i.unit_price AS decimal(18,4)) - i.discount_amount AS net_value,
       cast(i.quantity * p.cogs AS decimal(18,4)) AS cogs_total,
       cast(i.quantity * i.unit_price AS decimal(18,4)) - i.discount_amount - cast(i.quantity * p.cogs AS decimal(18,4)) AS profit,
       CASE WHEN i.promo_id IS NOT NULL OR i.promo_id_2 IS NOT NULL THEN 1 ELSE 0 END AS used_promo,
       p1.promo_name AS p1_promo_name, p2.promo_name AS p2_promo_name,
       CASE WHEN p1.stackable_flag = 1 OR p2.stackable_flag = 1 THEN 1 ELSE 0 END AS is_stackable
FROM r_order_items i
LEFT JOIN r_orders o ON o.order_id = i.order_id
LEFT JOIN r_customers c ON c.customer_id = o.customer_id
LEFT JOIN r_geography g ON g.zip = o.zip
LEFT JOIN r_products p ON p.product_id = i.product_id
LEFT JOIN (SELECT order_id, product_id, sum(return_quantity) AS return_qty, sum(refund_amount) AS refund_amount
           FROM r_returns GROUP BY order_id, product_id) rt ON rt.order_id = i.order_id AND rt.product_id = i.product_id
LEFT JOIN (SELECT order_id, product_id, avg(rating) AS rating, count(rating) AS review_count
           FROM r_reviews GROUP BY order_id, product_id) rv ON rv.order_id = i.order_id AND rv.product_id = i.product_id
LEFT JOIN r_shipments s ON s.order_id = i.order_id
LEFT JOIN r_payments y ON y.order_id = i.order_id
LEFT JOIN r_promotions p1 ON p1.promo_id = i.promo_id
LEFT JOIN r_promotions p2 ON p2.promo_id = i.promo_id_2
"""

ORACLE_MARTS["m_customer"] = """
SELECT b.*, date_diff('day', b.last_order, (SELECT max(order_date) FROM m_item)) AS recency,
       date_diff('day', b.first_order, b.last_order) AS tenure,
       cast(total_revenue AS double) / total_orders AS aov,
       cast(total_return_qty AS double) / total_items AS return_rate,
       cast(total_discount AS double) / cast(CASE WHEN total_revenue + total_discount = 0 THEN 1 ELSE total_revenue + total_discount END AS double) AS discount_rate,
       cast(promo_lines AS double) / total_lines AS promo_usage_rate
FROM (SELECT customer_id, count(DISTINCT order_id) AS total_orders, sum(quantity) AS total_items,
             sum(net_value) AS total_revenue, sum(profit) AS total_profit, sum(discount_amount) AS total_discount,
             avg(delivery_days) AS avg_delivery_days, avg(rating) AS avg_rating,
             sum(return_qty) AS total_return_qty, sum(refund_amount) AS total_refund,
             sum(used_promo) AS promo_lines, count(product_id) AS total_lines,
             count(DISTINCT category) AS category_diversity,
             min(order_date) AS first_order, max(order_date) AS last_order
      FROM m_item GROUP BY customer_id) b
"""

ORACLE_MARTS["m_channel"] = """
SELECT customer_id, min(CASE WHEN kind = 'd' THEN v END) AS dominant_device, min(CASE WHEN kind = 's' THEN v END) AS dominant_source
FROM (SELECT customer_id, kind, v, row_number() OVER (PARTITION BY customer_id, kind ORDER BY n DESC, v) AS rn
      FROM (SELECT customer_id, 'd' AS kind, device_type AS v, count(*) AS n FROM m_item GROUP BY ALL
            UNION ALL SELECT customer_id, 's', order_source, count(*) FROM m_item GROUP BY ALL) a) b
WHERE rn = 1 GROUP BY customer_id
"""


_ITEM_FACT = (
    f"""SELECT order_id, product_id, quantity, customer_id, order_date, device_type, order_source, gender, age_group,
               acquisition_channel, region, category, segment, {big('return_qty')} AS return_qty, is_returned, review_count, ship_date,
               delivery_date, delivery_days, p1_promo_name, p2_promo_name, year(order_date) AS order_year,
               month(order_date) AS order_month, isodow(order_date) - 1 AS order_weekday,
               {money('gross_value')} AS gross_value, {money('net_value')} AS net_value, {money('cogs_total')} AS cogs_total,
               {money('profit')} AS profit, {money('refund_amount')} AS refund_amount,
               {money('net_value - refund_amount')} AS realized_revenue, {money('profit - refund_amount')} AS realized_profit,
               {money('coalesce(payment_value, 0)')} AS payment_value_filled, {money('discount_amount')} AS discount_amount,
               {money('shipping_fee')} AS shipping_fee, {r6('rating')} AS rating, used_promo, is_stackable FROM m_item"""
)


@query("item_fact", _ITEM_FACT)
def _(cat):
    return op.item_fact_output(op.item_fact(cat))


@query("item_fact_salted", _ITEM_FACT)
def _(cat):
    return op.item_fact_output(op.item_fact(cat, salted=True))


@query(
    "item_fact_fanout",
    """SELECT a.n AS rows_before, b.n AS rows_after, b.n - a.n AS fanout
       FROM (SELECT count(*) AS n FROM r_order_items) a, (SELECT count(*) AS n FROM m_item) b""",
)
def _(cat):
    return op.fanout_check(cat.order_items, op.item_fact(cat))


@query(
    "raw_returned_lines",
    f"""SELECT count(*) AS lines, {big('sum(quantity)')} AS quantity, {big('sum(coalesce(return_quantity, 0))')} AS returned
        FROM r_order_items i LEFT JOIN r_returns r ON r.order_id = i.order_id AND r.product_id = i.product_id""",
)
def _(cat):
    raw = op.raw_returned_lines(cat.order_items, cat.returns)
    return raw.agg(
        F.count("*").alias("lines"), F.sum("quantity").alias("quantity"),
        F.sum(F.coalesce("return_quantity", F.lit(0))).alias("returned"),
    )


@query(
    "order_mart",
    f"""SELECT order_id, min(customer_id) AS customer_id, min(order_date) AS order_date, {big('sum(quantity)')} AS total_items,
               {money('sum(net_value)')} AS total_revenue, {money('sum(profit)')} AS total_profit, max(is_returned) AS return_flag,
               {r6('avg(rating)')} AS avg_rating, {money('min(payment_value)')} AS payment_value,
               {r6('avg(delivery_days)')} AS delivery_days, min(device_type) AS device_type, min(order_source) AS order_source
        FROM m_item GROUP BY order_id""",
)
def _(cat):
    mart = op.order_mart(cat)
    return mart.withColumns(
        {
            **{c: money_col(c) for c in ("total_revenue", "total_profit", "payment_value")},
            **{c: r6_col(c) for c in ("avg_rating", "delivery_days")},
        }
    )


_RATES = ("AOV", "return_rate", "discount_rate", "promo_usage_rate", "freq_per_month", "avg_delivery_days", "avg_rating")
_AMOUNTS = ("total_revenue", "total_profit", "total_discount", "total_refund", "CLV")


@query(
    "customer_360",
    f"""SELECT m.customer_id, total_orders, {big('total_items')} AS total_items, {money('total_revenue')} AS total_revenue,
               {money('total_profit')} AS total_profit, {money('total_discount')} AS total_discount,
               {r6('avg_delivery_days')} AS avg_delivery_days, {r6('avg_rating')} AS avg_rating,
               {big('total_return_qty')} AS total_return_qty, {money('total_refund')} AS total_refund, {big('promo_lines')} AS promo_lines,
               total_lines, category_diversity, first_order, last_order, recency, tenure, {r6('aov')} AS "AOV",
               {r6('return_rate')} AS return_rate, {r6('discount_rate')} AS discount_rate, {r6('promo_usage_rate')} AS promo_usage_rate,
               {money('total_profit')} AS "CLV", {r6('total_orders / (greatest(tenure, 1) / cast(30 AS double))')} AS freq_per_month,
               CASE WHEN total_orders > 1 THEN 1 ELSE 0 END AS repeat_flag, CASE WHEN recency > 90 THEN 1 ELSE 0 END AS is_churn_risk,
               CASE WHEN cast(total_profit AS double) >= (SELECT quantile_cont(cast(total_profit AS double), 0.8) FROM m_customer) THEN 1 ELSE 0 END AS is_high_value,
               CASE WHEN discount_rate > 0.3 THEN 1 ELSE 0 END AS is_bargain, c.acquisition_channel, dominant_device, dominant_source
        FROM m_customer m LEFT JOIN r_customers c ON c.customer_id = m.customer_id LEFT JOIN m_channel h ON h.customer_id = m.customer_id""",
)
def _(cat):
    mart = op.customer_360(cat)
    return mart.withColumns({**{c: r6_col(c) for c in _RATES}, **{c: money_col(c) for c in _AMOUNTS}})


@query(
    "customer_rules",
    """SELECT count(*) AS customers, cast(count(*) AS bigint) AS rules_hold FROM m_customer WHERE total_orders >= 1 AND recency >= 0""",
)
def _(cat):
    base = op.customer_base(cat)
    newest = base.agg(F.max("last_order").alias("d")).scalar()
    base = base.withColumn("recency", F.datediff(newest, F.col("last_order")))
    checked = op.assert_customer_rules(base)
    return checked.agg(F.count("*").alias("customers"), F.sum("rules_hold").alias("rules_hold"))


@query(
    "customer_kpis",
    f"""SELECT count(*) AS total_customers, {r6('cast(sum(total_profit) AS double) / count(*)')} AS avg_clv, {r6('avg(total_orders)')} AS avg_orders,
               {r6('sum(CASE WHEN total_orders > 1 THEN 1 ELSE 0 END) / cast(count(*) AS double) * 100')} AS repeat_rate_pct FROM m_customer""",
)
def _(cat):
    return op.customer_kpis(cat)


def _long(table: str, columns: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS dimension, cast({expr} AS string) AS value, count(*) AS n FROM {table} GROUP BY {expr}"
        for name, expr in columns.items()
    )


@query(
    "customer_distributions",
    _long(
        "(SELECT c.*, g.region FROM r_customers c LEFT JOIN r_geography g ON g.zip = c.zip) x",
        {"region": "region", "acquisition_channel": "acquisition_channel", "gender": "gender",
         "age_group": "age_group", "signup_year": "year(signup_date)"},
    ),
)
def _(cat):
    return op.customer_distributions(cat.customers, cat.geography)


_MEASURES = {"total_orders": ("cast(total_orders AS double)", 30), "AOV": ("aov", 30), "freq_per_month": ("total_orders / (greatest(tenure, 1) / 30.0::double)", 30),
             "category_diversity": ("cast(category_diversity AS double)", 20), "promo_usage_rate": ("promo_usage_rate", 20)}


@query(
    "customer_behaviour",
    " UNION ALL ".join(
        f"""SELECT '{m}' AS measure, cast(CASE WHEN hi > lo THEN least(floor((v - lo) / ((hi - lo) / {b}.0::double)), {b - 1}) ELSE 0 END AS bigint) AS bin, {r6('min(v)')} AS low, count(*) AS n
            FROM (SELECT {e} AS v FROM m_customer) x, (SELECT min({e}) AS lo, max({e}) AS hi FROM m_customer) y WHERE v IS NOT NULL GROUP BY 2"""
        for m, (e, b) in _MEASURES.items()
    )
    + " UNION ALL SELECT 'repeat_flag', cast(total_orders > 1 AS bigint), cast(cast(total_orders > 1 AS int) AS double), count(*) FROM m_customer GROUP BY total_orders > 1",
)
def _(cat):
    return op.customer_behaviour(op.customer_360(cat)).withColumn("low", r6_col("low"))


@query(
    "geography_distributions",
    _long("r_geography", {"region": "region", "city": "city", "district": "district"}),
)
def _(cat):
    return op.geography_distributions(cat.geography)


@query(
    "product_distributions",
    _long("r_products", {"category": "category", "segment": "segment", "size": "size", "color": "color"}),
)
def _(cat):
    return op.product_distributions(cat.products)


@query(
    "product_margins",
    f"""SELECT category, segment, count(*) AS products, {r6('cast(sum(price) AS double) / count(*)')} AS avg_price,
               {r6('cast(sum(cogs) AS double) / count(*)')} AS avg_cogs,
               {r6('avg(cast(price - cogs AS double) / cast(price AS double))')} AS avg_margin FROM r_products GROUP BY category, segment""",
)
def _(cat):
    return op.product_margin_distribution(cat.products)


def _lines_by(kind: str, expr: str) -> str:
    avg = r6("cast(sum(discount_value) AS double) / count(*)")
    return (
        f"SELECT '{kind}' AS dimension, {expr} AS value, count(*) AS promotions, {avg} AS avg_discount "
        f"FROM used GROUP BY {expr}"
    )


@query(
    "promotion_distributions",
    "WITH used AS (SELECT * FROM r_promotions WHERE promo_id IN (SELECT promo_id FROM r_order_items)) "
    + " UNION ALL ".join(
        [
            _lines_by("year", "cast(year(start_date) AS string)"),
            _lines_by("channel", "promo_channel"),
            _lines_by("type", "promo_type"),
            _lines_by("targeting", "CASE WHEN applicable_category IS NULL THEN 'All Category' ELSE 'Targeted' END"),
        ]
    ),
)
def _(cat):
    used = cat.promotions.join(cat.order_items.select("promo_id").distinct(), "promo_id", "left_semi")
    return op.promotion_distributions(used)
