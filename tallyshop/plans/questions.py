"""Queries for the ten short questions."""

from tallyshop.operators import questions as op
from tallyshop.plans.registry import money, query, r6


@query(
    "q01_median_gap",
    """SELECT cast(median(gap) AS double) AS median_gap_days FROM (
         SELECT date_diff('day', lag(order_date) OVER (PARTITION BY customer_id ORDER BY order_date, order_id), order_date) AS gap
         FROM r_orders) g WHERE gap IS NOT NULL""",
)
def _(cat):
    return op.median_order_gap(cat.orders)


@query(
    "q02_segment_margin",
    f"SELECT segment, {r6('avg(cast(price - cogs AS double) / cast(price AS double))')} AS avg_margin FROM r_products GROUP BY segment",
)
def _(cat):
    return op.segment_margin(cat.products)


@query(
    "q02_best_segment",
    f"""SELECT segment, {r6('avg(cast(price - cogs AS double) / cast(price AS double))')} AS avg_margin
        FROM r_products GROUP BY segment ORDER BY avg_margin DESC, segment LIMIT 1""",
)
def _(cat):
    return op.best_of(op.segment_margin(cat.products), "segment", "avg_margin")


@query(
    "q03_return_reasons",
    """SELECT return_reason, count(*) AS events FROM r_returns JOIN r_products USING (product_id)
       WHERE category = 'ECONOMY' GROUP BY return_reason""",
)
def _(cat):
    return op.return_reasons_of(cat.returns, cat.products, "ECONOMY")


@query(
    "q04_bounce_by_source",
    f"SELECT traffic_source, {r6('avg(bounce_rate)')} AS avg_bounce_rate FROM r_web_traffic GROUP BY traffic_source",
)
def _(cat):
    return op.bounce_by_source(cat.web_traffic)


@query(
    "q05_promo_line_share",
    f"SELECT {r6('count(promo_id) / cast(count(*) AS double) * 100')} AS promo_line_pct FROM r_order_items",
)
def _(cat):
    return op.promo_line_share(cat.order_items)


@query(
    "q06_orders_per_customer_by_age",
    f"""SELECT age_group, {r6('avg(n)')} AS avg_orders FROM (
          SELECT c.age_group, o.customer_id, count(*) AS n
          FROM r_orders o JOIN r_customers c ON c.customer_id = o.customer_id
          WHERE c.age_group IS NOT NULL GROUP BY c.age_group, o.customer_id) x GROUP BY age_group""",
)
def _(cat):
    return op.orders_per_customer_by_age(cat.orders, cat.customers)


@query(
    "q07_revenue_by_region",
    f"""SELECT region, {money('sum(cast(quantity * unit_price AS decimal(18,4)) - discount_amount)')} AS revenue
        FROM r_orders o LEFT JOIN r_geography g ON g.zip = o.zip
        LEFT JOIN r_order_items i ON i.order_id = o.order_id
        WHERE region IS NOT NULL GROUP BY region""",
)
def _(cat):
    return op.revenue_by_region(cat.orders, cat.order_items, cat.geography)


@query(
    "q08_cancelled_payment",
    """SELECT p.payment_method, count(*) AS orders FROM r_orders o JOIN r_payments p ON p.order_id = o.order_id
       WHERE o.order_status = 'cancelled' GROUP BY p.payment_method""",
)
def _(cat):
    return op.cancelled_payment_methods(cat.orders, cat.payments)


@query(
    "q09_return_rate_by_size",
    f"""SELECT size, returned, sold, {r6('returned / cast(sold AS double)')} AS return_rate
        FROM (SELECT size, count(*) AS returned FROM r_returns JOIN r_products USING (product_id) GROUP BY size) a
        FULL JOIN (SELECT size, count(*) AS sold FROM r_order_items JOIN r_products USING (product_id) GROUP BY size) b USING (size)""",
)
def _(cat):
    return op.return_rate_by_size(cat.returns, cat.order_items, cat.products)


@query(
    "q10_payment_by_installments",
    f"""SELECT installments, {r6('cast(sum(payment_value) AS double) / count(payment_value)')} AS avg_payment
        FROM r_payments GROUP BY installments""",
)
def _(cat):
    return op.payment_by_installments(cat.payments)
