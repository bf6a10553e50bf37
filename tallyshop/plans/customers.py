"""Queries for the customer analyses."""

from tallyshop.operators import customers as op
from tallyshop.operators.marts import customer_base
from tallyshop.plans.registry import ORACLE_MARTS, big, money, query, r6
from tallyshop.session import materialise

CALENDAR_MONTHS = 84  # January 1995 to December 2001, the calendar of the orders
_EDGES = ", ".join(f"quantile_cont({{v}}, {q}) AS {{n}}{i}" for i, q in enumerate((0.2, 0.4, 0.6, 0.8)))
ORACLE_MARTS["m_rfm"] = f"""
SELECT *, CASE WHEN r_score >= 4 AND f_score >= 4 THEN 'VIP' WHEN r_score < 4 AND f_score >= 4 THEN 'Loyal'
               WHEN r_score >= 4 AND f_score < 4 AND m_score >= 4 THEN 'New Potential' WHEN r_score <= 2 THEN 'Churn Risk'
               WHEN m_score >= 4 THEN 'Big Spender' ELSE 'Regular' END AS segment
FROM (SELECT v.*, CASE WHEN r <= r0 THEN 5 WHEN r <= r1 THEN 4 WHEN r <= r2 THEN 3 WHEN r <= r3 THEN 2 ELSE 1 END AS r_score,
             CASE WHEN f_rank <= f0 THEN 1 WHEN f_rank <= f1 THEN 2 WHEN f_rank <= f2 THEN 3 WHEN f_rank <= f3 THEN 4 ELSE 5 END AS f_score,
             CASE WHEN cast(m AS double) <= m0 THEN 1 WHEN cast(m AS double) <= m1 THEN 2 WHEN cast(m AS double) <= m2 THEN 3
                  WHEN cast(m AS double) <= m3 THEN 4 ELSE 5 END AS m_score
      FROM m_rfm_base v, (SELECT {_EDGES.format(v='cast(r AS double)', n='r')}, {_EDGES.format(v='cast(f_rank AS double)', n='f')},
                                 {_EDGES.format(v='cast(m AS double)', n='m')} FROM m_rfm_base) e) s
"""
ORACLE_MARTS["m_rfm_base"] = """
SELECT customer_id, recency AS r, total_orders AS f, total_revenue AS m,
       row_number() OVER (ORDER BY total_orders, customer_id) AS f_rank FROM m_customer
"""
ORACLE_MARTS["m_last_delivery"] = """
SELECT customer_id, delivery_days FROM (
  SELECT customer_id, delivery_days, row_number() OVER (PARTITION BY customer_id ORDER BY order_date DESC, order_id DESC) AS rn FROM m_item) x
WHERE rn = 1 AND delivery_days IS NOT NULL
"""
ORACLE_MARTS["m_cohort"] = """
SELECT i.customer_id, i.order_id, i.net_value, c.cohort_month,
       (year(i.order_date) * 12 + month(i.order_date)) - (year(c.cohort_month) * 12 + month(c.cohort_month)) AS cohort_index
FROM m_item i JOIN (SELECT customer_id, cast(date_trunc('month', min(order_date)) AS date) AS cohort_month FROM m_item GROUP BY customer_id) c
  ON c.customer_id = i.customer_id
"""


@query(
    "rfm_scores",
    f"""SELECT customer_id, r AS "R", f AS "F", {money('m')} AS "M", r_score AS "R_score", f_score AS "F_score", m_score AS "M_score" FROM m_rfm""",
)
def _(cat):
    from tallyshop.functions.columns import money as money_col
    from tallyshop.operators.marts import customer_value

    return op.rfm_scores(customer_value(cat)).withColumn("M", money_col("M"))


@query(
    "rfm_segments",
    """SELECT customer_id, r_score AS "R_score", f_score AS "F_score", m_score AS "M_score", segment FROM m_rfm""",
)
def _(cat):
    return op.segments(cat).select("customer_id", "R_score", "F_score", "M_score", "segment")


@query(
    "segment_summary",
    f"""SELECT segment, count(*) AS customers, {money('sum(m)')} AS revenue, {money('sum(total_profit)')} AS profit, {r6('avg(aov)')} AS "avg_AOV",
               {r6('avg(total_orders)')} AS avg_orders, {r6('avg(avg_rating)')} AS avg_rating, {r6('avg(return_rate)')} AS return_rate,
               {r6('avg(r)')} AS avg_recency, {r6('avg(f)')} AS avg_frequency, {r6('cast(sum(m) AS double) / count(*)')} AS avg_monetary,
               {r6('cast(sum(m) AS double) / cast(sum(sum(m)) OVER () AS double) * 100')} AS revenue_pct,
               {r6('count(*) / cast(sum(count(*)) OVER () AS double) * 100')} AS customer_pct
        FROM m_rfm JOIN m_customer USING (customer_id) GROUP BY segment""",
)
def _(cat):
    base = materialise(customer_base(cat))
    return op.segment_summary(op.rfm_segments(op.value_of(base)), base)


@query(
    "pareto_customers",
    f"""SELECT customer_id, segment, rn AS position, {money('m')} AS revenue, {money('cum')} AS cum_revenue,
               {r6('cast(cum AS double) / cast(total AS double)')} AS cum_pct, {r6('rn / cast(n AS double)')} AS customer_pct,
               CASE WHEN segment = 'VIP' THEN 1 ELSE 0 END AS is_vip, {money('seg')} AS segment_cum_revenue
        FROM (SELECT *, row_number() OVER w AS rn, sum(m) OVER w AS cum, sum(m) OVER () AS total, count(*) OVER () AS n,
                     sum(m) OVER (PARTITION BY segment ORDER BY m DESC, customer_id ROWS UNBOUNDED PRECEDING) AS seg
              FROM m_rfm WINDOW w AS (ORDER BY m DESC, customer_id ROWS UNBOUNDED PRECEDING)) x""",
)
def _(cat):
    return op.pareto_customers(op.segments(cat))


@query(
    "rfm_heatmap",
    'SELECT r_score AS "R_score", '
    + ", ".join(
        f"""{r6(f'cast(sum(m) FILTER (f_score = {i}) AS double) / count(*) FILTER (f_score = {i})')} AS "F{i}" """
        for i in range(1, 6)
    )
    + " FROM m_rfm GROUP BY r_score",
)
def _(cat):
    return op.rfm_heatmap(op.segments(cat))


@query(
    "cohort_retention",
    f"""SELECT cohort_month, cohort_index, n AS customers,
               {r6('n / cast(first_value(n) OVER (PARTITION BY cohort_month ORDER BY cohort_index) AS double)')} AS retention
        FROM (SELECT cohort_month, cohort_index, count(DISTINCT customer_id) AS n FROM m_cohort GROUP BY ALL) x""",
)
def _(cat):
    return op.cohort_retention(op.orders_with_lines(cat))


@query(
    "cohort_retention_wide",
    "SELECT cohort_month, "
    + ", ".join(
        f"{r6(f'max(n) FILTER (cohort_index = {i}) / cast(max(n) FILTER (cohort_index = 0) AS double)')} AS m{i}"
        for i in range(CALENDAR_MONTHS)
    )
    + " FROM (SELECT cohort_month, cohort_index, count(DISTINCT customer_id) AS n FROM m_cohort GROUP BY ALL) x GROUP BY cohort_month",
)
def _(cat):
    return op.cohort_retention_wide(op.orders_with_lines(cat), CALENDAR_MONTHS)


@query(
    "cohort_clv",
    f"""SELECT x.cohort_month, cohort_index, s.n AS cohort_size, {money('v')} AS revenue, {r6('cast(v AS double) / s.n')} AS clv,
               {r6('cast(sum(v) OVER (PARTITION BY x.cohort_month ORDER BY cohort_index ROWS UNBOUNDED PRECEDING) AS double) / s.n')} AS clv_cumulative,
               {r6('cast(v AS double) / cast(first_value(v) OVER (PARTITION BY x.cohort_month ORDER BY cohort_index) AS double)')} AS revenue_retention
        FROM (SELECT cohort_month, cohort_index, sum(net_value) AS v FROM m_cohort GROUP BY ALL) x
        JOIN (SELECT cohort_month, count(DISTINCT customer_id) AS n FROM m_cohort GROUP BY cohort_month) s ON s.cohort_month = x.cohort_month""",
)
def _(cat):
    return op.cohort_clv(op.orders_with_lines(cat))


@query(
    "churn_by_category",
    f"""SELECT category, {big('sum(quantity)')} AS total_items, {big('sum(return_qty)')} AS returned_items,
               {r6('cast(sum(return_qty) AS double) / sum(quantity)')} AS return_rate
        FROM m_item WHERE customer_id IN (SELECT customer_id FROM m_rfm WHERE segment = 'Churn Risk') GROUP BY category""",
)
def _(cat):
    return op.churn_by_category(cat, op.segments(cat))


@query(
    "churn_by_region",
    f"""SELECT region, count(DISTINCT order_id) AS total_orders, {big('sum(is_returned)')} AS returned_orders,
               {r6('sum(is_returned) / cast(count(DISTINCT order_id) AS double)')} AS order_return_rate
        FROM m_item WHERE customer_id IN (SELECT customer_id FROM m_rfm WHERE segment = 'Churn Risk') GROUP BY region""",
)
def _(cat):
    return op.churn_by_region(cat, op.segments(cat))


@query(
    "churn_reasons",
    f"""SELECT return_reason, count(*) AS events, {r6('count(*) / cast(sum(count(*)) OVER () AS double) * 100')} AS pct FROM r_returns
        WHERE order_id IN (SELECT order_id FROM m_item WHERE customer_id IN (SELECT customer_id FROM m_rfm WHERE segment = 'Churn Risk'))
        GROUP BY return_reason""",
)
def _(cat):
    return op.churn_reasons(cat, op.segments(cat))


@query(
    "delivery_churn",
    f"""SELECT a.delivery_days, avg_rating, total_lines, churn_rate, customer_count
        FROM (SELECT delivery_days, {r6('avg(rating)')} AS avg_rating, count(order_id) AS total_lines FROM m_item
              WHERE delivery_days IS NOT NULL GROUP BY delivery_days) a
        JOIN (SELECT delivery_days, {r6("sum(CASE WHEN segment = 'Churn Risk' THEN 1 ELSE 0 END) / cast(count(*) AS double)")} AS churn_rate,
                     count(*) AS customer_count FROM m_last_delivery LEFT JOIN m_rfm USING (customer_id) GROUP BY delivery_days) b
          ON a.delivery_days = b.delivery_days WHERE total_lines > 100""",
)
def _(cat):
    return op.delivery_churn(cat, op.segments(cat))


@query(
    "delivery_segment_mix",
    "SELECT delivery_days, count(*) AS total_customers, "
    + ", ".join(
        f"count(*) FILTER (segment = '{s}') AS {c}_count, {r6(f'''count(*) FILTER (segment = '{s}') / cast(count(*) AS double) * 100''')} AS {c}_pct"
        for s, c in op.SEGMENT_COLUMNS.items()
    )
    + " FROM m_last_delivery LEFT JOIN m_rfm USING (customer_id) GROUP BY delivery_days",
)
def _(cat):
    return op.delivery_segment_mix(cat, op.segments(cat))


@query(
    "promo_usage_compare",
    f"""SELECT segment, count(*) AS customers, {r6('avg(promo_usage_rate)')} AS avg_promo_usage
        FROM m_customer JOIN m_rfm USING (customer_id) WHERE segment IN ('VIP', 'New Potential') GROUP BY segment""",
)
def _(cat):
    return op.promo_usage_compare(op.segments(cat), customer_base(cat))


@query(
    "promo_value_correlation",
    f"""SELECT n, {r6('r')} AS pearson_r, {r6('r * sqrt((n - 2) / (1 - r * r))')} AS t_statistic
        FROM (SELECT count(*) AS n, corr(cast(total_revenue AS double), promo_usage_rate) AS r FROM m_customer) x""",
)
def _(cat):
    return op.promo_value_correlation(customer_base(cat))


@query(
    "customer_chart_sample",
    f"SELECT customer_id, total_orders, {money('total_revenue')} AS total_revenue FROM m_customer WHERE (customer_id * 48271) % 65521 < 13104",
)
def _(cat):
    from tallyshop.functions.columns import money as money_col

    sample = op.customer_chart_sample(customer_base(cat))
    return sample.select("customer_id", "total_orders", money_col("total_revenue").alias("total_revenue"))
