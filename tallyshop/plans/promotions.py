"""Queries for the promotion analyses."""

from tallyshop.functions.columns import money as money_col
from tallyshop.operators import promotions as op
from tallyshop.plans.registry import ORACLE_MARTS, big, money, query, r6

ORACLE_MARTS["m_op"] = """
SELECT o.order_id, o.customer_id, o.order_date, coalesce(i.has_promo, 0) AS has_promo, gross_revenue, total_discount,
       gross_revenue - total_discount AS net_revenue, cast(date_trunc('month', o.order_date) AS date) AS month, year(o.order_date) AS year
FROM r_orders o LEFT JOIN (
  SELECT order_id, sum(cast(quantity * unit_price AS decimal(18,4))) AS gross_revenue, sum(discount_amount) AS total_discount,
         max(CASE WHEN promo_id IS NOT NULL THEN 1 ELSE 0 END) AS has_promo FROM r_order_items GROUP BY order_id) i ON i.order_id = o.order_id
"""
ORACLE_MARTS["m_card"] = """
SELECT x.*, p.promo_name, p.promo_type, p.applicable_category, p.promo_channel, date_diff('day', p.start_date, p.end_date) AS duration_days,
       CASE WHEN roi >= 8 AND depth <= 10 THEN 'KEEP' WHEN roi >= 5 THEN 'REVIEW' ELSE 'STOP' END AS recommendation
FROM (SELECT promo_id, count(DISTINCT order_id) AS total_orders, sum(g) AS gross, sum(discount_amount) AS discount, sum(g - discount_amount) AS net,
             cast(sum(g - discount_amount) AS double) / cast(sum(discount_amount) AS double) AS roi,
             cast(sum(discount_amount) AS double) / cast(sum(g) AS double) * 100 AS depth
      FROM (SELECT *, cast(quantity * unit_price AS decimal(18,4)) AS g FROM r_order_items WHERE promo_id IS NOT NULL) l GROUP BY promo_id) x
LEFT JOIN r_promotions p ON p.promo_id = x.promo_id
"""
ORACLE_MARTS["m_churn"] = """
SELECT c.year, p.n AS prev_active, c.n AS curr_active, p.n - b.n AS churned, b.n AS retained, c.n - b.n AS "new", (p.n - b.n) / cast(p.n AS double) * 100 AS churn_rate
FROM (SELECT year, count(DISTINCT customer_id) AS n FROM m_op GROUP BY year) c
JOIN (SELECT year + 1 AS year, count(DISTINCT customer_id) AS n FROM m_op GROUP BY year) p ON p.year = c.year
JOIN (SELECT y AS year, count(*) AS n FROM (SELECT DISTINCT customer_id, year AS y FROM m_op INTERSECT SELECT DISTINCT customer_id, year + 1 FROM m_op) q GROUP BY y) b ON b.year = c.year
"""
ORACLE_MARTS["m_cust_promo"] = """
SELECT *, date_diff('day', last_order_date, max(last_order_date) OVER ()) AS days_inactive,
       CASE WHEN pr <= 0.001 THEN 'No Promo' WHEN pr <= 0.5 THEN 'Occasional' WHEN pr <= 0.8 THEN 'Frequent' ELSE 'Dependent' END AS dependency,
       CASE WHEN total_revenue <= 0 THEN NULL WHEN total_revenue <= 100000 THEN 'Low Value' WHEN total_revenue <= 300000 THEN 'Mid Value' WHEN total_revenue IS NOT NULL THEN 'High Value' END AS priority
FROM (SELECT customer_id, count(*) AS total_orders, sum(has_promo) AS promo_orders, sum(net_revenue) AS total_revenue,
             max(order_date) AS last_order_date, sum(has_promo) / cast(count(*) AS double) AS pr FROM m_op GROUP BY customer_id) x
"""
ORACLE_MARTS["m_year_rev"] = """
SELECT year, cast(sum(CASE WHEN has_promo = 1 THEN net_revenue ELSE 0 END) AS double) / 1e9 AS p,
       cast(sum(CASE WHEN has_promo = 1 THEN 0 ELSE coalesce(net_revenue, 0) END) AS double) / 1e9 AS o
FROM m_op WHERE year >= 1996 AND year <= 2001 GROUP BY year
"""


def _op(cat):
    return op.order_promo(cat.orders, cat.order_items)


def _card(cat):
    return op.promo_scorecard(cat.order_items, cat.promotions)


def _marked(cat):
    return op.at_risk_customers(op.customer_promo(_op(cat)))


@query(
    "order_promo",
    f"""SELECT order_id, customer_id, order_date, has_promo, CASE WHEN has_promo = 1 THEN 'Promo' ELSE 'Non-Promo' END AS promo_label, month, year,
               {money('gross_revenue')} AS gross_revenue, {money('total_discount')} AS total_discount, {money('net_revenue')} AS net_revenue FROM m_op""",
)
def _(cat):
    return _op(cat).withColumns({c: money_col(c) for c in ("gross_revenue", "total_discount", "net_revenue")})


@query(
    "promo_kpis",
    f"""SELECT count(*) AS orders, {big('sum(has_promo)')} AS promo_orders, {r6('sum(has_promo) / cast(count(*) AS double) * 100')} AS take_up_rate,
               {r6('cast(sum(total_discount) FILTER (has_promo = 1) AS double) / sum(has_promo)')} AS avg_discount,
               {r6('avg(cast(total_discount AS double) / cast(gross_revenue AS double)) FILTER (has_promo = 1) * 100')} AS discount_depth_mean,
               {r6('cast(sum(total_discount) FILTER (has_promo = 1) AS double) / cast(sum(gross_revenue) FILTER (has_promo = 1) AS double) * 100')} AS discount_depth_total,
               {money('sum(net_revenue) FILTER (has_promo = 1)')} AS promo_revenue,
               {money('sum(net_revenue) - sum(net_revenue) FILTER (has_promo = 1)')} AS nonpromo_revenue,
               {r6('cast(sum(net_revenue) FILTER (has_promo = 1) AS double) / cast(sum(net_revenue) AS double) * 100')} AS promo_revenue_share FROM m_op""",
)
def _(cat):
    return op.promo_kpis(_op(cat))


def _by_period(period: str) -> str:
    return f"""SELECT {period}, n AS orders, pn AS promo_orders, {money('p')} AS promo_revenue, {money('o')} AS nonpromo_revenue, {money('p + o')} AS total_revenue,
                      {r6('pn / cast(n AS double) * 100')} AS take_up_rate, {r6('cast(p AS double) / cast(p + o AS double) * 100')} AS promo_share
               FROM (SELECT {period}, count(*) AS n, {big('sum(has_promo)')} AS pn, sum(CASE WHEN has_promo = 1 THEN net_revenue ELSE 0 END) AS p,
                            sum(CASE WHEN has_promo = 1 THEN 0 ELSE coalesce(net_revenue, 0) END) AS o FROM m_op GROUP BY {period}) x"""


@query("promo_revenue_monthly", _by_period("month"))
def _(cat):
    return op.promo_revenue_by(_op(cat), "month")


@query("promo_revenue_yearly", _by_period("year"))
def _(cat):
    return op.promo_revenue_by(_op(cat), "year")


@query(
    "promo_takeup_bands",
    f"""SELECT count(*) AS months, {big('count(*) FILTER (rate < 20)')} AS months_low, {big('count(*) FILTER (rate BETWEEN 20 AND 80)')} AS months_middle,
               {big('count(*) FILTER (rate > 80)')} AS months_high, {r6('avg(rate)')} AS rate_mean, {r6('stddev_samp(rate)')} AS rate_std, {r6('min(rate)')} AS rate_min,
               {r6('quantile_cont(rate, 0.25)')} AS rate_q1, {r6('median(rate)')} AS rate_median, {r6('quantile_cont(rate, 0.75)')} AS rate_q3, {r6('max(rate)')} AS rate_max
        FROM (SELECT month, sum(has_promo) / cast(count(*) AS double) * 100 AS rate FROM m_op GROUP BY month) x""",
)
def _(cat):
    return op.promo_takeup_bands(_op(cat))


_MONTHS = "(SELECT month, sum(net_revenue) AS v, count(*) AS n, sum(has_promo) / cast(count(*) AS double) AS t FROM m_op GROUP BY month) x"


@query(
    "promo_month_effect",
    f"""SELECT CASE WHEN t >= 0.7 THEN 1 ELSE 0 END AS is_promo_month, count(*) AS months, {r6('cast(sum(v) AS double) / count(*)')} AS avg_revenue,
               {r6('sum(n) / cast(count(*) AS double)')} AS avg_orders, {r6('avg(cast(v AS double) / n)')} AS avg_order_value FROM {_MONTHS} GROUP BY 1""",
)
def _(cat):
    # nearly every month of this data is above 20 % take-up, so the split is set higher
    return op.promo_month_effect(_op(cat), threshold=0.7)


@query(
    "promo_month_fit",
    f"""SELECT months, {r6('r')} AS pearson_r, {r6('r * sqrt((months - 2) / (1 - r * r))')} AS t_statistic, {r6('a')} AS slope, {r6('b')} AS intercept
        FROM (SELECT count(*) AS months, corr(y, x) AS r, regr_slope(y, x) AS a, regr_intercept(y, x) AS b
              FROM (SELECT t * 100 AS x, cast(v AS double) / 1e6 AS y FROM {_MONTHS}) p) q""",
)
def _(cat):
    return op.promo_month_fit(_op(cat))


def _by_attribute(dimension: str) -> str:
    return f"""SELECT {dimension}, count(DISTINCT order_id) AS total_orders, {money('sum(g - discount_amount)')} AS total_revenue, {money('sum(discount_amount)')} AS total_discount,
                      {r6('cast(sum(discount_amount) AS double) / count(*)')} AS avg_discount, {big('sum(quantity)')} AS total_qty,
                      {r6('cast(sum(discount_amount) AS double) / cast(sum(g) AS double) * 100')} AS discount_depth,
                      {r6('cast(sum(g - discount_amount) AS double) / cast(sum(sum(g - discount_amount)) OVER () AS double) * 100')} AS revenue_share,
                      {r6('cast(sum(g - discount_amount) AS double) / cast(sum(discount_amount) AS double)')} AS roi
               FROM (SELECT *, cast(quantity * unit_price AS decimal(18,4)) AS g FROM r_order_items) i JOIN r_promotions p ON p.promo_id = i.promo_id
               WHERE {dimension} IS NOT NULL GROUP BY {dimension}"""


@query("promo_by_type", _by_attribute("promo_type"))
def _(cat):
    return op.promo_by(op.promo_lines(cat.order_items, cat.promotions), "promo_type")


@query("promo_by_category", _by_attribute("applicable_category"))
def _(cat):
    return op.promo_by(op.promo_lines(cat.order_items, cat.promotions), "applicable_category")


@query(
    "promo_scorecard",
    f"""SELECT promo_id, promo_name, promo_type, applicable_category, promo_channel, total_orders, duration_days, recommendation,
               {money('gross')} AS gross_revenue, {money('net')} AS net_revenue, {money('discount')} AS total_discount, {r6('roi')} AS roi, {r6('depth')} AS discount_depth,
               {r6('cast(discount AS double) / total_orders')} AS cost_per_order FROM m_card""",
)
def _(cat):
    return op.scorecard_output(_card(cat))


@query(
    "promo_budget",
    f"""SELECT recommendation, count(*) AS campaigns, {money('sum(discount)')} AS total_discount, {money('sum(net)')} AS total_revenue,
               {r6('cast(sum(discount) AS double) / cast(sum(sum(discount)) OVER () AS double) * 100')} AS budget_pct FROM m_card GROUP BY recommendation""",
)
def _(cat):
    return op.promo_budget(_card(cat))


@query(
    "yearly_churn",
    f'SELECT year, prev_active, curr_active, churned, retained, "new", {r6("churn_rate")} AS churn_rate FROM m_churn',
)
def _(cat):
    return op.churn_by_year_output(op.yearly_churn(cat.orders))


@query(
    "promo_dependency",
    f"""SELECT dependency, count(*) AS num_customers, {r6('avg(total_orders)')} AS avg_orders, {r6('cast(sum(total_revenue) AS double) / count(total_revenue)')} AS avg_revenue,
               {r6('count(*) / cast(sum(count(*)) OVER () AS double) * 100')} AS pct_customers FROM m_cust_promo GROUP BY dependency""",
)
def _(cat):
    return op.promo_dependency(op.customer_promo(_op(cat)))


_TARGET = "days_inactive >= 365 AND dependency IN ('Occasional', 'Frequent')"


@query(
    "at_risk_targets",
    f"""SELECT priority, count(*) AS num_customers, {r6('cast(sum(total_revenue) AS double) / count(*)')} AS avg_revenue, {money('sum(total_revenue)')} AS total_revenue
        FROM m_cust_promo WHERE {_TARGET} AND priority IS NOT NULL GROUP BY priority""",
)
def _(cat):
    return op.at_risk_targets(_marked(cat))


@query(
    "at_risk_funnel",
    f"""SELECT count(*) AS customers, {big("count(*) FILTER (dependency IN ('Occasional', 'Frequent'))")} AS valuable,
               {big('count(*) FILTER (days_inactive >= 365)')} AS at_risk, {big(f'count(*) FILTER ({_TARGET})')} AS targets FROM m_cust_promo""",
)
def _(cat):
    return op.at_risk_funnel(_marked(cat))


@query(
    "promo_reallocation",
    f"""SELECT round(cur, 2) AS current_discount, round(k, 2) AS keep_budget, round(w, 2) AS review_budget, round(s, 2) AS stop_budget, round(s * 0.30::double, 2) AS realloc_budget,
               round(s * (1 - 0.30::double), 2) AS saved_budget, n AS targets, round(s * 0.30::double / nullif(n, 0), 4) AS cost_per_target,
               cast(floor(n * 0.2::double) AS bigint) AS recovered, round(floor(n * 0.2::double) * m, 2) AS incremental_revenue, round(floor(n * 0.2::double) * m + s * (1 - 0.30::double), 2) AS net_benefit
        FROM (SELECT cast(sum(discount) AS double) AS cur, cast(sum(CASE WHEN recommendation = 'KEEP' THEN discount ELSE 0 END) AS double) AS k,
                     cast(sum(CASE WHEN recommendation = 'REVIEW' THEN discount ELSE 0 END) AS double) AS w,
                     cast(sum(CASE WHEN recommendation = 'STOP' THEN discount ELSE 0 END) AS double) AS s FROM m_card) b,
             (SELECT count(*) AS n, coalesce(cast(sum(total_revenue) AS double) / count(total_revenue), 0) AS m FROM m_cust_promo WHERE {_TARGET}) t""",
)
def _(cat):
    return op.promo_reallocation(_card(cat), _marked(cat))


@query(
    "revenue_trend_scenarios",
    f"""SELECT y.year, {r6('a1 * y.year + b1')} AS revenue_with_promo, {r6('a2 * y.year + b2')} AS revenue_no_promo
        FROM (SELECT regr_slope(p + o, year) AS a1, regr_intercept(p + o, year) AS b1, regr_slope(o + p / (1 - 0.1409::double), year) AS a2,
                     regr_intercept(o + p / (1 - 0.1409::double), year) AS b2 FROM m_year_rev) f, (SELECT 2002 AS year UNION ALL SELECT 2003 UNION ALL SELECT 2004) y""",
)
def _(cat):
    return op.revenue_trend_scenarios(_op(cat), 1996)


@query(
    "revenue_trend_error",
    f"""SELECT count(*) AS years, {r6('avg(abs(p + o - (a * year + b)))')} AS mae
        FROM m_year_rev, (SELECT regr_slope(p + o, year) AS a, regr_intercept(p + o, year) AS b FROM m_year_rev) f""",
)
def _(cat):
    return op.revenue_trend_error(_op(cat), 1996)


@query(
    "churn_projection",
    f"""WITH f AS (SELECT regr_slope(churn_rate, year) AS a, regr_intercept(churn_rate, year) AS b, arg_max(curr_active, year) AS c,
                          (SELECT avg("new") FROM (SELECT "new" FROM m_churn ORDER BY year DESC LIMIT 3) t) AS w, max(year) AS y FROM m_churn),
             r AS (SELECT c, w, y, greatest(0.0::double, least(95.0::double, a * (y + 1) + b)) AS r1, greatest(0.0::double, least(95.0::double, a * (y + 2) + b)) AS r2,
                          greatest(0.0::double, least(95.0::double, a * (y + 3) + b)) AS r3 FROM f),
             a1 AS (SELECT *, c - c * r1 / 100 + w AS c1 FROM r), a2 AS (SELECT *, c1 - c1 * r2 / 100 + w AS c2 FROM a1), a3 AS (SELECT *, c2 - c2 * r3 / 100 + w AS c3 FROM a2)
        SELECT y + 1 AS year, {r6('r1')} AS churn_rate, {r6('c1')} AS active_customers FROM a3
        UNION ALL SELECT y + 2, {r6('r2')}, {r6('c2')} FROM a3 UNION ALL SELECT y + 3, {r6('r3')}, {r6('c3')} FROM a3""",
)
def _(cat):
    return op.churn_projection(op.yearly_churn(cat.orders))
