"""Queries for the supply chain analyses."""

from tallyshop.operators import supply as op
from tallyshop.plans.registry import big, money, query, r6

_MONTH = "cast(date_trunc('month', snapshot_date) AS date)"
_KEYS = {
    "str_monthly": (("snapshot_month",), "r_inventory"),
    "str_yearly": (("year",), "r_inventory"),
    "str_by_segment": (("segment",), "r_inventory"),
    "str_by_category": (("category",), "r_inventory"),
    "str_monthly_by_segment": (("snapshot_month", "segment"), "r_inventory"),
}
_SQL_KEYS = {"snapshot_month": _MONTH}


def _sell_through(keys: tuple[str, ...], source: str) -> str:
    shown = ", ".join(f"{_SQL_KEYS.get(k, k)} AS {k}" for k in keys)
    grouped = ", ".join(_SQL_KEYS.get(k, k) for k in keys)
    return f"SELECT {shown}, count(*) AS snapshots, {r6('avg(sell_through_rate)')} AS avg_sell_through FROM {source} GROUP BY {grouped}"


def _register(name: str, keys: tuple[str, ...], source: str) -> None:
    @query(name, _sell_through(keys, source))
    def _(cat):
        return op.sell_through_by(cat.inventory, *keys)


for _name, (_keys, _source) in _KEYS.items():
    _register(_name, _keys, _source)


@query(
    "str_monthly_top_categories",
    _sell_through(
        ("snapshot_month", "category"),
        """r_inventory WHERE category IN (SELECT category FROM (SELECT category, round(avg(sell_through_rate), 6) AS s FROM r_inventory GROUP BY category)
           ORDER BY s DESC, category LIMIT 5)""",
    ),
)
def _(cat):
    return op.sell_through_top_categories(cat.inventory)


_LOSS = "(SELECT DISTINCT cast(date_trunc('month', Date) AS date) AS month FROM r_sales WHERE Revenue < COGS)"
_TOP = "(SELECT cast(date_trunc('month', Date) AS date) AS month FROM r_sales GROUP BY 1 ORDER BY sum(Revenue - COGS) DESC, 1 LIMIT 10)"


def _in_months(months: str) -> str:
    return f"SELECT {_MONTH} AS m, avg(sell_through_rate) AS s FROM r_inventory WHERE {_MONTH} IN {months} GROUP BY 1"


@query("str_in_loss_months", f"SELECT strftime(m, '%Y-%m') AS period, {r6('s')} AS avg_sell_through FROM ({_in_months(_LOSS)}) x")
def _(cat):
    return op.sell_through_in_months_output(cat.inventory, op.loss_months(cat.sales))


@query("str_in_top_profit_months", f"SELECT strftime(m, '%Y-%m') AS period, {r6('s')} AS avg_sell_through FROM ({_in_months(_TOP)}) x")
def _(cat):
    return op.sell_through_in_months_output(cat.inventory, op.top_profit_months(cat.sales))


@query(
    "str_comparison",
    f"""SELECT 'overall' AS months, {r6('avg(sell_through_rate)')} AS avg_sell_through FROM r_inventory
        UNION ALL SELECT 'loss', {r6('avg(s)')} FROM ({_in_months(_LOSS)}) a UNION ALL SELECT 'top_profit', {r6('avg(s)')} FROM ({_in_months(_TOP)}) b""",
)
def _(cat):
    return op.sell_through_comparison(cat.inventory, cat.sales)


@query(
    "str_revenue_corr",
    f"""SELECT count(*) AS months, {r6('corr(s, v)')} AS pearson_r
        FROM (SELECT {_MONTH} AS m, avg(sell_through_rate) AS s FROM r_inventory GROUP BY 1) a
        JOIN (SELECT cast(date_trunc('month', Date) AS date) AS m, cast(sum(Revenue) AS double) AS v FROM r_sales GROUP BY 1) b ON a.m = b.m""",
)
def _(cat):
    return op.sell_through_revenue_correlation(cat.inventory, cat.sales)


def _latest(dimension: str) -> str:
    return f"""SELECT {dimension}, {big('sum(stock_on_hand)')} AS stock_on_hand FROM (
                 SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY snapshot_date DESC) AS rn FROM r_inventory) x WHERE rn = 1 GROUP BY {dimension}"""


@query("latest_stock_by_segment", _latest("segment"))
def _(cat):
    return op.latest_stock_by(cat.inventory, "segment")


@query("latest_stock_by_category", _latest("category"))
def _(cat):
    return op.latest_stock_by(cat.inventory, "category")


@query(
    "order_status_rates",
    "SELECT year(order_date) AS order_year, count(*) AS total_orders, "
    + ", ".join(f"{big(f'''count(*) FILTER (order_status = '{s}')''')} AS {s}" for s in op.STATUSES)
    + ", "
    + ", ".join(
        f"""{r6(f"count(*) FILTER (order_status = '{s}') / cast(count(*) AS double) * 100")} AS {s}_rate"""
        for s in ("delivered", "returned", "cancelled")
    )
    + " FROM r_orders GROUP BY 1",
)
def _(cat):
    return op.order_status_rates(cat.orders)


def _place(place: str) -> str:
    return f"""(SELECT year(order_date) AS y, {place}, count(*) AS n, count(*) FILTER (order_status = 'cancelled') AS c
               FROM r_orders o LEFT JOIN r_geography g ON g.zip = o.zip GROUP BY ALL) p"""


@query(
    "cancelled_by_city_year",
    f"SELECT y AS order_year, city, c AS cancelled_count FROM {_place('city')} WHERE c > 0 AND y BETWEEN 1999 AND 2000",
)
def _(cat):
    return op.cancelled_by_city_year(cat.orders, cat.geography, (1999, 2000))


@query(
    "mean_cancelled_per_city",
    f"SELECT y AS order_year, {r6('avg(c)')} AS avg_cancelled FROM {_place('city')} WHERE c > 0 AND y BETWEEN 1999 AND 2000 GROUP BY y",
)
def _(cat):
    return op.mean_cancelled_per_city(op.cancelled_by_city_year(cat.orders, cat.geography, (1999, 2000)))


@query(
    "cancellation_rate_topk",
    f"""SELECT y AS order_year, rk AS rank, city, c AS cancelled_orders, n AS total_orders, {r6('c / cast(n AS double) * 100')} AS cancellation_rate
        FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY c / cast(n AS double) * 100 DESC, city) AS rk FROM {_place('city')} WHERE y BETWEEN 1996 AND 2000) x WHERE rk <= 5""",
)
def _(cat):
    return op.cancellation_rate_topk(cat.orders, cat.geography, (1996, 2000))


@query(
    "cancelled_by_region",
    f"SELECT region, {r6('avg(c)')} AS avg_cancelled, "
    + ", ".join(f"{big(f'coalesce(sum(c) FILTER (y = {y}), 0)')} AS y{y}" for y in range(1997, 2001))
    + f" FROM {_place('region')} WHERE c > 0 AND y BETWEEN 1997 AND 2000 GROUP BY region",
)
def _(cat):
    return op.cancelled_by_region(cat.orders, cat.geography, (1997, 2000))


def _per_order(period: str) -> str:
    def expr(column: str) -> str:
        return f"cast(date_trunc('month', {column}) AS date)" if period == "month" else f"year({column})"

    return f"""SELECT coalesce(a.p, b.p) AS {period}, {big('coalesce(o, 0)')} AS ordered_products, {big('coalesce(r, 0)')} AS returned_products,
                      {r6('coalesce(r, 0) / cast(nullif(coalesce(o, 0), 0) AS double) * 100')} AS return_rate_pct
               FROM (SELECT {expr('order_date')} AS p, sum(n) AS o FROM r_orders LEFT JOIN (SELECT order_id, count(DISTINCT product_id) AS n FROM r_order_items GROUP BY order_id) i USING (order_id) GROUP BY 1) a
               FULL JOIN (SELECT {expr('return_date')} AS p, sum(quantity) AS r FROM r_returns LEFT JOIN r_order_items USING (order_id, product_id) GROUP BY 1) b ON a.p = b.p"""


@query("return_rate_monthly", _per_order("month"))
def _(cat):
    return op.ordered_and_returned(cat.orders, cat.order_items, cat.returns, "month")


@query("return_rate_yearly", _per_order("year"))
def _(cat):
    return op.ordered_and_returned(cat.orders, cat.order_items, cat.returns, "year")


@query(
    "traffic_by_source",
    f"""SELECT traffic_source, {big('sum(sessions)')} AS total_sessions, {r6('avg(bounce_rate)')} AS avg_bounce_rate, {r6('avg(avg_session_duration_sec)')} AS avg_duration_sec,
               {r6('sum(sessions) / cast(sum(sum(sessions)) OVER () AS double) * 100')} AS session_share_pct FROM r_web_traffic GROUP BY traffic_source""",
)
def _(cat):
    return op.traffic_by_source(cat.web_traffic)


@query(
    "reviews_enriched",
    """SELECT review_id, r.order_id, product_id, r.customer_id, review_date, rating, review_title, order_date, o.zip, order_status, city, region
       FROM r_reviews r LEFT JOIN r_orders o ON o.order_id = r.order_id LEFT JOIN r_geography g ON g.zip = o.zip""",
)
def _(cat):
    return op.reviews_enriched(cat.reviews, cat.orders, cat.geography)


@query(
    "stock_rates",
    "SELECT count(*) AS snapshots, "
    + ", ".join(f"{r6(f'sum({c}) / cast(count(*) AS double) * 100')} AS {c}_pct" for c in ("stockout_flag", "overstock_flag", "reorder_flag"))
    + " FROM r_inventory",
)
def _(cat):
    return op.stock_rates(cat.inventory)


@query(
    "sales_totals",
    f"SELECT year(Date) AS year, {money('sum(Revenue)')} AS revenue, {money('sum(COGS)')} AS cogs, {money('sum(Revenue - COGS)')} AS gross_profit FROM r_sales GROUP BY 1",
)
def _(cat):
    return op.sales_totals(cat.sales)


@query(
    "sessions_by_weekday",
    f"""SELECT isodow(date) - 1 AS weekday, dayname(date) AS day_name, {r6('sum(s) / cast(count(*) AS double)')} AS avg_sessions
        FROM (SELECT date, sum(sessions) AS s FROM r_web_traffic GROUP BY date) d GROUP BY 1, 2""",
)
def _(cat):
    return op.sessions_by_weekday(cat.web_traffic)
