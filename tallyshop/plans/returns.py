"""Queries for the returns analyses."""

from tallyshop.operators import returns as op
from tallyshop.plans.registry import big, money, query, r6


@query(
    "return_kpis",
    f"""SELECT {big('sum(quantity)')} AS total_sold, {big('sum(return_qty)')} AS total_returned, {r6('sum(return_qty) / cast(sum(quantity) AS double)')} AS return_rate,
               {money('sum(refund_amount)')} AS total_refund, {money('sum(net_value)')} AS total_revenue,
               {r6('cast(sum(refund_amount) AS double) / cast(sum(net_value) AS double)')} AS refund_ratio FROM m_item""",
)
def _(cat):
    return op.return_kpis(op.returned_lines(cat))


_EXPRESSIONS = {
    "has_promo": "CASE WHEN promo_id IS NOT NULL THEN 1 ELSE 0 END",
    "month": "cast(date_trunc('month', order_date) AS date)",
}


def _by(dimension: str) -> str:
    keys = op.DIMENSIONS[dimension]
    shown = ", ".join(f"{_EXPRESSIONS.get(k, k)} AS {k}" for k in keys)
    grouped = ", ".join(_EXPRESSIONS.get(k, k) for k in keys)
    present = " AND ".join(f"{_EXPRESSIONS.get(k, k)} IS NOT NULL" for k in keys)
    return f"""SELECT {shown}, {big('sum(quantity)')} AS sold_qty, {big('sum(return_qty)')} AS return_qty,
                      {r6('sum(return_qty) / cast(sum(quantity) AS double)')} AS return_rate, {money('sum(refund_amount)')} AS refund_amount
               FROM m_item WHERE {present} GROUP BY {grouped}"""


def _register(dimension: str) -> None:
    @query(f"return_by_{dimension}", _by(dimension))
    def _(cat):
        return op.return_by(cat, dimension)


for _dimension in op.DIMENSIONS:
    _register(_dimension)

_PRODUCTS = """(SELECT product_name, cast(sum(quantity) AS bigint) AS sold_qty, cast(sum(return_qty) AS bigint) AS return_qty,
                round(cast(sum(return_qty) / cast(sum(quantity) AS double) AS double), 6) AS return_rate, cast(round(sum(refund_amount), 2) AS double) AS refund_amount
                FROM m_item GROUP BY product_name)"""


@query(
    "return_rate_grid",
    "SELECT category, "
    + ", ".join(
        f"""{r6(f"sum(return_qty) FILTER (size = '{s}') / cast(sum(quantity) FILTER (size = '{s}') AS double)")} AS "rate_{s}" """
        for s in ("S", "M", "L", "XL")
    )
    + " FROM m_item GROUP BY category",
)
def _(cat):
    return op.return_rate_grid(cat)


@query("top_product_returns", f"SELECT * FROM {_PRODUCTS} p ORDER BY return_rate DESC, product_name LIMIT 15")
def _(cat):
    return op.top_products_by_rate(op.return_by(cat, "product"))


@query(
    "reliable_product_returns",
    f"""WITH p AS {_PRODUCTS} SELECT * FROM p WHERE sold_qty >= (SELECT quantile_cont(cast(sold_qty AS double), 0.75) FROM p)
        ORDER BY return_rate DESC, product_name LIMIT 15""",
)
def _(cat):
    return op.reliable_product_returns(op.return_by(cat, "product"))


@query(
    "return_trend",
    f"""SELECT cast(date_trunc('month', order_date) AS date) AS month, {big('sum(quantity)')} AS sold_qty, {big('sum(return_qty)')} AS return_qty,
               {r6('sum(return_qty) / cast(sum(quantity) AS double)')} AS return_rate, {money('sum(net_value)')} AS revenue, {money('sum(refund_amount)')} AS refund,
               {r6('cast(sum(refund_amount) AS double) / cast(sum(net_value) AS double)')} AS refund_rate FROM m_item GROUP BY 1""",
)
def _(cat):
    return op.return_trend(cat)


@query(
    "return_reasons",
    f"""SELECT return_reason, count(*) AS events, {big('sum(return_quantity)')} AS return_qty,
               {r6('sum(return_quantity) / cast(sum(sum(return_quantity)) OVER () AS double)')} AS share FROM r_returns WHERE return_quantity > 0 GROUP BY return_reason""",
)
def _(cat):
    return op.return_reasons(cat.returns)


@query(
    "return_by_delivery_bucket",
    f"""SELECT b AS delivery_bucket, {big('sum(quantity)')} AS total_qty, {big('sum(return_qty)')} AS return_qty, {r6('sum(return_qty) / cast(sum(quantity) AS double)')} AS return_rate
        FROM (SELECT *, CASE WHEN delivery_days > 0 AND delivery_days <= 2 THEN '0-2d' WHEN delivery_days > 2 AND delivery_days <= 4 THEN '2-4d'
                             WHEN delivery_days > 4 AND delivery_days <= 5 THEN '4-5d' WHEN delivery_days > 5 AND delivery_days <= 7 THEN '5-7d' END AS b FROM m_item) x
        WHERE b IS NOT NULL GROUP BY b""",
)
def _(cat):
    return op.return_by_delivery_bucket(cat)


@query(
    "profit_impact",
    f"""SELECT 'total_profit_before' AS metric, {money('sum(profit)')} AS value FROM m_item
        UNION ALL SELECT 'total_profit_after', {money('sum(profit) - sum(refund_amount)')} FROM m_item""",
)
def _(cat):
    return op.profit_impact(cat)


_CURVE = """(SELECT product_id, product_name, refund, row_number() OVER w AS rn, sum(refund) OVER w AS cum, sum(refund) OVER () AS total, count(*) OVER () AS n
            FROM (SELECT product_id, product_name, sum(refund_amount) AS refund FROM m_item GROUP BY product_id, product_name) p
            WINDOW w AS (ORDER BY refund DESC, product_id ROWS UNBOUNDED PRECEDING)) c"""


@query(
    "refund_pareto",
    f"""SELECT product_id, product_name, rn AS position, {money('refund')} AS total_refund, {money('cum')} AS cum_refund,
               {r6('cast(cum AS double) / cast(total AS double)')} AS cum_pct FROM {_CURVE}""",
)
def _(cat):
    return op.refund_pareto(cat)


@query(
    "refund_cutoff",
    f"""SELECT k AS products_to_cutoff, n AS products, {r6('k / cast(n AS double)')} AS share_of_products
        FROM (SELECT min(rn) FILTER (cast(cum AS double) / cast(total AS double) >= 0.8) AS k, max(rn) AS n FROM {_CURVE}) x""",
)
def _(cat):
    return op.refund_cutoff(cat)
