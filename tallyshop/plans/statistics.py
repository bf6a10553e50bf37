"""Queries for statistics and baskets."""

from tallyshop.functions.columns import shown
from tallyshop.operators import baskets, customers, information, models
from tallyshop.operators import statistics as op
from tallyshop.operators.marts import modal_value
from tallyshop.plans.daily import daily_table
from tallyshop.plans.registry import query, r6
from tallyshop.sources.tables import Catalog



def _simpson(density: str, upper: str) -> str:
    """Oracle text of the integral of ``density`` (of u) from 0 to ``upper``, by Simpson's rule over 4,000 steps."""
    weight = "CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    cell = density.replace("{u}", f"(i * ({upper}) / 4000.0::double)")
    return f"(list_sum(list_transform(range(4001), lambda i: {weight} * ({cell}))) * ({upper}) / 12000.0::double)"


def _normal_p(z: str) -> str:
    """Two-sided normal tail."""
    return f"greatest(1 - 2 / sqrt(2 * pi()) * {_simpson('exp(-{u} * {u} / 2)', f'abs({z})')}, 0)"


def _student_p(t: str, v: str) -> str:
    """Two-sided tail of Student's t."""
    constant = f"exp(lgamma(({v} + 1) / 2.0::double) - lgamma({v} / 2.0::double)) / sqrt({v} * pi())"
    return f"greatest(1 - 2 * {constant} * {_simpson(f'pow(1 + {{u}} * {{u}} / {v}, -({v} + 1) / 2.0::double)', f'abs({t})')}, 0)"


def _chi_square_p(x: str, k: str) -> str:
    """Upper tail of chi-square, integrated over the square root."""
    constant = f"exp((1 - {k} / 2.0::double) * ln(2.0::double) - lgamma({k} / 2.0::double))"
    return f"greatest(1 - {constant} * {_simpson(f'pow({{u}}, {k} - 1) * exp(-{{u}} * {{u}} / 2)', f'sqrt({x})')}, 0)"


@query(
    "moments",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS n, {r6(f'avg(cast({c} AS double))')} AS mean, {r6(f'stddev_samp(cast({c} AS double))')} AS std,
            {r6(f'skewness(cast({c} AS double))')} AS skewness, {r6(f'kurtosis(cast({c} AS double))')} AS kurtosis FROM r_payments"""
        for c in ("payment_value", "installments")
    ),
)
def _(cat):
    return shown(op.moments(cat.payments, ["payment_value", "installments"]))


@query("ks_normal")
def _(cat):
    return shown(op.ks_normal(cat.payments, "payment_value"))


@query(
    "pearson_price_cogs",
    f"""SELECT n, {r6('r')} AS r, {r6('r * sqrt((n - 2) / (1 - r * r))')} AS t FROM (SELECT count(*) AS n, corr(cast(price AS double), cast(cogs AS double)) AS r FROM r_products) x""",
)
def _(cat):
    return shown(op.pearson(cat.products, "price", "cogs").drop("p_value"))


_RANK = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / cast(2 AS double)"


@query(
    "spearman_price_cogs",
    f"""SELECT count(*) AS n, {r6('corr(a, b)')} AS r FROM (SELECT {_RANK.format(c='price')} AS a, {_RANK.format(c='cogs')} AS b FROM r_products) x""",
)
def _(cat):
    return shown(op.spearman(cat.products, "price", "cogs").select("n", "r"))


@query(
    "spearman_revenue_cogs",
    f"""SELECT count(*) AS n, {r6('corr(a, b)')} AS r FROM (SELECT {_RANK.format(c='Revenue')} AS a, {_RANK.format(c='COGS')} AS b FROM r_sales) x""",
)
def _(cat):
    return shown(op.spearman(cat.sales, "Revenue", "COGS").select("n", "r"))


@query(
    "correlation_p_values",
    f"""SELECT n, {r6('r')} AS r, {r6('t')} AS t, {r6(_student_p('t', '(n - 2)'))} AS p_value FROM (SELECT n, r, r * sqrt((n - 2) / (1 - r * r)) AS t
        FROM (SELECT count(*) AS n, corr(cast(payment_value AS double), cast(installments AS double)) AS r FROM r_payments) x) y""",
)
def _(cat):
    return shown(op.pearson(cat.payments, "payment_value", "installments"))


@query(
    "spearman_p_values",
    f"""SELECT n, {r6('r')} AS r, {r6('t')} AS t, {r6(_student_p('t', '(n - 2)'))} AS p_value FROM (SELECT n, r, r * sqrt((n - 2) / (1 - r * r)) AS t
        FROM (SELECT count(*) AS n, corr(a, b) AS r FROM (SELECT {_RANK.format(c='quantity')} AS a, {_RANK.format(c='unit_price')} AS b FROM r_order_items) x) y) z""",
)
def _(cat):
    return shown(op.spearman(cat.order_items, "quantity", "unit_price"))


_PAIRS = f"""SELECT a.f AS feature_a, b.f AS feature_b, CASE WHEN min(a.v) < max(a.v) AND min(b.v) < max(b.v) THEN {r6('corr(a.v, b.v)')} END AS r
    FROM m_daily_values a JOIN m_daily_values b ON a.date = b.date AND a.f < b.f WHERE a.f <> 'is_web_data_simulated' AND b.f <> 'is_web_data_simulated' GROUP BY a.f, b.f"""


def _pairs(cat: Catalog):
    daily = daily_table(cat)
    return shown(op.correlation_pairs(daily, op.numeric_columns(daily, ("is_web_data_simulated",))))


@query("feature_correlations", _PAIRS)
def _(cat):
    return _pairs(cat)


@query("top_positive_pairs", f"SELECT * FROM ({_PAIRS}) p WHERE r > 0 ORDER BY r DESC, feature_a, feature_b LIMIT 20")
def _(cat):
    return op.top_pairs(_pairs(cat))


@query("top_negative_pairs", f"SELECT * FROM ({_PAIRS}) p WHERE r < 0 ORDER BY r, feature_a, feature_b LIMIT 20")
def _(cat):
    return op.top_pairs(_pairs(cat), positive=False)


@query(
    "line_fit",
    f"""SELECT {r6('regr_slope(y, x)')} AS slope, {r6('regr_intercept(y, x)')} AS intercept, {r6('regr_r2(y, x)')} AS r2
        FROM (SELECT cast(price AS double) AS x, cast(cogs AS double) AS y FROM r_products) p""",
)
def _(cat):
    return shown(op.line_fit(cat.products, "price", "cogs"))


@query(
    "cogs_ratio",
    f"""SELECT days, {r6('m')} AS mean, {r6('s')} AS std, {r6('m - 2 * s')} AS low, {r6('m + 2 * s')} AS high
        FROM (SELECT count(*) AS days, avg(cast(COGS AS double) / cast(Revenue AS double)) AS m, stddev_samp(cast(COGS AS double) / cast(Revenue AS double)) AS s FROM r_sales) x""",
)
def _(cat):
    return shown(op.cogs_ratio(cat.sales))


def _kruskal(group: str, extra: str = "") -> str:
    return f"""WITH k AS (SELECT {group} AS g, {_RANK.format(c='price')} AS rk, count(*) OVER (PARTITION BY price) AS t FROM r_products),
      a AS (SELECT g, cast(count(*) AS double) AS n, sum(rk) AS rs, sum(cast(t AS double) * t - 1) AS ts FROM k GROUP BY g),
      b AS (SELECT sum(n) AS n, count(*) AS k, sum(rs * rs / n) AS q, sum(ts) AS ties FROM a),
      c AS (SELECT *, (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS h FROM b)
      SELECT '{group}' AS grouping, cast(n AS bigint) AS n, k AS groups, {r6('h')} AS "H", {r6('(h - k + 1) / (n - k)')} AS epsilon_squared,
             CASE WHEN (h - k + 1) / (n - k) >= 0.16 THEN 'large' WHEN (h - k + 1) / (n - k) >= 0.04 THEN 'medium' ELSE 'small' END AS level{extra} FROM c"""


@query("kruskal_price_by_category", _kruskal("category"))
def _(cat):
    return shown(op.kruskal_wallis(cat.products, "price", "category"))


@query("kruskal_price_by_segment", _kruskal("segment"))
def _(cat):
    return shown(op.kruskal_wallis(cat.products, "price", "segment"))


_KRUSKAL_P = f", {r6(_chi_square_p('h', '(k - 1)'))} AS p_value"


@query("kruskal_p_value", _kruskal("category", _KRUSKAL_P))
def _(cat):
    return shown(op.kruskal_p_value(op.kruskal_wallis(cat.products, "price", "category")))


@query("kruskal_p_value_by_segment", _kruskal("segment", _KRUSKAL_P))
def _(cat):
    return shown(op.kruskal_p_value(op.kruskal_wallis(cat.products, "price", "segment")))


def _dunn(extra: str = "") -> str:
    z = "(x.m - y.m) / sqrt((nn * (nn + 1) / 12 - ties / (12 * (nn - 1))) * (1 / x.n + 1 / y.n))"
    return f"""WITH k AS (SELECT category AS g, {_RANK.format(c='price')} AS rk, count(*) OVER (PARTITION BY price) AS t FROM r_products),
      a AS (SELECT g, cast(count(*) AS double) AS n, sum(rk) / count(*) AS m, sum(cast(t AS double) * t - 1) AS ts FROM k GROUP BY g),
      b AS (SELECT sum(n) AS nn, sum(ts) AS ties, count(*) * (count(*) - 1) / 2 AS pairs FROM a),
      d AS (SELECT x.g AS group_a, y.g AS group_b, {z} AS z, pairs FROM a x JOIN a y ON x.g < y.g, b)
      SELECT group_a, group_b, {r6('z')} AS z{extra} FROM d"""


@query("dunn_posthoc", _dunn())
def _(cat):
    return shown(op.dunn_posthoc(cat.products, "price", "category").drop("p_bonferroni"))


@query("dunn_p_values", _dunn(f", {r6('least(1.0::double, ' + _normal_p('z') + ' * pairs)')} AS p_bonferroni"))
def _(cat):
    return shown(op.dunn_posthoc(cat.products, "price", "category"))


@query(
    "chi_square_delivery_segment",
    f"""WITH x AS (SELECT delivery_days AS a, segment AS b, cast(count(*) AS double) AS o FROM m_last_delivery JOIN m_rfm USING (customer_id) WHERE delivery_days IN (6, 7) GROUP BY ALL),
      e AS (SELECT o, sum(o) OVER (PARTITION BY a) AS r, sum(o) OVER (PARTITION BY b) AS c, sum(o) OVER () AS n FROM x)
      SELECT {r6('max(n) * (sum(o * o / (r * c)) - 1)')} AS chi2, (SELECT (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) FROM x) AS dof, cast(max(n) AS bigint) AS n FROM e""",
)
def _(cat):
    last = customers.last_order_delivery(cat).where("delivery_days IN (6, 7)")
    return shown(op.chi_square(last.join(customers.segments(cat), "customer_id"), "delivery_days", "segment"))


_ERA = "1999-01-01"


def _mi(where: str) -> str:
    barred = ", ".join(f"'{c}'" for c in models.LEAKY_COLUMNS)
    cells = f"""SELECT f, v, ln(1 + greatest("Revenue", 0)) AS y FROM m_daily_values JOIN (SELECT date, "Revenue" FROM m_processed) t USING (date) WHERE f NOT IN ({barred}) AND {where}"""
    probabilities = "[0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]"
    return f"""(SELECT f, sum(n / tot * ln(n * tot / (nx * ny))) AS mi FROM (
       SELECT f, cast(n AS double) AS n, cast(sum(n) OVER (PARTITION BY f) AS double) AS tot, cast(sum(n) OVER (PARTITION BY f, xb) AS double) AS nx, cast(sum(n) OVER (PARTITION BY f, yb) AS double) AS ny
       FROM (SELECT f, len(list_filter(xe, lambda e: e < v)) AS xb, len(list_filter(ye, lambda e: e < y)) AS yb, count(*) AS n
             FROM ({cells}) c JOIN (SELECT f, quantile_cont(v, {probabilities}) AS xe, quantile_cont(y, {probabilities}) AS ye FROM ({cells}) d GROUP BY f) q USING (f) GROUP BY ALL) j) w GROUP BY f)"""


@query(
    "mutual_information",
    f"""SELECT a.f AS feature, {r6('a.mi')} AS mi_full, {r6('b.mi')} AS mi_era, {r6('b.mi - a.mi')} AS delta, row_number() OVER (ORDER BY round(a.mi, 9) DESC, a.f) AS rank_full,
               row_number() OVER (ORDER BY round(b.mi, 9) DESC, a.f) AS rank_era, CASE WHEN a.mi < 0.01 AND b.mi < 0.01 THEN 1 ELSE 0 END AS useless
        FROM {_mi('true')} a JOIN {_mi(f"date >= date '{_ERA}'")} b ON a.f = b.f""",
)
def _(cat):
    daily = daily_table(cat)
    return shown(op.mutual_information(daily, op.numeric_columns(daily, models.LEAKY_COLUMNS), "Revenue", _ERA))


@query("mutual_information_neighbours")
def _(cat):
    daily = daily_table(cat)
    return shown(information.feature_ranking(daily, op.numeric_columns(daily, models.LEAKY_COLUMNS), "Revenue", _ERA))


# --- baskets -------------------------------------------------------------------------------------

_BASKET = """(SELECT DISTINCT i.order_id, p.{item} AS item FROM r_order_items i JOIN r_orders o ON o.order_id = i.order_id
             JOIN r_products p ON p.product_id = i.product_id WHERE o.order_status = 'delivered')"""
_CATEGORY_RULES = f"""WITH b AS {_BASKET.format(item='category')}, d AS (SELECT item, row_number() OVER (ORDER BY item) - 1 AS i FROM (SELECT DISTINCT item FROM b) z),
  m AS (SELECT order_id, cast(sum(1 << i) AS int) AS mask FROM b JOIN d USING (item) GROUP BY order_id), g AS (SELECT mask, count(*) AS n FROM m GROUP BY mask),
  s AS (SELECT cast(s AS int) AS s FROM generate_series(1, 63) q(s)), f AS (SELECT s, cast(sum(n) AS bigint) AS freq FROM s JOIN g ON (mask & s) = s GROUP BY s), t AS (SELECT count(*) AS n FROM m),
  k AS (SELECT f.* FROM f, t WHERE freq >= 0.005 * n),
  l AS (SELECT s, string_agg(item, ', ' ORDER BY item) AS label FROM s JOIN d ON (s >> i) & 1 = 1 GROUP BY s)
SELECT la.label AS antecedent, lc.label AS consequent, {r6('u.freq / cast(n AS double)')} AS support, {r6('u.freq / cast(a.freq AS double)')} AS confidence,
       {r6('u.freq * n / (cast(a.freq AS double) * c.freq)')} AS lift
FROM k a JOIN k c ON (a.s & c.s) = 0 JOIN k u ON u.s = (a.s | c.s) JOIN l la ON la.s = a.s JOIN l lc ON lc.s = c.s, t
WHERE u.freq / cast(a.freq AS double) >= 0.3 AND u.freq * n / (cast(a.freq AS double) * c.freq) >= 1.0"""


@query("market_basket_categories", _CATEGORY_RULES)
def _(cat):
    # categories are nearly independent in this data, so the lift threshold is 1.0
    return shown(baskets.market_basket(cat, "category", min_lift=1.0).drop("rule"))


def _levels(support: float, most: int = 7) -> str:
    """Oracle text: itemsets level by level; an order has at most seven lines, so no larger set occurs."""
    parts = [
        f"b AS {_BASKET.format(item='product_name')}", "t AS (SELECT count(DISTINCT order_id) AS n FROM b)",
        f"f1 AS (SELECT [item] AS items, count(*) AS freq FROM b GROUP BY item HAVING count(*) >= (SELECT {support} * n FROM t))",
        "o1 AS (SELECT order_id, [item] AS items FROM b WHERE [item] IN (SELECT items FROM f1))",
    ]
    for k in range(2, most + 1):
        parts += [
            f"c{k} AS (SELECT o.order_id, list_append(o.items, b.item) AS items FROM o{k - 1} o JOIN b ON b.order_id = o.order_id AND b.item > o.items[{k - 1}])",
            f"f{k} AS (SELECT items, count(*) AS freq FROM c{k} GROUP BY items HAVING count(*) >= (SELECT {support} * n FROM t))",
            f"o{k} AS (SELECT c.* FROM c{k} c SEMI JOIN f{k} f ON f.items = c.items)",
        ]
    return "WITH " + ", ".join(parts) + ", f AS (" + " UNION ALL ".join(f"SELECT * FROM f{k}" for k in range(1, most + 1)) + ")"


@query(
    "market_basket_product_pairs",
    f"""{_levels(0.003)}, m AS (SELECT items, freq, unnest(range(1, (1 << len(items)) - 1)) AS mask FROM f WHERE len(items) > 1),
          s AS (SELECT freq, list_filter(items, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS a, list_filter(items, lambda x, i: (mask >> (i - 1)) & 1 = 0) AS c FROM m)
        SELECT array_to_string(a, ', ') AS antecedent, array_to_string(c, ', ') AS consequent, {r6('s.freq / cast(t.n AS double)')} AS support, {r6('s.freq / cast(fa.freq AS double)')} AS confidence,
               {r6('s.freq * t.n / (cast(fa.freq AS double) * fc.freq)')} AS lift
        FROM s JOIN f fa ON fa.items = a JOIN f fc ON fc.items = c, t WHERE s.freq / cast(fa.freq AS double) >= 0.05 AND s.freq * t.n / (cast(fa.freq AS double) * fc.freq) >= 1.05""",
)
def _(cat):
    # 64 names bought almost evenly: pair supports stay near 0.3 %, so thresholds are lower
    return shown(baskets.market_basket(cat, min_support=0.003, min_confidence=0.05, min_lift=1.05).drop("rule"))


_BOTH = """(SELECT DISTINCT customer_id FROM r_orders WHERE order_status = 'delivered' AND order_id IN (SELECT order_id FROM m_item WHERE product_name = 'small ring')
            AND order_id IN (SELECT order_id FROM m_item WHERE product_name = 'red widget'))"""


@query("pair_buyers", f"SELECT customer_id FROM {_BOTH} x")
def _(cat):
    return baskets.pair_buyers(cat, "small ring", "red widget")


_PROFILE = {"acquisition_channel": "r_customers", "dominant_source": "m_channel", "segment": "m_rfm"}


@query(
    "pair_buyer_profile",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS dimension, cast({c} AS string) AS value, count(*) AS customers, {r6(f'count(*) / cast((SELECT count(*) FROM {_BOTH} y) AS double) * 100')} AS pct
            FROM {t} WHERE customer_id IN (SELECT customer_id FROM {_BOTH} x) GROUP BY {c}"""
        for c, t in _PROFILE.items()
    ),
)
def _(cat):
    lines = cat.order_items.select("order_id").join(cat.orders.select("order_id", "customer_id", "order_source"), "order_id")
    sources = modal_value(lines, "customer_id", "order_source", "dominant_source")
    attributes = (
        cat.customers.select("customer_id", "acquisition_channel")
        .join(sources, "customer_id", "left")
        .join(customers.segments(cat).select("customer_id", "segment"), "customer_id", "left")
    )
    return shown(baskets.pair_buyer_profile(baskets.pair_buyers(cat, "small ring", "red widget"), attributes, list(_PROFILE)))
