"""Queries for the daily tables."""

from dataclasses import replace

from tallyshop.functions.columns import shown, slug
from tallyshop.operators import daily as op
from tallyshop.operators import models
from tallyshop.plans.registry import ORACLE_MARTS, big, money, query, r6
from tallyshop.session import materialise

SPEC = op.DailySpec(
    "1995-01-01", "2001-12-31",
    order_status=["delivered", "returned", "cancelled", "shipped"],
    payment_method=["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
    device_type=["mobile", "desktop", "tablet"],
    order_source=["organic_search", "paid_search", "social_media", "direct"],
    review_title=["Bad", "Okay", "Excellent"],
    gender=["Female", "Male"],
    age_group=["18-24", "25-34", "35-44", "45-54", "55+"],
    acquisition_channel=["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
    promo_type=["percentage", "fixed"],
    category=["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"],
    segment=sorted(f"Brand#{i}" for i in range(1, 26)),
    traffic_source=["organic_search", "paid_search", "social_media", "direct"],
)
EXACT = ("payment_value", "installments", "avg_discount_amount")
WEB_SPEC = replace(SPEC, start="2000-12-25", end="2001-02-05")


def _hot(column: str, values: list[str], prefix: str | None = None) -> str:
    prefix = prefix or column
    return ", ".join(f"{big(f'''count(*) FILTER ({column} = '{v}')''')} AS {prefix}_{slug(v)}" for v in values)


ORACLE_MARTS["m_spine"] = (
    f"SELECT cast(d AS date) AS date FROM generate_series(timestamp '{SPEC.start}', timestamp '{SPEC.end}', interval 1 day) g(d)"
)
ORACLE_MARTS["m_web_spine"] = (
    f"SELECT cast(d AS date) AS date FROM generate_series(timestamp '{WEB_SPEC.start}', timestamp '{WEB_SPEC.end}', interval 1 day) g(d)"
)


def _filled(part: str, columns: list[str], spine: str = "m_spine") -> str:
    cells = ", ".join(f"coalesce({c}, 0) AS {c}" for c in columns)
    return f"SELECT date, {cells} FROM {spine} LEFT JOIN ({part}) x USING (date)"


def _hot_names(column: str, values: list[str], prefix: str | None = None) -> list[str]:
    return [f"{prefix or column}_{slug(v)}" for v in values]


_ORDER_ATTRIBUTES = ("order_status", "payment_method", "device_type", "order_source")
_ORDERS = (
    "SELECT order_date AS date, count(DISTINCT order_id) AS order_id, count(DISTINCT customer_id) AS customer_id, "
    + ", ".join(_hot(a, getattr(SPEC, a)) for a in _ORDER_ATTRIBUTES) + " FROM r_orders GROUP BY order_date"
)
_ORDER_COLUMNS = ["order_id", "customer_id"] + [n for a in _ORDER_ATTRIBUTES for n in _hot_names(a, getattr(SPEC, a))]
ORACLE_MARTS["m_daily_orders"] = _filled(_ORDERS, _ORDER_COLUMNS)
_RETURNS = f"""SELECT return_date AS date, {big('sum(return_quantity)')} AS total_quantity_return, {money('sum(refund_amount)')} AS total_refund_amount FROM r_returns GROUP BY 1"""
ORACLE_MARTS["m_daily_returns"] = _filled(_RETURNS, ["total_quantity_return", "total_refund_amount"])
ORACLE_MARTS["m_daily_shipments"] = f"""
SELECT date, coalesce(shipped_orders_count, 0) AS shipped_orders_count, coalesce(total_shipping_fee, 0) AS total_shipping_fee,
       coalesce(delivered_orders_count, 0) AS delivered_orders_count
FROM m_spine LEFT JOIN (SELECT ship_date AS date, count(*) AS shipped_orders_count, {money('sum(shipping_fee)')} AS total_shipping_fee FROM r_shipments GROUP BY 1) a USING (date)
LEFT JOIN (SELECT delivery_date AS date, count(*) AS delivered_orders_count FROM r_shipments GROUP BY 1) b USING (date)"""
_PAYMENTS = f"""SELECT order_date AS date, cast(sum(payment_value) AS double) / count(payment_value) AS payment_value,
   sum(installments) / cast(count(installments) AS double) AS installments, {_hot('o.payment_method', SPEC.payment_method, 'payment_method')}
   FROM r_orders o LEFT JOIN r_payments p ON p.order_id = o.order_id GROUP BY order_date"""
ORACLE_MARTS["m_daily_payments"] = _filled(_PAYMENTS, ["payment_value", "installments"])
_REVIEWS = f"""SELECT review_date AS date, count(DISTINCT order_id) AS order_id_reviews, count(DISTINCT customer_id) AS customer_id_reviews,
   count(DISTINCT product_id) AS product_id_reviews, {r6('avg(rating)')} AS rating, {_hot('review_title', SPEC.review_title)} FROM r_reviews GROUP BY 1"""
ORACLE_MARTS["m_daily_reviews"] = _filled(
    _REVIEWS, ["order_id_reviews", "customer_id_reviews", "product_id_reviews", "rating", *_hot_names("review_title", SPEC.review_title)]
)
_CUSTOMER_HOT = [(a, v) for a in ("gender", "age_group", "acquisition_channel") for v in getattr(SPEC, a)]
ORACLE_MARTS["m_daily_customers"] = (
    f"SELECT date, (SELECT count(*) FROM r_customers c WHERE c.signup_date = m_spine.date) AS customer_daily_signup, known.* FROM m_spine, LATERAL ("
    "SELECT count(*) AS customer_cumulative, count(DISTINCT city) AS unique_cities_cumulative, "
    + ", ".join(f"{big(f'''count(*) FILTER ({a} = '{v}')''')} AS {a}_{slug(v)}_cumulative" for a, v in _CUSTOMER_HOT)
    + " FROM r_customers c WHERE c.signup_date < m_spine.date) known"
)
ORACLE_MARTS["m_daily_promotions"] = (
    "SELECT date, cast(count(promo_id) > 0 AS int) AS promo_flag, "
    + r6("coalesce(cast(sum(discount_value) AS double) / count(promo_id), 0)")
    + " AS avg_discount_value, coalesce(max(CASE WHEN min_order_value > 0 THEN 1 ELSE 0 END), 0) AS flag_min_order_value, "
    + ", ".join(f"coalesce(max(CASE WHEN promo_type = '{v}' THEN 1 ELSE 0 END), 0) AS promo_type_{slug(v)}" for v in SPEC.promo_type)
    + " FROM m_spine LEFT JOIN (SELECT * FROM r_promotions WHERE promo_id IN (SELECT promo_id FROM r_order_items)) p ON date BETWEEN start_date AND end_date GROUP BY date"
)
_STOCK_COLUMNS = [*op.INVENTORY_MEASURES, *_hot_names("category", SPEC.category), *_hot_names("segment", SPEC.segment)]
ORACLE_MARTS["m_stock"] = f"""
SELECT snapshot_date, count(DISTINCT product_id) AS unique_products_in_stock, {big('sum(stock_on_hand)')} AS total_stock_on_hand, {big('sum(units_received)')} AS total_units_received,
   {big('sum(units_sold)')} AS total_units_sold, {r6('avg(days_of_supply)')} AS avg_days_of_supply, {r6('avg(fill_rate)')} AS avg_fill_rate,
   {big('sum(stockout_flag)')} AS total_stockout_flags, {big('sum(overstock_flag)')} AS total_overstock_flags, {r6('avg(sell_through_rate)')} AS avg_sell_through_rate,
   {_hot('category', SPEC.category)}, {_hot('segment', SPEC.segment)} FROM r_inventory GROUP BY snapshot_date"""
_AGE = f"date_diff('day', coalesce(snapshot_date, date '{SPEC.start}'), date)"
ORACLE_MARTS["m_daily_inventory"] = (
    f"SELECT date, {_AGE} AS days_since_snapshot, "
    + ", ".join(f"coalesce({c}, 0) AS {c}, {_AGE} AS {c}_gap" for c in _STOCK_COLUMNS)
    + " FROM (SELECT date, max(snapshot_date) AS last FROM m_spine LEFT JOIN m_stock ON snapshot_date < date GROUP BY date) d LEFT JOIN m_stock s ON s.snapshot_date = d.last"
)
_WEB_COLUMNS = ["sessions", "unique_visitors", "page_views", "bounce_rate", "avg_session_duration_sec", *_hot_names("", SPEC.traffic_source, "traffic")]
_WEB = f"""SELECT date, {big('sum(sessions)')} AS sessions, {big('sum(unique_visitors)')} AS unique_visitors, {big('sum(page_views)')} AS page_views, {r6('avg(bounce_rate)')} AS bounce_rate,
   {r6('avg(avg_session_duration_sec)')} AS avg_session_duration_sec, {_hot('traffic_source', SPEC.traffic_source, 'traffic')} FROM r_web_traffic GROUP BY date"""
_SIMULATED = "SELECT w.*, CASE WHEN date < (SELECT min(date) FROM r_web_traffic) THEN 1 ELSE 0 END AS is_web_data_simulated FROM ({part}) w"
ORACLE_MARTS["m_daily_web"] = _SIMULATED.format(part=_filled(_WEB, _WEB_COLUMNS))

PARTS = {
    "daily_returns": ("m_daily_returns", op.daily_returns),
    "daily_orders": ("m_daily_orders", lambda cat, spec: op.on_spine(cat, spec, op.orders_by_day(cat.orders, spec))),
    "daily_shipments": ("m_daily_shipments", op.daily_shipments),
    "daily_reviews": ("m_daily_reviews", op.daily_reviews),
    "daily_customers": ("m_daily_customers", op.daily_customers),
    "daily_promotions": ("m_daily_promotions", lambda cat, spec: op.daily_promotions(op.promotions_in_use(cat), spec)),
    "daily_inventory": ("m_daily_inventory", op.daily_inventory),
}


def _register(name: str, mart: str, build) -> None:
    @query(name, f"SELECT * FROM {mart}")
    def _(cat):
        return shown(build(cat, SPEC))


for _name, (_mart, _build) in PARTS.items():
    _register(_name, _mart, _build)


@query("daily_payments", _filled(_PAYMENTS, ["payment_value", "installments", *_hot_names("payment_method", SPEC.payment_method)]))
def _(cat):
    return shown(op.on_spine(cat, SPEC, op.payments_by_day(cat.orders, cat.payments, SPEC)), EXACT)


@query("daily_web", _SIMULATED.format(part=_filled(_WEB, _WEB_COLUMNS, "m_web_spine")))
def _(cat):
    return shown(op.daily_web(cat, WEB_SPEC))


@query(
    "order_items_summary",
    f"""SELECT order_id, {big('sum(quantity)')} AS total_quantity_order_items, count(DISTINCT product_id) AS unique_products_count,
               cast(sum(discount_amount) AS double) / count(discount_amount) AS avg_discount_amount, max(CASE WHEN promo_id IS NOT NULL THEN 1 ELSE 0 END) AS has_promo_id
        FROM r_order_items GROUP BY order_id""",
)
def _(cat):
    return shown(op.order_items_summary(cat.order_items), EXACT)


@query("daily_master", "SELECT * FROM m_daily_customers JOIN m_daily_promotions USING (date)")
def _(cat):
    return shown(op.daily_master(op.promotions_in_use(cat), SPEC))


_FACTS = """SELECT * FROM m_daily_orders JOIN m_daily_payments USING (date) JOIN m_daily_returns USING (date) JOIN m_daily_shipments USING (date)
    JOIN m_daily_reviews USING (date) JOIN (SELECT date, coalesce("Revenue", 0) AS "Revenue", coalesce("COGS", 0) AS "COGS" FROM m_spine
    LEFT JOIN (SELECT Date AS date, cast(round(Revenue, 2) AS double) AS "Revenue", cast(round(COGS, 2) AS double) AS "COGS" FROM r_sales) s USING (date)) sales USING (date)"""


_PROCESSED = _FACTS + " JOIN m_daily_customers USING (date) JOIN m_daily_promotions USING (date) JOIN m_daily_inventory USING (date) JOIN m_daily_web USING (date)"


ORACLE_MARTS["m_processed"] = _PROCESSED
ORACLE_MARTS["m_daily_sales"] = "SELECT date, \"Revenue\", \"COGS\" FROM m_processed"
# Every column of the daily table as (date, f, v) rows; the names come from the table.
ORACLE_MARTS["m_daily_values"] = """SELECT date, f, v FROM (
  UNPIVOT (SELECT date, CAST(COLUMNS(* EXCLUDE (date)) AS DOUBLE) FROM m_processed) ON COLUMNS(* EXCLUDE (date)) INTO NAME f VALUE v) u"""

# Sources of the daily table: the mart of the oracle, and a function from the catalogue to a table with the source's columns.
SOURCES = {
    "orders": ("m_daily_orders", lambda cat: op.orders_by_day(cat.orders, SPEC)),
    "payments": ("m_daily_payments", lambda cat: op.payments_by_day(cat.orders, cat.payments, SPEC).select("date", "payment_value", "installments")),
    "returns": ("m_daily_returns", lambda cat: op.returns_by_day(cat.returns)),
    "shipments": ("m_daily_shipments", lambda cat: op.daily_shipments(cat, SPEC)),
    "reviews": ("m_daily_reviews", lambda cat: op.reviews_by_day(cat.reviews, SPEC)),
    "sales": ("m_daily_sales", lambda cat: cat.sales.select("Revenue", "COGS")),
    "customers": ("m_daily_customers", lambda cat: op.daily_customers(cat, SPEC)),
    "promotions": ("m_daily_promotions", lambda cat: op.daily_promotions(cat, SPEC)),
    "inventory": ("m_daily_inventory", lambda cat: op.daily_inventory(cat, SPEC)),
    "web": ("m_daily_web", lambda cat: op.daily_web(cat, SPEC)),
}


def source_columns(cat) -> dict[str, list[str]]:
    """Columns of the daily table by source, taken from the sources' schemas."""
    return {name: [c for c in build(cat).columns if c != "date"] for name, (_, build) in SOURCES.items()}


# What nearly every source of the daily table is derived from: computed once, so the raw lines are scanned once.
SHARED = ("orders", "order_items")


def daily_table(cat):
    """The daily table as the queries show it, computed once."""
    return materialise(shown(op.processed_daily(op.promotions_in_use(cat.kept(*SHARED)), SPEC), EXACT))


@query("processed_daily", _PROCESSED)
def _(cat):
    return shown(op.processed_daily(op.promotions_in_use(cat.kept(*SHARED)), SPEC), EXACT)


@query("processed_daily_legacy", _FACTS + " JOIN m_daily_inventory USING (date) JOIN m_daily_web USING (date)")
def _(cat):
    return shown(op.processed_daily(cat.kept(*SHARED), SPEC, legacy=True), EXACT)


def _model_features() -> str:
    label = "ln(1 + greatest(\"Revenue\", 0))"
    lags = [f"lag(label, {k}) OVER d AS label_lag{k}" for k in models.TARGET_LAGS]
    means = [
        f"CASE WHEN count(label) OVER (ORDER BY date ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING) = {w} "
        f"THEN avg(label) OVER (ORDER BY date ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING) END AS label_mean{w}"
        for w in models.TARGET_WINDOWS
    ]
    drivers = [f"lag({d}, {k}) OVER d AS {d}_lag{k}" for d in models.DRIVERS for k in models.DRIVER_LAGS]
    yoy = "cast(sessions AS double) / nullif(lag(sessions, 364) OVER d, 0) - 1 AS sessions_yoy"
    left_out = [f'"{c}"' for c in models.LEAKY_COLUMNS]
    left_out += [c for c in models.NOISE_COLUMNS if c in _WEB_COLUMNS]
    made = f"SELECT *, {', '.join([*lags, *means, *drivers, yoy])} FROM (SELECT *, {label} AS label FROM (%s) p) q WINDOW d AS (ORDER BY date)"
    rounded = ", ".join(r6(c) + f" AS {c}" for c in ["label", *[f"label_lag{k}" for k in models.TARGET_LAGS], *[f"label_mean{w}" for w in models.TARGET_WINDOWS], "sessions_yoy"])
    return f"SELECT * EXCLUDE ({', '.join(left_out)}) REPLACE ({rounded}) FROM ({made % _PROCESSED}) f"


@query("model_features", _model_features())
def _(cat):
    return shown(models.engineer_features(daily_table(cat)), EXACT)
