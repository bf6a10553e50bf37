"""Queries for calendar and time-series features."""

from pyspark.sql import functions as F

from tallyshop.functions import calendar as cal
from tallyshop.functions.columns import dbl, shown
from tallyshop.operators import decomposition
from tallyshop.operators import features as op
from tallyshop.operators.daily import daily_inventory
from tallyshop.plans.daily import SPEC
from tallyshop.plans.registry import ORACLE_MARTS, query, r6

# Lunar new year days of the years the test data covers.
LUNAR = ("1995-01-31", "1996-02-19", "1997-02-07", "1998-01-28", "1999-02-16", "2000-02-05", "2001-01-24", "2002-02-12")
HOLIDAYS = cal.holiday_days(range(1995, 2002), LUNAR, ())

ORACLE_MARTS["m_series"] = """
SELECT series_id, date, coalesce(revenue, 0) AS revenue, coalesce(cogs, 0) AS cogs, coalesce(units, 0) AS units, coalesce(lines, 0) AS lines
FROM (SELECT series_id, cast(unnest(generate_series(lo, hi, interval 1 day)) AS date) AS date
      FROM (SELECT category AS series_id, min(order_date) AS lo, max(order_date) AS hi FROM m_item GROUP BY category) b) d
LEFT JOIN (SELECT category AS series_id, order_date AS date, cast(sum(net_value) AS double) AS revenue, cast(sum(cogs_total) AS double) AS cogs,
                  cast(sum(quantity) AS bigint) AS units, count(*) AS lines FROM m_item GROUP BY ALL) s USING (series_id, date)
"""
ORACLE_MARTS["m_total"] = """
SELECT g.date AS date, coalesce(cast(Revenue AS double), 0) AS revenue, coalesce(cast(COGS AS double), 0) AS cogs
FROM (SELECT cast(unnest(generate_series(lo, hi, interval 1 day)) AS date) AS date FROM (SELECT min(Date) AS lo, max(Date) AS hi FROM r_sales) b) g
LEFT JOIN r_sales s ON s.Date = g.date
"""
_W = "OVER (PARTITION BY series_id ORDER BY date {f})"


def _rows(low: int, high: int) -> str:
    """Frame of a gap-free series; bounds are offsets in days (= rows)."""
    def bound(n: int) -> str:
        return f"{abs(n)} {'PRECEDING' if n <= 0 else 'FOLLOWING'}"

    return _W.format(f=f"ROWS BETWEEN {bound(low)} AND {bound(high)}")


@query("daily_series", f"SELECT series_id, date, {r6('revenue')} AS revenue, {r6('cogs')} AS cogs, units, lines FROM m_series")
def _(cat):
    return shown(op.daily_series(cat))


def _days(cat):
    return cat.sales.select(F.col("Date").alias("date"))


_ME = "date_diff('day', d, last_day(d))"
_QE = "date_diff('day', d, last_day(make_date(cast(year(d) AS int), cast(quarter(d) * 3 AS int), 1)))"
_B = "CASE WHEN {0} THEN 1 ELSE 0 END"


@query(
    "calendar_features",
    f"""SELECT d AS date, isodow(d) - 1 AS dow, day(d) AS dom, month(d) AS month, quarter(d) AS quarter, year(d) AS year, week(d) AS woy, dayofyear(d) AS doy, dayname(d) AS day_name,
       {_B.format('isodow(d) >= 6')} AS is_weekend, {_B.format(f'{_ME} = 0')} AS is_month_end, {_B.format('day(d) = 1')} AS is_month_start, {_ME} AS days_to_month_end,
       {_B.format(f'{_ME} <= 2')} AS is_last3_days, {_B.format(f'{_ME} <= 6')} AS is_last7_days, {_QE} AS days_to_quarter_end, {_B.format(f'{_QE} <= 2')} AS is_last3_quarter,
       {r6('day(d) / cast(day(last_day(d)) AS double)')} AS dom_ratio, {r6('(day(d) - 1) / cast(day(last_day(d)) - 1 AS double)')} AS dom_position,
       {_B.format('month(d) IN (4, 5, 6)')} AS is_peak_season, {_B.format('month(d) IN (11, 12, 1)')} AS is_low_season, {_B.format('month(d) IN (3, 6, 9, 12)')} AS is_quarter_end_month,
       {_B.format('(month(d) = 12 AND day(d) >= 20) OR (month(d) = 1 AND day(d) <= 5)')} AS is_year_end_window, {_B.format('(month(d) = 1 AND day(d) >= 20) OR (month(d) = 2 AND day(d) <= 20)')} AS is_lunar_window
       FROM (SELECT Date AS d FROM r_sales) x""",
)
def _(cat):
    return shown(_days(cat).withColumns(cal.calendar_features("date")))


_PI = "2 * pi()"
_CYCLIC = {
    "month_sin": f"sin({_PI} * month(d) / 12)", "month_cos": f"cos({_PI} * month(d) / 12)",
    "dow_sin": f"sin({_PI} * (isodow(d) - 1) / 7)", "dow_cos": f"cos({_PI} * (isodow(d) - 1) / 7)",
}
_FOURIER = {
    **{f"year_{n}{k}": f"{n}({_PI} * {k} * dayofyear(d) / 365.25::double)" for k in range(1, 11) for n in ("sin", "cos")},
    **{f"week_{n}{k}": f"{n}({_PI} * {k} * (isodow(d) - 1) / 7)" for k in range(1, 4) for n in ("sin", "cos")},
}


@query("fourier_features", "SELECT d AS date, " + ", ".join(f"{r6(e)} AS {n}" for n, e in {**_CYCLIC, **_FOURIER}.items()) + " FROM (SELECT Date AS d FROM r_sales) x")
def _(cat):
    return shown(_days(cat).withColumns({**cal.cyclic_features("date"), **cal.fourier_features("date", 10, 3)}))


def _dates(days) -> str:
    return "[" + ", ".join(f"date '{d}'" for d in days) + "]"


_GAP = f"(SELECT date_diff('day', h, d) FROM unnest({_dates(LUNAR)}) u(h) ORDER BY abs(date_diff('day', h, d)), h LIMIT 1)"


@query(
    "lunar_features",
    f"""SELECT d AS date, g AS days_to_lunar, {_B.format('abs(g) <= 7')} AS is_lunar_week, {_B.format('abs(g) <= 30')} AS is_lunar_month, {_B.format('g >= -14 AND g < 0')} AS is_pre_lunar2w,
               {_B.format('g > 0 AND g <= 7')} AS is_post_lunar1w, {r6('exp(-0.5 * pow(g / 7.0::double, 2))')} AS lunar_proximity
        FROM (SELECT d, {_GAP} AS g FROM (SELECT Date AS d FROM r_sales) x) y""",
)
def _(cat):
    return shown(_days(cat).withColumns(cal.lunar_features("date", LUNAR)))


def _holiday_within(low: int, high: int) -> str:
    return _B.format(f"len(list_filter({_dates(HOLIDAYS)}, lambda h: date_diff('day', d, h) BETWEEN {low} AND {high})) > 0")


@query(
    "holiday_features",
    f"""SELECT d AS date, {_B.format("strftime(d, '%m-%d') IN (" + ", ".join(f"'{m}'" for m in (*cal.FIXED_HOLIDAYS, *cal.LUNAR_CLUSTER)) + ")")} AS is_fixed_holiday,
               list_min(list_transform({_dates(HOLIDAYS)}, lambda h: abs(date_diff('day', h, d)))) AS days_to_holiday,
               {_holiday_within(-2, 2)} AS is_holiday_window, {_holiday_within(1, 5)} AS pre_holiday, {_holiday_within(-3, -1)} AS post_holiday
        FROM (SELECT Date AS d FROM r_sales) x""",
)
def _(cat):
    return shown(_days(cat).withColumns(cal.holiday_features("date", HOLIDAYS, ())))


@query(
    "trend_features",
    f"""SELECT Date AS date, date_diff('day', date '1998-01-01', least(Date, date '2000-12-31')) AS trend_days,
               {r6("date_diff('day', date '1998-01-01', least(Date, date '2000-12-31')) / 1826.0::double")} AS trend_norm FROM r_sales""",
)
def _(cat):
    return shown(_days(cat).withColumns(cal.trend_features("date", "1998-01-01", freeze="2000-12-31")))


_LAGS = [1, 2, 3, 7, 14, 28, 30, 60, 90, 180, 364, 365]


@query(
    "lag_features",
    "SELECT series_id, date, " + ", ".join(f"{r6(f'lag(revenue, {k}) ' + _W.format(f=''))} AS revenue_lag{k}" for k in _LAGS) + " FROM m_series",
)
def _(cat):
    series = op.daily_series(cat)
    return shown(series.select("series_id", "date", *[c.alias(n) for n, c in op.lag_features("revenue", _LAGS).items()]))


_WINDOWS = [3, 7, 30, 90]
_STATS = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}


@query(
    "rolling_features",
    "SELECT series_id, date, "
    + ", ".join(
        f"{r6(f'CASE WHEN count(units) {_rows(-w, -1)} = {w} THEN {fn}(units) {_rows(-w, -1)} END')} AS units_r{s}{w}"
        for w in _WINDOWS for s, fn in _STATS.items()
    )
    + " FROM m_series",
)
def _(cat):
    columns = op.rolling_features("units", _WINDOWS, tuple(_STATS))
    return shown(op.daily_series(cat).select("series_id", "date", *[c.alias(n) for n, c in columns.items()]))


@query(
    "centred_year_ago",
    f"""SELECT series_id, date, {r6(f'avg(units) {_rows(-367, -361)}')} AS near, {r6(f'CASE WHEN count(units) {_rows(-371, -357)} >= 5 THEN avg(units) {_rows(-371, -357)} END')} AS wide,
               {r6(f'avg(units) {_rows(-735, -721)}')} AS two_years FROM m_series""",
)
def _(cat):
    columns = {"near": op.centred_year_ago("units"), "wide": op.centred_year_ago("units", 364, 7, 5), "two_years": op.centred_year_ago("units", 728, 7)}
    return shown(op.daily_series(cat).select("series_id", "date", *[c.alias(n) for n, c in columns.items()]))


def _nearest(rank: str) -> str:
    return f"""(SELECT h.v FROM k h WHERE h.d BETWEEN cast(t.d - interval 371 day AS date) AND cast(t.d - interval 357 day AS date) ORDER BY {rank} LIMIT 1)"""


_BACK = "date_diff('day', h.d, cast(t.d - interval 364 day AS date))"


@query(
    "lag_nearest",
    f"""WITH k AS (SELECT Date AS d, cast(Revenue AS double) AS v FROM r_sales)
        SELECT t.d AS date, {r6(_nearest(f'CASE WHEN {_BACK} >= 0 THEN {_BACK} ELSE 7 - {_BACK} END'))} AS farther_first,
               {r6(_nearest(f'abs({_BACK}) * 2 + CASE WHEN {_BACK} < 0 THEN 1 ELSE 0 END'))} AS alternating FROM k t""",
)
def _(cat):
    gappy = cat.sales.select(F.lit("all").alias("series_id"), F.col("Date").alias("date"), dbl("Revenue").alias("v"))
    return shown(
        gappy.select("date", op.lag_nearest("v", 364).alias("farther_first"), op.lag_nearest("v", 364, alternate=True).alias("alternating"))
    )


@query(
    "lag_chain",
    f"""SELECT series_id, date, {r6(f'coalesce(lag(units, 364) {_W.format(f="")}, lag(units, 728) {_W.format(f="")}, m)')} AS units_chain
        FROM m_series JOIN (SELECT series_id, median(units) AS m FROM m_series GROUP BY series_id) x USING (series_id)""",
)
def _(cat):
    return shown(op.lag_chain(op.daily_series(cat), "units").select("series_id", "date", dbl("units_chain").alias("units_chain")))


@query(
    "date_lag_join",
    f"SELECT a.series_id, a.date, {r6('b.revenue')} AS year_ago FROM m_series a LEFT JOIN m_series b ON b.series_id = a.series_id AND b.date = cast(a.date - interval 364 day AS date)",
)
def _(cat):
    return shown(op.date_lag_join(op.daily_series(cat), "revenue", 364, "year_ago").select("series_id", "date", "year_ago"))


_SHIFT = "CASE WHEN count(l) {w} >= 5 THEN avg(l) {w} END"


@query(
    "exog_year_shift",
    f"""SELECT series_id, date, {r6(f"coalesce({_SHIFT.format(w=_rows(-371, -357))}, {_SHIFT.format(w=_rows(-735, -721))}, m)")} AS lines_year_shift
        FROM (SELECT *, ln(1 + greatest(lines, 0)) AS l FROM m_series) x JOIN (SELECT series_id, median(ln(1 + greatest(lines, 0))) AS m FROM m_series GROUP BY series_id) y USING (series_id)""",
)
def _(cat):
    return shown(op.exog_year_shift(op.daily_series(cat), "lines").select("series_id", "date", "lines_year_shift"))


@query(
    "year_over_year_log",
    f"SELECT series_id, date, {r6(f'ln(1 + lines) - ln(1 + lag(lines, 364) {_W.format(f=str())})')} AS lines_yoy FROM m_series",
)
def _(cat):
    return shown(op.daily_series(cat).select("series_id", "date", op.year_over_year_log("lines").alias("lines_yoy")))


_YEARS = "(SELECT series_id, year(date) AS y, avg(units) AS m FROM m_series GROUP BY ALL)"


@query(
    "completed_year_growth",
    f"""SELECT s.series_id, s.date, {r6('coalesce(g, 1.0)')} AS annual_growth FROM m_series s LEFT JOIN (
          SELECT series_id, y + 1 AS y, coalesce(m / lag(m) OVER (PARTITION BY series_id ORDER BY y), 1.0) AS g FROM {_YEARS} q) k ON k.series_id = s.series_id AND k.y = year(s.date)""",
)
def _(cat):
    return shown(op.completed_year_growth(op.daily_series(cat), "units").select("series_id", "date", "annual_growth"))


@query(
    "yearly_growth",
    f"""SELECT series_id, y AS year, t AS total, {r6('t / cast(lag(t) OVER (PARTITION BY series_id ORDER BY y) AS double) - 1')} AS growth
        FROM (SELECT series_id, year(date) AS y, cast(sum(units) AS bigint) AS t FROM m_series GROUP BY ALL) x""",
)
def _(cat):
    return shown(op.yearly_growth(op.daily_series(cat), "units"))


@query(
    "trend_residual",
    f"""SELECT series_id, date, {r6('r')} AS units_resid, {r6(f'lag(r, 7) {_W.format(f="")}')} AS units_resid_lag7,
               {r6(f'CASE WHEN count(r) {_rows(-7, -1)} = 7 THEN avg(r) {_rows(-7, -1)} END')} AS units_resid_rmean7
        FROM (SELECT series_id, date, units - (a * i + b) AS r FROM (SELECT *, date_diff('day', min(date) OVER (PARTITION BY series_id), date) AS i FROM m_series) x
              JOIN (SELECT series_id, regr_slope(units, i) AS a, regr_intercept(units, i) AS b
                    FROM (SELECT *, date_diff('day', min(date) OVER (PARTITION BY series_id), date) AS i FROM m_series) y WHERE date < date '2000-01-01' GROUP BY series_id) f USING (series_id)) z""",
)
def _(cat):
    out = op.trend_residual(op.daily_series(cat), "units", "2000-01-01")
    return shown(out.select("series_id", "date", "units_resid", "units_resid_lag7", "units_resid_rmean7"))


@query(
    "winsorize",
    """SELECT series_id, date, greatest(lo, least(hi, units)) AS units_winsorized FROM m_series JOIN (
         SELECT series_id, max(units) FILTER (rn = k + 1) AS lo, max(units) FILTER (rn = n - k) AS hi FROM (
           SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY units, date) AS rn, count(*) OVER (PARTITION BY series_id) AS n,
                  cast(floor(count(*) OVER (PARTITION BY series_id) * 0.02::double) AS bigint) AS k FROM m_series) x GROUP BY series_id) b USING (series_id)""",
)
def _(cat):
    return op.winsorize(op.daily_series(cat), "units", 0.02).select("series_id", "date", "units_winsorized")


_POSITION = "(epoch(date) / 86400 - min(epoch(date) / 86400) OVER w) / (max(epoch(date) / 86400) OVER w - min(epoch(date) / 86400) OVER w + 1e-9)"


@query(
    "sample_weights",
    f"""SELECT series_id, date, {r6('1 + 4 * (raw - min(raw) OVER v) / (max(raw) OVER v - min(raw) OVER v + 1e-9)')} AS weight,
               {r6('CASE year(date) WHEN 1999 THEN 2.0 WHEN 2000 THEN 3.0 WHEN 2001 THEN 4.0 ELSE 1.0 END')} AS year_weight,
               {r6("exp(-date_diff('day', date, (SELECT max(date) FROM m_series)) * ln(2) / (2.5::double * 365.25::double))")} AS half_life_weight
        FROM (SELECT series_id, date, exp(3 * {_POSITION}) * CASE WHEN year(date) >= 2000 THEN 3.0 WHEN year(date) >= 1998 THEN 2.0 ELSE 1.0 END AS raw
              FROM m_series WINDOW w AS (PARTITION BY series_id)) x WINDOW v AS (PARTITION BY series_id)""",
)
def _(cat):
    series = op.daily_series(cat)
    newest = series.agg(F.max("date").alias("d")).scalar()
    weighted = op.recency_weights(series, eras=((1998, 2.0), (2000, 3.0)))
    return shown(
        weighted.select(
            "series_id", "date", "weight", op.year_weight("date", {1999: 2.0, 2000: 3.0, 2001: 4.0}).alias("year_weight"),
            op.half_life_weight("date", newest).alias("half_life_weight"),
        )
    )


@query("snapshot_weight", f"SELECT date, {r6('exp(-days_since_snapshot / 30.0::double)')} AS snapshot_weight FROM m_daily_inventory")
def _(cat):
    return shown(daily_inventory(cat, SPEC).select("date", op.snapshot_weight("days_since_snapshot").alias("snapshot_weight")))


@query(
    "time_split",
    """SELECT series_id, CASE WHEN date < date '2000-01-01' THEN 'train' WHEN date < date '2001-01-01' THEN 'valid' ELSE 'test' END AS split, count(*) AS days FROM m_series GROUP BY ALL""",
)
def _(cat):
    split = op.time_split("date", "2000-01-01", "2001-01-01")
    return op.daily_series(cat).groupBy("series_id", split.alias("split")).agg(F.count("*").alias("days"))


@query(
    "time_series_folds",
    """WITH d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM m_series) x),
         f AS (SELECT *, cast(floor(n / 6.0::double) AS bigint) AS z FROM d, (SELECT unnest([0, 1, 2, 3, 4]) AS fold) k),
         r AS (SELECT *, CASE WHEN i >= n - 5 * z + fold * z AND i < n - 5 * z + (fold + 1) * z THEN 'v' WHEN i < n - 5 * z + fold * z - 30 THEN 't' END AS role FROM f)
       SELECT fold, min(date) FILTER (role = 't') AS train_from, max(date) FILTER (role = 't') AS train_to, min(date) FILTER (role = 'v') AS valid_from, max(date) FILTER (role = 'v') AS valid_to,
              count(*) FILTER (role = 't') AS train_days, count(*) FILTER (role = 'v') AS valid_days FROM r GROUP BY fold""",
)
def _(cat):
    return op.fold_bounds(op.daily_series(cat), 5, 30)


@query(
    "walk_forward",
    """SELECT cutoff, role, count(*) AS rows FROM (SELECT cutoff, CASE WHEN date <= cutoff THEN 'train' WHEN date_diff('day', cutoff, date) <= 365 THEN 'valid' END AS role
       FROM m_series, (SELECT unnest([date '1997-12-31', date '1998-12-31', date '1999-12-31', date '2000-12-31']) AS cutoff) c) x WHERE role IS NOT NULL GROUP BY ALL""",
)
def _(cat):
    cutoffs = ("1997-12-31", "1998-12-31", "1999-12-31", "2000-12-31")
    return op.walk_forward(op.daily_series(cat), cutoffs).groupBy("cutoff", "role").agg(F.count("*").alias("rows"))


@query(
    "linear_interpolate",
    f"""WITH k AS (SELECT date, CASE WHEN revenue > 0 THEN revenue END AS v FROM m_total),
          n AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN date END) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS ld, min(CASE WHEN v IS NOT NULL THEN date END) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rd FROM k)
        SELECT n.date AS date, {r6("coalesce(n.v, l.v + (r.v - l.v) * (date_diff('day', ld, n.date) / cast(date_diff('day', ld, rd) AS double)), l.v)")} AS revenue FROM n LEFT JOIN k l ON l.date = ld LEFT JOIN k r ON r.date = rd""",
)
def _(cat):
    from tallyshop.functions.spine import linear_interpolate

    gappy = op.total_series(cat).select("date", F.when(F.col("revenue") > 0, F.col("revenue")).alias("revenue"))
    return shown(linear_interpolate(gappy, "revenue", "date"))


@query(
    "seasonal_strengths",
    f"""WITH t AS (SELECT *, CASE WHEN count(units) {_rows(-182, 182)} = 365 THEN avg(units) {_rows(-182, 182)} END AS tr FROM m_series),
          s AS (SELECT *, avg(units - tr) OVER (PARTITION BY series_id, dayofyear(date)) AS se FROM t)
        SELECT series_id, {r6('stddev_samp(tr) / stddev_samp(units)')} AS trend_strength, {r6('stddev_samp(se) / stddev_samp(units)')} AS seasonal_strength,
               {r6('stddev_samp(units - tr - se) / stddev_samp(units)')} AS residual_strength FROM s GROUP BY series_id""",
)
def _(cat):
    from tallyshop.operators.statistics import seasonal_strengths

    return shown(seasonal_strengths(op.daily_series(cat), "units"))


@query(
    "chart_aggregates",
    """SELECT 'month' AS grain, month(Date) AS bucket, count(*) AS days, cast(sum(Revenue) AS double) / count(*) AS avg_revenue, round(quantile_cont(cast(Revenue AS double), 0.5), 6) AS median_revenue FROM r_sales GROUP BY ALL
       UNION ALL SELECT 'weekday', isodow(Date) - 1, count(*), cast(sum(Revenue) AS double) / count(*), round(quantile_cont(cast(Revenue AS double), 0.5), 6) FROM r_sales GROUP BY ALL
       UNION ALL SELECT 'year', year(Date), count(*), cast(sum(Revenue) AS double) / count(*), round(quantile_cont(cast(Revenue AS double), 0.5), 6) FROM r_sales GROUP BY ALL""",
)
def _(cat):
    from tallyshop.functions.columns import mean_exact, r6 as r6_col

    grains = F.array(*[F.struct(F.lit(n).alias("grain"), c.alias("bucket")) for n, c in (("month", F.month("Date")), ("weekday", F.weekday("Date")), ("year", F.year("Date")))])
    return cat.sales.select("Revenue", F.inline(grains)).groupBy("grain", "bucket").agg(
        F.count("*").alias("days"), mean_exact("Revenue").alias("avg_revenue"), r6_col(F.median(dbl("Revenue"))).alias("median_revenue")
    )  # one row per calendar day goes in


@query("stl_strengths")
def _(cat):
    return shown(decomposition.strengths(decomposition.decompose(op.daily_series(cat), "revenue")))


@query(
    "stl_calendar",
    f"""SELECT series_id, min(date) AS first_day, max(date) AS last_day, count(*) AS days, {r6('avg(revenue)')} AS mean_value, {r6('avg(revenue)')} AS mean_of_parts, count(*) AS days_that_add_up FROM m_series GROUP BY series_id""",
)
def _(cat):
    """The decomposition covers the calendar, and its parts add up to the series."""
    parts = decomposition.decompose(op.daily_series(cat), "revenue")
    total = F.col("trend") + F.col("seasonal") + F.col("residual")
    return shown(parts.groupBy("series_id").agg(
        F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.count("*").alias("days"), F.avg("value").alias("mean_value"),
        F.avg(total).alias("mean_of_parts"), F.count_if(F.abs(total - F.col("value")) < 1e-6).alias("days_that_add_up"),
    ))
