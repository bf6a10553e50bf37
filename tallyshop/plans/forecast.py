"""Queries for forecasts without a fitted ML model, guards and accuracy."""

from pyspark.sql import functions as F

from tallyshop.functions.columns import shown
from tallyshop.operators import features, forecast
from tallyshop.plans.registry import ORACLE_MARTS, money, query, r6
from tallyshop.sources.tables import submission_rows

ORACLE_MARTS["m_future"] = """
SELECT series_id, cast(unnest(generate_series(last + interval 1 day, last + interval 548 day, interval 1 day)) AS date) AS date
FROM (SELECT series_id, max(date) AS last FROM m_series GROUP BY series_id) x
"""
ORACLE_MARTS["m_growth"] = """
SELECT series_id, exp(avg(ln(t / p))) AS growth, max(CASE WHEN y = 2000 THEN t END) / 365 AS base
FROM (SELECT *, lag(t) OVER (PARTITION BY series_id ORDER BY y) AS p FROM (SELECT series_id, year(date) AS y, sum(revenue) AS t FROM m_series WHERE year(date) BETWEEN 1995 AND 2000 GROUP BY ALL) a) b
GROUP BY series_id
"""
ORACLE_MARTS["m_profile"] = """
SELECT series_id, month(date) AS m, day(date) AS d, avg(norm) AS factor
FROM (SELECT *, revenue / avg(revenue) OVER (PARTITION BY series_id, year(date)) AS norm FROM m_series) x GROUP BY ALL
"""


def _growth_forecast(dates: str) -> str:
    return f"""SELECT f.series_id, f.date, base * pow(growth, year(f.date) - 2000) * coalesce(factor, 1.0) AS forecast FROM {dates} f
               JOIN m_growth g ON g.series_id = f.series_id LEFT JOIN m_profile p ON p.series_id = f.series_id AND p.m = month(f.date) AND p.d = day(f.date)"""


def _split(cat):
    """The category series and the 548 days after them."""
    series = features.daily_series(cat)
    return series, forecast.horizon(series, 548)


@query("seasonal_growth_baseline", f"SELECT series_id, date, {r6('forecast')} AS forecast FROM ({_growth_forecast('m_future')}) x")
def _(cat):
    series, future = _split(cat)
    return shown(forecast.seasonal_growth_forecast(series, future, "revenue", 1995, 2000))


@query(
    "baseline_mape",
    f"""SELECT s.series_id, count(*) AS n, {r6('avg(abs(revenue - forecast))')} AS mae, {r6('avg(abs(revenue - forecast) / nullif(revenue, 0)) * 100')} AS mape
        FROM m_series s JOIN ({_growth_forecast("(SELECT * FROM m_series WHERE year(date) IN (1999, 2000))")}) f ON f.series_id = s.series_id AND f.date = s.date GROUP BY s.series_id""",
)
def _(cat):
    series = features.daily_series(cat)
    recent = series.where(F.year("date").isin(1999, 2000))
    fitted = forecast.seasonal_growth_forecast(series, recent, "revenue", 1995, 2000)
    both = recent.join(fitted, ["series_id", "date"])
    return shown(forecast.forecast_metrics(both, "revenue", "forecast", "series_id").select("series_id", "n", "mae", "mape"))


@query(
    "seasonal_naive",
    f"""SELECT f.series_id, f.date, {r6('s.revenue')} AS forecast FROM m_future f JOIN (SELECT series_id, max(date) AS last FROM m_series GROUP BY 1) l ON l.series_id = f.series_id
        LEFT JOIN m_series s ON s.series_id = f.series_id AND s.date = cast(f.date - cast(greatest(ceil(date_diff('day', last, f.date) / 365.0::double), 1) AS int) * 365 * interval 1 day AS date)""",
)
def _(cat):
    series, future = _split(cat)
    return shown(forecast.seasonal_naive(series, future, "revenue"))


_DIRECT = [1, 7, 30, 365]


def _direct_source(lag: str) -> str:
    return f"cast(f.date - {lag} * interval 1 day - CASE WHEN cast(f.date - {lag} * interval 1 day AS date) >= fst THEN interval 365 day ELSE interval 0 day END AS date)"


@query(
    "direct_lag_features",
    "SELECT f.series_id, f.date, "
    + ", ".join(f"{r6(f'coalesce(s{k}.revenue, 0)')} AS revenue_lag{k}" for k in _DIRECT)
    + " FROM m_future f JOIN (SELECT series_id, min(date) AS fst FROM m_future GROUP BY 1) m ON m.series_id = f.series_id "
    + " ".join(f"LEFT JOIN m_series s{k} ON s{k}.series_id = f.series_id AND s{k}.date = {_direct_source(str(k))}" for k in _DIRECT),
)
def _(cat):
    series, future = _split(cat)
    return shown(forecast.direct_lag_features(series, future, "revenue", _DIRECT))


@query(
    "direct_rolling_features",
    f"""SELECT f.series_id, f.date, """
    + ", ".join(f"{r6(f'{fn}(coalesce(s.units, 0)) FILTER (k <= {w})')} AS units_r{n}{w}" for w in (7, 30) for n, fn in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")))
    + f""" FROM m_future f JOIN (SELECT series_id, min(date) AS fst FROM m_future GROUP BY 1) m ON m.series_id = f.series_id CROSS JOIN (SELECT unnest(range(1, 31)) AS k) q
        LEFT JOIN m_series s ON s.series_id = f.series_id AND s.date = {_direct_source('k')} GROUP BY f.series_id, f.date""",
)
def _(cat):
    series, future = _split(cat)
    series = series.withColumn("units", F.col("units").cast("double"))
    return shown(forecast.direct_rolling_features(series, future, "units", [7, 30]))


@query(
    "frozen_drivers",
    "SELECT f.series_id, f.date, units, lines FROM m_future f JOIN (SELECT series_id, arg_max(units, date) AS units, arg_max(lines, date) AS lines FROM m_series GROUP BY 1) l ON l.series_id = f.series_id",
)
def _(cat):
    series, future = _split(cat)
    return forecast.frozen_drivers(series, future, ["units", "lines"])


_FIT = """(SELECT series_id, regr_slope(y, x) AS slope, regr_intercept(y, x) AS b, regr_r2(y, x) AS r2 FROM (
  SELECT series_id, ln(greatest(revenue, 1)) AS y, cast(date_diff('day', date '1998-01-01', date) AS double) AS x FROM m_series WHERE date >= date '1998-01-01') p GROUP BY series_id)"""


@query(
    "trend_decay",
    f"""SELECT series_id, round(slope, 9) AS slope, {r6('b')} AS intercept, {r6('r2')} AS r2, {r6('exp(slope * 30.44::double)')} AS monthly_factor, {r6('exp(slope * 365.25::double)')} AS annual_factor FROM {_FIT} x""",
)
def _(cat):
    decay = forecast.trend_decay(features.daily_series(cat), "revenue", "1998-01-01")
    return shown(decay.withColumn("slope", F.round("slope", 9)), ("slope",))


@query(
    "decayed_naive_forecast",
    f"""SELECT f.series_id, f.date, round(least(greatest(s.revenue * exp(slope * date_diff('day', last, f.date)), 0), 1.2::double * cap), 0) AS forecast
        FROM m_future f JOIN (SELECT series_id, max(date) AS last, quantile_cont(revenue, 0.95) AS cap FROM m_series GROUP BY 1) l ON l.series_id = f.series_id JOIN {_FIT} d ON d.series_id = f.series_id
        LEFT JOIN m_series s ON s.series_id = f.series_id AND s.date = cast(f.date - cast(greatest(ceil(date_diff('day', last, f.date) / 365.0::double), 1) AS int) * 365 * interval 1 day AS date)""",
)
def _(cat):
    series, future = _split(cat)
    naive = forecast.seasonal_naive(series, future, "revenue")
    ends = series.groupBy("series_id").agg(F.max("date").alias("train_end"))
    decayed = forecast.apply_decay(naive, forecast.trend_decay(series, "revenue", "1998-01-01"), ends)
    clipped = forecast.spike_clip(decayed, series, "revenue", factor=1.2)
    return clipped.select("series_id", "date", F.round("forecast", 0).alias("forecast"))


_SHARE = "CASE WHEN revenue > 0 THEN c / revenue ELSE 0.8746::double END"


@query(
    "ratio_guard",
    f"""SELECT series_id, date, {r6('CASE WHEN q > 1.0 THEN revenue WHEN q < 0.8746::double - 2 * 0.1274::double THEN revenue * (0.8746::double - 2 * 0.1274::double) WHEN q > 0.95::double OR q < 0.70::double THEN 0.6::double * c + 0.4::double * revenue * 0.8746::double ELSE c END')} AS guarded
        FROM (SELECT *, {_SHARE} AS q FROM (SELECT series_id, date, revenue, cogs * 3 AS c FROM m_series) a) b""",
)
def _(cat):
    # tripled so that every branch of the guard occurs in this data
    series = features.daily_series(cat).withColumn("cogs", F.col("cogs") * 3)
    return shown(series.select("series_id", "date", forecast.ratio_guard("revenue", "cogs").alias("guarded")))


_NAIVE = "(SELECT series_id, date, revenue AS y, lag(revenue, 364) OVER (PARTITION BY series_id ORDER BY date) AS a, lag(revenue, 365) OVER (PARTITION BY series_id ORDER BY date) AS b FROM m_series)"


@query(
    "forecast_metrics",
    f"""SELECT series_id, count(*) AS n, {r6('avg(abs(y - p))')} AS mae, {r6('sqrt(avg((y - p) * (y - p)))')} AS rmse, {r6('1 - avg((y - p) * (y - p)) / var_pop(y)')} AS r2,
               {r6('avg(abs(y - p) / (y + 1)) * 100')} AS mape FROM (SELECT series_id, y, 0.4::double * a + 0.6::double * b AS p FROM {_NAIVE} x) q WHERE p IS NOT NULL GROUP BY series_id""",
)
def _(cat):
    series = features.daily_series(cat)
    lags = series.withColumns({"a": features.lag_at("revenue", 364), "b": features.lag_at("revenue", 365)})
    blended = lags.withColumn("p", forecast.blend(["a", "b"], [0.4, 0.6]))
    return shown(forecast.forecast_metrics(blended, "revenue", "p", "series_id", offset=1.0))


@query(
    "yoy_blend",
    f"SELECT series_id, date, {r6('coalesce(0.8::double * y + 0.2::double * a, y)')} AS blended FROM {_NAIVE} x",
)
def _(cat):
    lagged = features.daily_series(cat).withColumn("a", features.lag_at("revenue", 364))
    return shown(lagged.select("series_id", "date", forecast.yoy_blend("revenue", "a").alias("blended")))


@query("submission", f"SELECT strftime(Date, '%Y-%m-%d') AS \"Date\", {money('Revenue')} AS \"Revenue\", {money('COGS')} AS \"COGS\" FROM r_sales")
def _(cat):
    return submission_rows(cat.sales, "Date", "Revenue", "COGS")
