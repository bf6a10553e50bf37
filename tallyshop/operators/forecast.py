"""Forecasts that need no fitted ML model, guards and accuracy measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyshop.functions.columns import clip, col, dbl, ratio
from tallyshop.operators.features import SERIES

# Mean and standard deviation of COGS over revenue, and the guard's settings.
RATIO_MEAN = 0.8746
RATIO_STD = 0.1274
HARD_HIGH = 1.0
SOFT_LOW, SOFT_HIGH, BLEND = 0.70, 0.95, 0.40


def horizon(series: DataFrame, days: int) -> DataFrame:
    """The ``days`` calendar days after the last day of each series."""
    last = series.groupBy(SERIES).agg(F.max("date").alias("_last"))
    return last.select(SERIES, F.explode(F.sequence(F.date_add("_last", 1), F.date_add("_last", days))).alias("date"))


def year_profile(series: DataFrame, value: str) -> DataFrame:
    """Mean of value over yearly mean, by month and day."""
    in_year = Window.partitionBy(SERIES, F.year("date"))  # at most 366 rows
    scaled = series.withColumn("_norm", ratio(value, F.avg(value).over(in_year)))
    return scaled.groupBy(SERIES, F.month("date").alias("month"), F.day("date").alias("day")).agg(F.avg("_norm").alias("factor"))


def growth_rate(series: DataFrame, value: str, first_year: int, last_year: int) -> DataFrame:
    """Geometric mean growth of yearly totals over full years, and the last year's daily level."""
    totals = series.where(F.year("date").between(first_year, last_year)).groupBy(SERIES, F.year("date").alias("y")).agg(
        F.sum(value).alias("t")
    )
    before = F.lag("t").over(Window.partitionBy(SERIES).orderBy("y"))
    steps = totals.withColumn("g", F.ln(ratio("t", before)))
    return steps.groupBy(SERIES).agg(
        F.exp(F.avg("g")).alias("growth"), (F.max(F.when(F.col("y") == last_year, F.col("t"))) / 365).alias("base")
    )


def seasonal_growth_forecast(series: DataFrame, dates: DataFrame, value: str, first_year: int, last_year: int) -> DataFrame:
    """base · growth^(years ahead) · seasonal factor; days without a factor count as 1."""
    rates, profile = growth_rate(series, value, first_year, last_year), year_profile(series, value)
    keyed = dates.select(SERIES, "date", F.month("date").alias("month"), F.day("date").alias("day"))
    joined = keyed.join(rates, SERIES).join(profile, [SERIES, "month", "day"], "left")
    ahead = F.year("date") - last_year
    forecast = F.col("base") * F.pow(F.col("growth"), ahead) * F.coalesce("factor", F.lit(1.0))
    return joined.select(SERIES, "date", forecast.alias("forecast"))


def seasonal_naive(series: DataFrame, dates: DataFrame, value: str, period: int = 365) -> DataFrame:
    """Value of the last observed day a whole number of periods earlier."""
    last = series.groupBy(SERIES).agg(F.max("date").alias("_last"))
    aimed = dates.join(last, SERIES)
    periods = F.greatest(F.ceil(F.datediff("date", "_last") / period), F.lit(1)).cast("int")
    keyed = aimed.select(SERIES, "date", F.date_sub(F.col("date"), periods * period).alias("_source"))
    known = series.select(SERIES, F.col("date").alias("_source"), F.col(value).alias("forecast"))
    return keyed.join(known, [SERIES, "_source"], "left").drop("_source")


def _moved_back(source: Column, shift: int, whole: bool) -> Column:
    """A source day on or after the first future day, moved back by one shift, or (``whole``) by as many as it takes."""
    ahead = F.datediff(source, F.col("_first"))
    shifts = F.floor(ahead / shift) + 1 if whole else F.lit(1)
    return F.when(ahead >= 0, F.date_sub(source, (shifts * shift).cast("int"))).otherwise(source)


def direct_lag_features(series: DataFrame, dates: DataFrame, value: str, lags: list[int], shift: int = 365, whole: bool = False) -> DataFrame:
    """Lags for all future days at once: a source day that is itself in the future moves a year back.

    Only actual history is read, so no forecast feeds another. Unknown sources are 0; with ``whole`` a source moves back
    until it lies in the past, and unknown ones are null.
    """
    first = dates.groupBy(SERIES).agg(F.min("date").alias("_first"))
    wanted = dates.join(first, SERIES).select(SERIES, "date", "_first", F.explode(F.array(*[F.lit(k) for k in lags])).alias("_lag"))
    source = F.date_sub(F.col("date"), F.col("_lag"))
    moved = _moved_back(source, shift, whole)
    known = series.select(SERIES, F.col("date").alias("_source"), F.col(value).alias("_v"))
    found = wanted.withColumn("_source", moved).join(known, [SERIES, "_source"], "left")
    lag = {k: F.max(F.when(F.col("_lag") == k, F.col("_v"))) for k in lags}
    return found.groupBy(SERIES, "date").agg(*[(c if whole else F.coalesce(c, F.lit(0.0))).alias(f"{value}_lag{k}") for k, c in lag.items()])


def direct_rolling_features(series: DataFrame, dates: DataFrame, value: str, windows: list[int], shift: int = 365, whole: bool = False) -> DataFrame:
    """Mean, deviation, minimum and maximum over the days before each future day, sources as above."""
    widest = max(windows)
    first = dates.groupBy(SERIES).agg(F.min("date").alias("_first"))
    wanted = dates.join(first, SERIES).withColumn("_lag", F.explode(F.sequence(F.lit(1), F.lit(widest))))
    source = F.date_sub(F.col("date"), F.col("_lag"))
    moved = _moved_back(source, shift, whole)
    known = series.select(SERIES, F.col("date").alias("_source"), F.col(value).alias("_v"))
    found = wanted.withColumn("_source", moved).join(known, [SERIES, "_source"], "left")
    found = found if whole else found.fillna(0.0, ["_v"])
    stats = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    return found.groupBy(SERIES, "date").agg(
        *[f(F.when(F.col("_lag") <= w, F.col("_v"))).alias(f"{value}_r{s}{w}") for w in windows for s, f in stats.items()]
    )


def frozen_drivers(series: DataFrame, dates: DataFrame, drivers: list[str]) -> DataFrame:
    """Future rows that carry the last known value of each driver."""
    last = series.groupBy(SERIES).agg(*[F.max_by(d, "date").alias(d) for d in drivers])
    return dates.join(last, SERIES, "left")


# --- trend, guards ---------------------------------------------------------------------------------


def trend_decay(series: DataFrame, value: str, since: str) -> DataFrame:
    """Slope of the log value per day since a date, with the monthly and yearly factors."""
    recent = series.where(F.col("date") >= F.lit(since).cast("date"))
    x = F.datediff("date", F.lit(since).cast("date")).cast("double")
    y = F.ln(clip(dbl(value), low=1.0))
    return recent.groupBy(SERIES).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2")
    ).withColumns({"monthly_factor": F.exp(F.col("slope") * 30.44), "annual_factor": F.exp(F.col("slope") * 365.25)})


def apply_decay(forecast: DataFrame, decay: DataFrame, train_end: DataFrame, value: str = "forecast") -> DataFrame:
    """Multiplies forecasts by exp(slope · days after the end of training)."""
    joined = forecast.join(decay.select(SERIES, "slope"), SERIES).join(train_end, SERIES)
    factor = F.exp(F.col("slope") * F.datediff("date", "train_end"))
    return joined.withColumn(value, F.col(value) * factor).drop("slope", "train_end")


def spike_clip(forecast: DataFrame, series: DataFrame, value: str, share: float = 0.95, factor: float = 1.0) -> DataFrame:
    """Forecasts limited to 0 .. factor × percentile of the history of the series."""
    caps = series.groupBy(SERIES).agg((F.percentile(value, F.lit(share)) * factor).alias("_cap"))  # one value per day
    return forecast.join(caps, SERIES).withColumn(
        "forecast", F.greatest(F.lit(0.0), F.least(F.col("forecast"), F.col("_cap")))
    ).drop("_cap")


def ratio_guard(revenue: Column | str, cogs: Column | str) -> Column:
    """COGS held to a plausible share of revenue.

    Shares outside the hard limits go to the limit; shares in the soft zones move 40 % of the
    way to the mean share. A share that was cut at a limit is not blended again.
    """
    revenue, cogs = col(revenue), col(cogs)
    low = RATIO_MEAN - 2 * RATIO_STD
    share = F.when(revenue > 0, F.try_divide(cogs, revenue)).otherwise(F.lit(RATIO_MEAN))
    blended = (1 - BLEND) * cogs + BLEND * revenue * RATIO_MEAN
    return (
        F.when(share > HARD_HIGH, revenue * HARD_HIGH)
        .when(share < low, revenue * low)
        .when((share > SOFT_HIGH) | (share < SOFT_LOW), blended)
        .otherwise(cogs)
    )


def blend(columns: list[str], weights: list[float]) -> Column:
    """Weighted sum of forecast columns."""
    return sum((F.col(c) * w for c, w in zip(columns, weights)), F.lit(0.0))


def yoy_blend(forecast: Column | str, year_ago: Column | str, alpha: float = 0.2) -> Column:
    """(1 − alpha) · forecast + alpha · value a year ago, where that is known."""
    return F.coalesce((1 - alpha) * col(forecast) + alpha * col(year_ago), col(forecast))


def forecast_metrics(df: DataFrame, actual: str, predicted: str, *groups: str, offset: float = 0.0) -> DataFrame:
    """MAE, RMSE, R² and MAPE (denominator actual + offset; zero denominators left out)."""
    y, p = dbl(actual), dbl(predicted)
    error = y - p
    agg = df.where(y.isNotNull() & p.isNotNull()).groupBy(*groups).agg(
        F.count("*").alias("n"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"),
        (1 - F.try_divide(F.avg(error * error), F.var_pop(y))).alias("r2"),
        (F.avg(F.try_divide(F.abs(error), y + offset)) * 100).alias("mape"),
    )
    return agg
