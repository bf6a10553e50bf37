"""Time-series features per series: lags, rolling windows, growth, weights, splits and folds.

A series has at most one row per calendar day, so a window over one series is bounded by the
calendar; many series spread over the cluster by ``series_id``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyshop.functions.columns import clip, col, day_index, dbl, net_value, ratio
from tallyshop.functions.spine import series_spine
from tallyshop.sources.tables import Catalog

SERIES = "series_id"


def daily_series(cat: Catalog, dimension: str = "category") -> DataFrame:
    """Daily revenue, COGS, units and orders per value of a product attribute, on a gap-free calendar."""
    per_day = (
        cat.order_items.select("order_id", "product_id", "quantity", net_value().alias("net"))
        .join(cat.orders.select("order_id", F.col("order_date").alias("date")), "order_id")
        .groupBy("date", "product_id")
        .agg(F.sum("net").alias("net"), F.sum("quantity").alias("units"), F.count("*").alias("lines"))
    )
    products = cat.products.select("product_id", F.col(dimension).alias(SERIES), "cogs")
    sums = per_day.join(products, "product_id").groupBy(SERIES, "date").agg(
        dbl(F.sum("net")).alias("revenue"), dbl(F.sum(F.col("units") * F.col("cogs"))).alias("cogs"),
        F.sum("units").alias("units"), F.sum("lines").alias("lines"),
    )
    days = series_spine(sums, SERIES, "date")
    return days.join(sums, [SERIES, "date"], "left").fillna(0, ["revenue", "cogs", "units", "lines"])


def total_series(cat: Catalog) -> DataFrame:
    """The whole business as one series, on a gap-free calendar."""
    sales = cat.sales.select(
        F.lit("all").alias(SERIES), F.col("Date").alias("date"), dbl("Revenue").alias("revenue"), dbl("COGS").alias("cogs")
    )
    return series_spine(sales, SERIES, "date").join(sales, [SERIES, "date"], "left").fillna(0.0, ["revenue", "cogs"])


def _calendar(low: int, high: int):
    """Frame of calendar days relative to the row, whatever rows exist."""
    return Window.partitionBy(SERIES).orderBy(day_index("date")).rangeBetween(low, high)


def lag_at(value: Column | str, days: int) -> Column:
    """Value exactly ``days`` calendar days earlier, or NULL."""
    return F.max(col(value)).over(_calendar(-days, -days))


def lag_features(value: str, days: list[int]) -> dict[str, Column]:
    return {f"{value}_lag{k}": lag_at(value, k) for k in days}


def rolling_features(value: str, windows: list[int], stats: tuple[str, ...] = ("mean", "std")) -> dict[str, Column]:
    """Statistics of the last ``w`` days before the row; NULL unless all ``w`` days are there."""
    functions = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    out = {}
    for w in windows:
        frame = _calendar(-w, -1)
        full = F.count(value).over(frame) == w
        for s in stats:
            out[f"{value}_r{s}{w}"] = F.when(full, functions[s](dbl(value)).over(frame))
    return out


def centred_year_ago(value: str, lag: int = 364, half: int = 3, minimum: int = 1) -> Column:
    """Mean of the days within ``half`` of the day ``lag`` days ago."""
    frame = _calendar(-lag - half, -lag + half)
    return F.when(F.count(value).over(frame) >= minimum, F.avg(value).over(frame))


def lag_nearest(value: str, lag: int, reach: int = 7, alternate: bool = False) -> Column:
    """Value ``lag`` days ago, else the nearest within ``reach`` days.

    Farther-back days come first; with ``alternate`` the two sides take turns.
    """
    frame = _calendar(-lag - reach, -lag + reach)
    seen = F.collect_list(F.when(F.col(value).isNotNull(), F.struct(F.col("date").alias("d"), F.col(value).alias("v")))).over(frame)

    def choice(s):
        back = F.datediff(F.date_sub(F.col("date"), lag), s["d"])  # > 0: farther back
        if alternate:
            rank = F.abs(back) * 2 + F.when(back < 0, 1).otherwise(0)
        else:
            rank = F.when(back >= 0, back).otherwise(reach - back)
        return F.struct(rank.alias("rank"), s["v"].alias("v"))

    return F.array_min(F.transform(seen, choice))["v"]  # at most 2·reach + 1 entries


def date_lag_join(df: DataFrame, value: str, days: int, name: str) -> DataFrame:
    """The same lag as an equality join on the shifted date, for values of another table."""
    earlier = df.select(SERIES, F.date_add("date", days).alias("date"), F.col(value).alias(name))
    return df.join(earlier, [SERIES, "date"], "left")


def lag_chain(df: DataFrame, value: str, lags: tuple[int, ...] = (364, 728)) -> DataFrame:
    """Lag with fallbacks to longer lags and at last to the median of the series."""
    medians = df.groupBy(SERIES).agg(F.median(value).alias("_median"))  # one value per day and series
    tries = [lag_at(value, k) for k in lags]
    return df.withColumns({f"_t{i}": t for i, t in enumerate(tries)}).join(medians, SERIES).withColumn(
        f"{value}_chain", F.coalesce(*[F.col(f"_t{i}") for i in range(len(tries))], F.col("_median"))
    ).drop("_median", *[f"_t{i}" for i in range(len(tries))])


def exog_year_shift(df: DataFrame, value: str, half: int = 7, minimum: int = 5) -> DataFrame:
    """Log of a driver, smoothed around 364 days ago, else 728 days ago, else the series median."""
    name = f"{value}_log"
    logged = df.withColumn(name, F.log1p(clip(dbl(value), low=0.0)))
    shifted = logged.withColumns({f"_s{k}": centred_year_ago(name, k, half, minimum) for k in (364, 728)})
    medians = logged.groupBy(SERIES).agg(F.median(name).alias("_median"))
    return shifted.join(medians, SERIES).withColumn(
        f"{value}_year_shift", F.coalesce("_s364", "_s728", "_median")
    ).drop("_s364", "_s728", "_median")


def year_over_year_log(value: str, lag: int = 364) -> Column:
    """log1p of a driver minus its log1p ``lag`` days earlier."""
    now = F.log1p(dbl(value))
    return now - F.log1p(dbl(lag_at(value, lag)))


def completed_year_growth(df: DataFrame, value: str) -> DataFrame:
    """Adds the growth of the last completed year over the one before (1 where unknown)."""
    yearly = df.groupBy(SERIES, F.year("date").alias("_y")).agg(F.avg(value).alias("_m"))
    by_year = Window.partitionBy(SERIES).orderBy("_y")
    growth = yearly.select(
        SERIES, (F.col("_y") + 1).alias("_y"), F.coalesce(ratio("_m", F.lag("_m").over(by_year)), F.lit(1.0)).alias("annual_growth")
    )
    return df.withColumn("_y", F.year("date")).join(growth, [SERIES, "_y"], "left").fillna(1.0, ["annual_growth"]).drop("_y")


def yearly_growth(df: DataFrame, value: str) -> DataFrame:
    """Yearly totals and their change over the year before."""
    yearly = df.groupBy(SERIES, F.year("date").alias("year")).agg(F.sum(value).alias("total"))
    before = F.lag("total").over(Window.partitionBy(SERIES).orderBy("year"))
    return yearly.withColumn("growth", ratio("total", before) - 1)


def trend_residual(df: DataFrame, value: str, train_before: str, lags: tuple[int, ...] = (1, 7, 30)) -> DataFrame:
    """Straight-line trend fitted before a date, residuals, and lags and a rolling mean of them."""
    first = F.min("date").over(Window.partitionBy(SERIES))
    indexed = df.withColumn("time_idx", F.datediff(F.col("date"), first))
    fits = indexed.where(F.col("date") < F.lit(train_before).cast("date")).groupBy(SERIES).agg(
        F.regr_slope(value, "time_idx").alias("_a"), F.regr_intercept(value, "time_idx").alias("_b")
    )
    name = f"{value}_resid"
    out = indexed.join(fits, SERIES).withColumn("trend", F.col("_a") * F.col("time_idx") + F.col("_b")).drop("_a", "_b")
    out = out.withColumn(name, F.col(value) - F.col("trend"))
    return out.withColumns({**lag_features(name, list(lags)), **rolling_features(name, [7], ("mean",))})


def winsorize(df: DataFrame, value: str, share: float = 0.01) -> DataFrame:
    """Clamps the lowest and highest ``share`` of each series to the nearest kept value."""
    order = Window.partitionBy(SERIES).orderBy(value, "date")
    n = F.count(value).over(Window.partitionBy(SERIES))
    ranked = df.withColumns({"_rn": F.row_number().over(order), "_k": F.floor(n * share), "_n": n})
    whole = Window.partitionBy(SERIES)
    low = F.max(F.when(F.col("_rn") == F.col("_k") + 1, F.col(value))).over(whole)
    high = F.max(F.when(F.col("_rn") == F.col("_n") - F.col("_k"), F.col(value))).over(whole)
    return ranked.withColumn(f"{value}_winsorized", F.greatest(low, F.least(high, F.col(value)))).drop("_rn", "_k", "_n")


# --- weights -----------------------------------------------------------------------------------


def recency_weights(df: DataFrame, decay: float = 3.0, eras: tuple[tuple[int, float], ...] = ((2018, 2.0), (2021, 3.0))) -> DataFrame:
    """exp(decay · position in time) times an era factor, scaled to 1..5 per series."""
    whole = Window.partitionBy(SERIES)
    day = day_index("date").cast("double")
    position = (day - F.min(day).over(whole)) / (F.max(day).over(whole) - F.min(day).over(whole) + 1e-9)
    factor = F.lit(1.0)
    for year, weight in sorted(eras):
        factor = F.when(F.year("date") >= year, F.lit(weight)).otherwise(factor)
    raw = df.withColumn("_raw", F.exp(decay * position) * factor)
    low, high = F.min("_raw").over(whole), F.max("_raw").over(whole)
    return raw.withColumn("weight", 1 + 4 * (F.col("_raw") - low) / (high - low + 1e-9)).drop("_raw")


def year_weight(date: Column | str, steps: dict[int, float] | None = None) -> Column:
    """Weight by year: 1 before the listed years."""
    steps = steps or {2019: 2.0, 2020: 3.0, 2021: 4.0, 2022: 5.0}
    out = F.lit(1.0)
    for year, weight in steps.items():
        out = F.when(F.year(date) == year, F.lit(weight)).otherwise(out)
    return out


def half_life_weight(date: Column | str, newest: Column, years: float = 2.5) -> Column:
    """Halves every ``years`` years back from the newest date."""
    return F.exp(-F.datediff(newest, col(date)) * math.log(2) / (years * 365.25))


def snapshot_weight(days_since_snapshot: Column | str) -> Column:
    """Trust in a stock snapshot, fading over a month."""
    return F.exp(-col(days_since_snapshot) / 30.0)


# --- splits ------------------------------------------------------------------------------------


def time_split(date: Column | str, valid_from: str, test_from: str) -> Column:
    """train / valid / test by two dates."""
    date = col(date)
    return (
        F.when(date < F.lit(valid_from).cast("date"), "train")
        .when(date < F.lit(test_from).cast("date"), "valid")
        .otherwise("test")
    )


def fold_bounds(df: DataFrame, folds: int = 5, gap: int = 0) -> DataFrame:
    """Expanding-window folds over the sorted days: train and validation date ranges.

    The last ``folds`` blocks of n // (folds + 1) days validate; training ends ``gap`` days before.
    """
    days = df.select("date").distinct()
    numbered = days.select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("i"))  # calendar days
    n = days.agg(F.count("*").alias("n")).scalar()
    size = F.floor(n / F.lit(folds + 1))
    start = n - folds * size
    placed = numbered.withColumns({"_size": size, "_start": start}).withColumn(
        "fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))
    )
    begin = F.col("_start") + F.col("fold") * F.col("_size")
    role = F.when((F.col("i") >= begin) & (F.col("i") < begin + F.col("_size")), "valid").when(F.col("i") < begin - gap, "train")
    out = placed.withColumn("role", role).where("role IS NOT NULL").groupBy("fold").agg(
        *[
            f(F.when(F.col("role") == r, F.col("date"))).alias(f"{r}_{n}")
            for r in ("train", "valid") for n, f in (("from", F.min), ("to", F.max))
        ],
        F.sum(F.when(F.col("role") == "train", 1).otherwise(0)).alias("train_days"),
        F.sum(F.when(F.col("role") == "valid", 1).otherwise(0)).alias("valid_days"),
    )
    return out


def walk_forward(df: DataFrame, cutoffs: tuple[str, ...], valid_days: int = 365) -> DataFrame:
    """Rows marked per fixed cutoff: train up to it, valid for the days after it."""
    cuts = F.explode(F.array(*[F.lit(c).cast("date") for c in cutoffs]))
    marked = df.withColumn("cutoff", cuts)
    ahead = F.datediff("date", "cutoff")
    return marked.withColumn(
        "role", F.when(ahead <= 0, "train").when(ahead <= valid_days, "valid")
    ).where("role IS NOT NULL")
