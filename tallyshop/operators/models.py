"""Models on pyspark.ml: forecasts with stacking and cascade, blends, churn classification.

Fitting is distributed; the driver loops over folds, blocks and base models only, and holds
nothing but fitted models and a few sums.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyshop.functions import calendar as cal
from tallyshop.functions.columns import clip, count_if, dbl, mean_exact, ratio
from tallyshop.functions.scale import lookup, value_ranks, with_row_number
from tallyshop.operators.features import (
    SERIES,
    centred_year_ago,
    fold_bounds,
    lag_at,
    lag_nearest,
    recency_weights,
)
from tallyshop.operators.forecast import direct_lag_features, direct_rolling_features, horizon
from tallyshop.operators.statistics import decompose
from tallyshop.session import materialise

SEED = 42
KEYS = [SERIES, "date"]

# --- feature frames ------------------------------------------------------------------------------

CALENDAR_NUMBERS = (
    "dow", "dom", "month", "quarter", "woy", "is_weekend", "is_month_end", "is_month_start",
    "days_to_month_end", "is_last3_days", "is_last7_days", "days_to_quarter_end", "dom_ratio",
    "is_peak_season", "is_low_season", "is_quarter_end_month", "is_year_end_window", "is_lunar_window",
)


def known_ahead(harmonics: int = 4, freeze: str | None = None) -> dict[str, Column]:
    """Calendar, cyclic, Fourier and (frozen) trend columns: known for any future day."""
    calendar = cal.calendar_features("date")
    return {
        **{n: calendar[n] for n in CALENDAR_NUMBERS}, **cal.cyclic_features("date"),
        **cal.fourier_features("date", harmonics, 2), **cal.trend_features("date", freeze=freeze),
    }


def year_lags(value: str) -> dict[str, Column]:
    """Lags of at least 357 days, so that a block of 357 future days needs no forecast as input."""
    return {
        "lag364": F.coalesce(lag_at(value, 364), lag_nearest(value, 364)),
        "lag728": F.coalesce(lag_at(value, 728), lag_nearest(value, 728), lag_at(value, 364)),
        "lag364_mean": centred_year_ago(value, 364, 7), "lag728_mean": centred_year_ago(value, 728, 7),
    }


# Daily columns that carry the target itself, and columns found to be noise.
LEAKY_COLUMNS = (
    "payment_value", "total_refund_amount", "order_id_reviews", "customer_id_reviews", "product_id_reviews", "rating", "Revenue", "COGS",
)
NOISE_COLUMNS = (
    "traffic_direct", "traffic_email_campaign", "traffic_referral", "traffic_paid_search", "traffic_organic_search",
    "traffic_social_media", "avg_session_duration_sec", "day_of_week", "month",
)


def usable_columns(daily: DataFrame) -> DataFrame:
    """The daily table without the columns that leak the target or are noise."""
    return daily.drop(*LEAKY_COLUMNS, *NOISE_COLUMNS)


TARGET_LAGS = (7, 14, 30, 60, 364, 365)
TARGET_WINDOWS = (7, 14, 30)
DRIVERS = ("sessions", "total_stock_on_hand", "order_id")
DRIVER_LAGS = (7, 30, 364)


def engineer_features(daily: DataFrame, target: str = "Revenue") -> DataFrame:
    """The daily table as a model frame: log target, its lags and means of days before, lags of drivers, no leaks.

    ``daily`` has one row per calendar day, so lags by rows are lags by days and the window is as long as the calendar.
    A mean needs all its days.
    """
    days = Window.orderBy("date")
    base = daily.withColumn("label", F.log1p(clip(dbl(target), low=0.0)))
    new = {f"label_lag{k}": F.lag("label", k).over(days) for k in TARGET_LAGS}
    for w in TARGET_WINDOWS:
        frame = days.rowsBetween(-w, -1)
        new[f"label_mean{w}"] = F.when(F.count("label").over(frame) == w, F.avg("label").over(frame))
    new |= {f"{d}_lag{k}": F.lag(d, k).over(days) for d in DRIVERS for k in DRIVER_LAGS}
    new["sessions_yoy"] = F.try_divide(dbl("sessions"), F.lag("sessions", 364).over(days)) - 1
    return usable_columns(base.withColumns(new))


def daily_rows(daily: DataFrame, target: str = "Revenue", useless: tuple[str, ...] = ()) -> DataFrame:
    """The engineered daily table as training rows of one series, without leaks, noise and ``useless`` columns.

    Days without a full year before are left out; a growth that is unknown because a driver was 0 counts as none.
    """
    frame = engineer_features(daily, target).drop(*useless)
    lags = [c for c in frame.columns if c.startswith("label_") and c not in useless]
    numbers = [F.coalesce(dbl(c), F.lit(0.0)).alias(c) for c in feature_names(frame)]
    rows = frame.where("label IS NOT NULL").dropna(subset=lags).select(F.lit("all").alias(SERIES), "date", "label", *numbers)
    return materialise(recency_weights(rows, eras=()))


def feature_names(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    """Numeric columns that may be features: no keys, targets, weights or fold marks."""
    barred = {SERIES, "date", "label", "weight", "fold", *LEAKY_COLUMNS, *exclude}
    numeric = ("int", "integer", "long", "double", "float")
    return [f.name for f in df.schema.fields if f.name not in barred and f.dataType.typeName() in numeric]


def named_subset(names: list[str], keywords: tuple[str, ...]) -> list[str]:
    """Feature names that contain any keyword (trend or seasonal specialists)."""
    return [n for n in names if any(k in n for k in keywords)]


TREND_KEYWORDS = ("trend", "woy", "year_growth")
SEASONAL_KEYWORDS = ("year_sin", "year_cos", "week_", "lag364", "month", "quarter", "dom_ratio", "season", "dow_")


def forecast_frame(series: DataFrame, value: str, freeze: str | None = None) -> DataFrame:
    """Rows with label log1p(value) and the features a year-ahead model may use."""
    logged = series.select(*KEYS, F.log1p(clip(dbl(value), low=0.0)).alias("label"))
    return logged.withColumns({**year_lags("label"), **known_ahead(freeze=freeze)})


def training_rows(frame: DataFrame, eras: tuple[tuple[int, float], ...] = ()) -> DataFrame:
    """Rows whose features and label are all known, with recency weights, computed once."""
    return materialise(recency_weights(frame.dropna(), eras=eras))


# --- estimators ----------------------------------------------------------------------------------


def gbt(iterations: int = 30, depth: int = 5, loss: str = "absolute", step: float = 0.1, validation: bool = False) -> GBTRegressor:
    """Boosted trees on the log label with row and feature sampling; early stopping on request."""
    model = GBTRegressor(
        labelCol="label", featuresCol="features", weightCol="weight", maxIter=iterations, maxDepth=depth,
        lossType=loss, stepSize=step, subsamplingRate=0.8, featureSubsetStrategy="0.8", minInstancesPerNode=10, seed=SEED,
    )
    return model.setValidationIndicatorCol("is_valid") if validation else model


def random_forest(trees: int = 40, depth: int = 8) -> RandomForestRegressor:
    return RandomForestRegressor(
        labelCol="label", featuresCol="features", weightCol="weight", numTrees=trees, maxDepth=depth,
        subsamplingRate=0.8, minInstancesPerNode=5, seed=SEED,
    )


def _linear(weighted: bool = True, **params) -> LinearRegression:
    model = LinearRegression(labelCol="label", featuresCol="features", standardization=True, **params)
    return model.setWeightCol("weight") if weighted else model


def ridge(alpha: float = 0.01, weighted: bool = True) -> LinearRegression:
    return _linear(weighted, regParam=alpha, elasticNetParam=0.0)


def elastic_net(alpha: float = 0.01, l1_share: float = 0.5) -> LinearRegression:
    return _linear(regParam=alpha, elasticNetParam=l1_share, maxIter=200)


def huber(epsilon: float = 1.35, alpha: float = 0.001, weighted: bool = True) -> LinearRegression:
    return _linear(weighted, loss="huber", epsilon=epsilon, regParam=alpha, maxIter=200)


def pipeline(estimator, features: list[str], prediction: str = "prediction") -> Pipeline:
    """Assembler and estimator; the vector column is private to the pipeline."""
    vector = f"_v_{prediction}"
    assembler = VectorAssembler(inputCols=features, outputCol=vector, handleInvalid="keep")
    return Pipeline(stages=[assembler, estimator.copy().setFeaturesCol(vector).setPredictionCol(prediction)])


def predict(model: PipelineModel | Stack, rows: DataFrame, prediction: str = "prediction") -> DataFrame:
    if isinstance(model, Stack):
        return model.predict(rows, prediction)
    return model.transform(rows).drop(f"_v_{prediction}")


def elastic_net_search(rows: DataFrame, features: list[str], folds: int = 5) -> tuple[PipelineModel, DataFrame]:
    """Elastic net over a grid of penalties and mixes, validated on later days than it is fitted on."""
    grid_estimator = _linear(maxIter=100)
    grid = (
        ParamGridBuilder()
        .addGrid(grid_estimator.regParam, [0.001, 0.01, 0.1, 1.0])
        .addGrid(grid_estimator.elasticNetParam, [0.1, 0.5, 0.9])
        .build()
    )
    return grid_search(rows, features, grid_estimator, grid, folds)


def grid_search(rows: DataFrame, features: list[str], estimator, grid: list, folds: int = 5, gap: int = 30) -> tuple[PipelineModel, DataFrame]:
    """Choice from a grid by expanding folds: every validation day lies at least ``gap`` days after its training days.

    Candidates are compared by the mean of their errors over the folds; the best is fitted again on all rows.
    """
    assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    ready = materialise(assembler.transform(rows))
    evaluator = RegressionEvaluator(labelCol="label", metricName="mae")
    ranges = fold_ranges(rows, folds, gap)

    def error(point: dict) -> float:
        errors = []
        for train_to, valid_from, valid_to in ranges:
            model = estimator.fit(ready.where(F.col("date") <= F.lit(train_to)), point)
            part = ready.where(F.col("date").between(F.lit(valid_from), F.lit(valid_to)))
            errors.append(evaluator.evaluate(model.transform(part)))
        return float(np.mean(errors))

    with ThreadPool(4) as pool:
        losses = pool.map(error, grid)
    table = [
        (i, ", ".join(f"{p.name}={v}" for p, v in sorted(point.items(), key=lambda kv: kv[0].name)), loss)
        for i, (point, loss) in enumerate(zip(grid, losses))
    ]
    scores = rows.sparkSession.createDataFrame(table, "candidate int, parameters string, mae_log double")
    best = Pipeline(stages=[assembler, estimator.copy(grid[int(np.argmin(losses))])]).fit(rows)
    return best, scores


def gbt_search(rows: DataFrame, features: list[str], folds: int = 5) -> tuple[PipelineModel, DataFrame]:
    """Boosted trees over depth and step size: the small grid that stands for a sampled search."""
    estimator = gbt()
    grid = ParamGridBuilder().addGrid(estimator.maxDepth, [3, 5]).addGrid(estimator.stepSize, [0.1, 0.3]).build()
    return grid_search(rows, features, estimator, grid, folds)


def staged_boosting(
    rows: DataFrame, features: list[str], folds: int = 5, gap: int = 30, first: int = 50, limit: int = 800, patience: int = 50, estimator: GBTRegressor | None = None
) -> tuple[PipelineModel, DataFrame]:
    """Boosted trees whose number is found on forward folds, then fitted again on all rows.

    Each fold's model tells the error of every prefix of its trees on the days after its training days. If the best mean error lies
    within ``patience`` trees of the last one, the models are fitted with twice as many trees, up to ``limit``; the same seed gives the same
    first trees, so a longer model continues a shorter one. The table has a row per length: (trees, mae_log, folds, chosen, last, limit).
    """
    estimator = (estimator or gbt()).copy()
    assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    ready = materialise(assembler.transform(rows).select("date", "label", "weight", "features"))
    ranges = fold_ranges(rows, folds, gap)
    length = min(first, limit)

    def prefix_errors(job: tuple) -> list[float]:
        train_to, valid_from, valid_to = job
        model = estimator.copy().setMaxIter(length).fit(ready.where(F.col("date") <= F.lit(train_to)))
        part = ready.where(F.col("date").between(F.lit(valid_from), F.lit(valid_to))).withColumn("weight", F.lit(1.0))
        return model.evaluateEachIteration(part, "absolute")

    while True:
        with ThreadPool(4) as pool:
            errors = np.mean(pool.map(prefix_errors, ranges), axis=0)
        best = int(np.argmin(errors))
        if len(errors) - 1 - best >= patience or length >= limit:
            break
        length = min(2 * length, limit)
    table = [(i + 1, float(e), len(ranges), i == best, len(errors), limit) for i, e in enumerate(errors)]
    scores = rows.sparkSession.createDataFrame(table, "trees int, mae_log double, folds int, chosen boolean, last int, limit int")
    model = Pipeline(stages=[assembler, estimator.copy().setMaxIter(best + 1)]).fit(rows)
    return model, scores


def importance_table(model: PipelineModel, features: list[str], spark) -> DataFrame:
    """Features of a fitted tree model by importance."""
    values = model.stages[-1].featureImportances.toArray()
    rows = sorted(zip(features, map(float, values)), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame([(i + 1, n, v) for i, (n, v) in enumerate(rows)], "rank int, feature string, importance double")


# --- stacking --------------------------------------------------------------------------------------


@dataclass
class Stack:
    """Fold models per base learner and the meta learner over their predictions."""

    features: list[str]
    names: list[str]
    fold_models: dict[str, list[PipelineModel]] = field(default_factory=dict)
    meta: PipelineModel | None = None

    def base_predictions(self, rows: DataFrame) -> DataFrame:
        """Mean prediction of the fold models of each base learner."""
        out = rows
        for name in self.names:
            columns = []
            for i, model in enumerate(self.fold_models[name]):
                column = f"_{name}{i}"
                stage = model.stages[-1].copy().setPredictionCol(column)
                out = PipelineModel(stages=[model.stages[0], stage]).transform(out).drop(f"_v_{name}")
                columns.append(column)
            mean = sum((F.col(c) for c in columns), F.lit(0.0)) / len(columns)
            out = out.withColumn(name, mean).drop(*columns)
        return out

    def predict(self, rows: DataFrame, prediction: str = "prediction") -> DataFrame:
        stacked = self.meta.transform(self.base_predictions(rows)).drop("_stack", "_scaled")
        return stacked.withColumnRenamed("_meta", prediction)


def fold_ranges(rows: DataFrame, folds: int, gap: int = 0) -> list[tuple]:
    """(train end, validation start, validation end) per expanding fold: one row each."""
    bounds = fold_bounds(rows, folds, gap).orderBy("fold").collect()
    return [(b["train_to"], b["valid_from"], b["valid_to"]) for b in bounds]


def out_of_fold(rows: DataFrame, features: list[str], bases: dict[str, Callable[[], object]], folds: int, gap: int = 0, subsets: dict[str, list[str]] | None = None) -> tuple[Stack, DataFrame]:
    """Fit every base learner on each expanding window and predict the block after it."""
    ranges = fold_ranges(rows, folds, gap)

    def fit(job: tuple) -> PipelineModel:
        name, train_to = job
        train = rows.where(F.col("date") <= F.lit(train_to))
        return pipeline(bases[name](), (subsets or {}).get(name, features), name).fit(train)

    with ThreadPool(4) as pool:  # fits do not depend on one another
        fitted = pool.map(fit, [(name, train_to) for name in bases for train_to, _, _ in ranges])
    stack = Stack(features, list(bases), {n: fitted[i * len(ranges) : (i + 1) * len(ranges)] for i, n in enumerate(bases)})
    parts = None
    for i, (_, valid_from, valid_to) in enumerate(ranges):
        part = rows.where(F.col("date").between(F.lit(valid_from), F.lit(valid_to)))
        for name in bases:
            part = predict(stack.fold_models[name][i], part, name)
        parts = part if parts is None else parts.unionByName(part)
    return stack, materialise(parts)


def fit_meta(stack: Stack, oof: DataFrame, meta=None) -> Stack:
    """Scaled base predictions into a linear meta learner (Huber without weights by default)."""
    meta = (meta or huber(weighted=False)).copy().setFeaturesCol("_scaled").setPredictionCol("_meta")
    stages = [
        VectorAssembler(inputCols=stack.names, outputCol="_stack"),
        StandardScaler(inputCol="_stack", outputCol="_scaled", withMean=True, withStd=True), meta,
    ]
    stack.meta = Pipeline(stages=stages).fit(oof)
    return stack


def default_bases() -> dict[str, Callable[[], object]]:
    """Three learners of different kinds, in place of three boosting libraries."""
    return {"boost": gbt, "boost_sq": lambda: gbt(depth=4, loss="squared"), "forest": random_forest}


def stacking(rows: DataFrame, features: list[str], bases: dict[str, Callable[[], object]] | None = None, folds: int = 5, gap: int = 30, meta=None) -> tuple[Stack, DataFrame]:
    """Out-of-fold stacking; returns the stack and the out-of-fold rows with its prediction."""
    stack, oof = out_of_fold(rows, features, bases or default_bases(), folds, gap)
    fit_meta(stack, oof, meta)
    scored = stack.meta.transform(oof).drop("_stack", "_scaled").withColumnRenamed("_meta", "prediction")
    return stack, scored


def oof_accuracy(oof: DataFrame, names: list[str]) -> DataFrame:
    """MAE of each base learner and of the stack on the original scale."""
    actual = F.expm1("label")
    agg = oof.agg(
        F.count("*").alias("rows"),
        *[F.avg(F.abs(actual - F.expm1(clip(F.col(n), -10.0, 25.0)))).alias(n) for n in [*names, "prediction"]],
    )
    return agg.unpivot(["rows"], [*names, "prediction"], "model", "mae")


def cascade_feature(cogs_rows: DataFrame, oof: DataFrame, name: str = "revenue_pred_log") -> DataFrame:
    """Out-of-fold revenue prediction as a feature; gaps take the mean of the 30 days before, then the series mean."""
    joined = cogs_rows.join(oof.select(*KEYS, F.col("prediction").alias("_p")), KEYS, "left")
    recent = Window.partitionBy(SERIES).orderBy(F.unix_date("date")).rangeBetween(-30, -1)
    whole = Window.partitionBy(SERIES)
    filled = F.coalesce(F.col("_p"), F.avg("_p").over(recent), F.avg("_p").over(whole))
    return joined.withColumn(name, filled).drop("_p")


def cascade(series: DataFrame, revenue_oof: DataFrame, folds: int = 5) -> tuple[Stack, DataFrame]:
    """COGS stack with the revenue prediction as a driver: boosted trees and an elastic net."""
    rows = materialise(cascade_feature(training_rows(forecast_frame(series, "cogs")), revenue_oof).dropna())
    features = feature_names(rows)
    bases = {"boost": gbt, "elastic": elastic_net}
    return stacking(rows, features, bases, folds, meta=ridge(weighted=False))


# --- forecasts ---------------------------------------------------------------------------------------


def block_forecast(
    series: DataFrame, value: str, model: PipelineModel | Stack, days: int, freeze: str | None = None, block: int = 357,
    drivers: DataFrame | None = None,
) -> DataFrame:
    """Forecast ``days`` ahead in blocks no longer than the shortest lag of the features.

    Within a block all days are predicted in one pass; the next block sees them as history. ``drivers`` holds further
    features of the days ahead. A lag that the history does not reach takes the mean of its series: training has
    no such rows, and a 0 would stand for a day without sales.
    """
    history = series.select(*KEYS, dbl(value).alias(value))
    future = materialise(horizon(series, days).join(
        series.groupBy(SERIES).agg(F.max("date").alias("_end")), SERIES
    ).withColumn("_step", F.datediff("date", "_end")))
    predicted = None
    for start in range(0, days, block):
        part = future.where((F.col("_step") > start) & (F.col("_step") <= start + block)).select(*KEYS)
        known = history if predicted is None else history.unionByName(predicted)
        frame = forecast_frame(known.unionByName(part.withColumn(value, F.lit(None).cast("double"))), value, freeze)
        lags = {n: F.coalesce(n, F.avg("label").over(Window.partitionBy(SERIES))) for n in year_lags("label")}
        rows = frame.withColumns(lags).join(part, KEYS, "left_semi").drop("label")
        rows = rows if drivers is None else rows.join(drivers, KEYS, "left")
        step = predict(model, rows).select(*KEYS, clip(F.expm1("prediction"), low=0.0).alias(value))
        step = materialise(step)
        predicted = step if predicted is None else predicted.unionByName(step)
    return predicted.withColumnRenamed(value, "forecast")


DIRECT_LAGS = [1, 7, 14, 30, 90, 365]
DIRECT_WINDOWS = [7, 30]


def direct_rows(logged: DataFrame, dates: DataFrame) -> DataFrame:
    """Features of the one-shot model for ``dates`` (series_id, date) from a log series (label) that ends before them.

    Short lags and rolling statistics whose source lies in the future move back by whole years into the past, so nothing feeds back.
    """
    lags = direct_lag_features(logged, dates, "label", DIRECT_LAGS, whole=True)
    rolling = direct_rolling_features(logged, dates, "label", DIRECT_WINDOWS, whole=True)
    return lags.join(rolling, KEYS).withColumns(known_ahead())


def direct_frame(series: DataFrame, value: str, days: int = 365, cutoffs: int = 4) -> DataFrame:
    """Training rows of the one-shot model, made as they will be served.

    History is cut off 1, 2, ... years before its end; the ``days`` days after each cut get the features that a forecast made on
    that day would have had, and their true log value as label.
    """
    logged = materialise(series.select(*KEYS, F.log1p(clip(dbl(value), low=0.0)).alias("label")).where("label IS NOT NULL"))
    ends = logged.groupBy(SERIES).agg(F.max("date").alias("_end"))
    frames = []
    for k in range(1, cutoffs + 1):
        cut = F.date_sub("_end", 365 * k)
        marked = logged.join(ends, SERIES)
        past = marked.where(F.col("date") <= cut).select(*KEYS, "label")
        ahead = marked.where((F.col("date") > cut) & (F.col("date") <= F.date_add(cut, days))).select(*KEYS, "label")
        frames.append(direct_rows(past, ahead.select(*KEYS)).join(ahead, KEYS))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def direct_forecast(series: DataFrame, value: str, model: PipelineModel, days: int) -> DataFrame:
    """One-shot forecast over ``direct_rows``; a source that the history does not reach takes the mean of its series."""
    logged = series.select(*KEYS, F.log1p(clip(dbl(value), low=0.0)).alias("label"))
    future = materialise(horizon(series, days))
    rows = direct_rows(logged, future)
    means = logged.groupBy(SERIES).agg(F.avg("label").alias("_mean"))
    names = [c for c in rows.columns if c.startswith("label_")]
    filled = rows.join(means, SERIES).withColumns({n: F.coalesce(n, F.lit(0.0) if "_rstd" in n else F.col("_mean")) for n in names}).drop("_mean")
    return predict(model, filled).select(*KEYS, clip(F.expm1("prediction"), low=0.0).alias("forecast"))


RESIDUAL_LAGS = (364, 365, 371)


def residual_lags(value: str = "label") -> dict[str, Column]:
    """Lags of the residual about a year back, else a year farther, else its mean, which is 0 by construction of the trend and season."""
    return {f"resid_lag{k}": F.coalesce(lag_at(value, k), lag_at(value, k + 364), F.lit(0.0)) for k in RESIDUAL_LAGS}


def residual_frame(series: DataFrame, value: str) -> DataFrame:
    """Decomposed log value; residual as label with its own lags and the calendar, for days whose lags reach into the series."""
    logged = series.select(*KEYS, F.log1p(clip(dbl(value), low=0.0)).alias("v"))
    parts = decompose(logged, "v").select(*KEYS, "trend", "seasonal", F.col("residual").alias("label"))
    reached = parts.withColumn("_reached", lag_at("label", max(RESIDUAL_LAGS)).isNotNull())
    return reached.withColumns({**residual_lags(), **known_ahead()}).where("_reached").drop("_reached")


def decomposed_forecast(series: DataFrame, value: str, model: PipelineModel, days: int = 357) -> DataFrame:
    """Last trend level, last year's seasonal part and the modelled residual (within ±1.5), put together.

    Trend and seasonal parts are those of the last day that has a full window. Day 366 takes the season of day 365 where no
    leap year has one. Lags are those of ``residual_frame``.
    """
    logged = series.select(*KEYS, F.log1p(clip(dbl(value), low=0.0)).alias("v"))
    parts = materialise(decompose(logged, "v"))
    level = parts.where("trend IS NOT NULL").groupBy(SERIES).agg(F.max_by("trend", "date").alias("trend"))
    season = parts.where("seasonal IS NOT NULL").groupBy(SERIES, F.dayofyear("date").alias("_doy")).agg(
        F.max_by("seasonal", "date").alias("seasonal")
    )
    eve = season.where("_doy = 365").select(SERIES, F.col("seasonal").alias("_eve"))
    future = horizon(series, days)
    residuals = parts.select(*KEYS, F.col("residual").alias("label"))
    joined = residuals.unionByName(future.withColumn("label", F.lit(None).cast("double")))
    rows = joined.withColumns({**residual_lags(), **known_ahead()}).join(future, KEYS, "left_semi")
    rows = rows.withColumn("_doy", F.dayofyear("date")).join(level, SERIES).join(season, [SERIES, "_doy"], "left").join(eve, SERIES, "left")
    out = predict(model, rows.withColumn("seasonal", F.coalesce("seasonal", "_eve")).drop("label"))
    total = F.col("trend") + F.col("seasonal") + clip("prediction", -1.5, 1.5)
    return out.select(*KEYS, clip(F.expm1(total), low=0.0).alias("forecast"))


# --- churn classification ------------------------------------------------------------------------------

CHURN_FEATURES = ["total_items", "avg_delivery_days", "avg_rating", "AOV", "promo_usage_rate", "category_diversity"]


def split_position(key: str, seed: int = SEED) -> Column:
    """A number of 52 bits from the MD5 of key and seed: the order in which the rows of a class are dealt to training."""
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def stratified_split(rows: DataFrame, label: str, key: str, train_share: float = 0.8, seed: int = SEED) -> DataFrame:
    """Adds ``is_train``: exactly round(share × rows) of each class, those first by the hash of their key.

    Rows are numbered over the whole table in the order of class and hash, so no class meets in one task; a class's
    numbers start after the classes before it. Repeated keys lie side by side. A null label is a class of its own.
    """
    ordered = with_row_number(
        rows.withColumn("_hash", split_position(key, seed)).withColumn("_tie", F.xxhash64(*rows.columns)).withColumn("_row", F.monotonically_increasing_id()),
        [label, "_hash", key, "_tie", "_row"], "_at",
    )
    classes = rows.groupBy(F.col(label).alias("_class")).agg(F.count("*").alias("_n"))
    before = Window.orderBy(F.col("_class").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)  # one row per class
    starts = classes.select("_class", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    joined = ordered.join(F.broadcast(starts), F.col(label).eqNullSafe(F.col("_class")))
    quota = F.floor(F.col("_n") * F.lit(float(train_share)) + 0.5)
    return joined.select(*rows.columns, (F.col("_at") - F.col("_start") <= quota).alias("is_train"))


def auc_by_ranks(scored: DataFrame, label: str, score: str) -> DataFrame:
    """(positives, negatives, auc): the chance that a positive scores above a negative, ties counting half.

    Rows are collapsed to (score, positives, rows) before they are ranked, so a score that many rows share is one row of the
    order. Rows without label or score are left out; without both classes the AUC is null.
    """
    known = scored.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    cells = known.groupBy(score).agg(F.count("*").alias("_n"), F.count_if(F.col(label) == 1).alias("_p"))
    ranked = lookup(cells, value_ranks(cells, score, "_n").select(score, "rank"), [score], "inner")
    sums = ranked.agg(F.coalesce(F.sum("_p"), F.lit(0)).alias("positives"), F.coalesce(F.sum(F.col("_n") - F.col("_p")), F.lit(0)).alias("negatives"), F.sum(F.col("_p") * F.col("rank")).alias("_ranks"))
    p, n = dbl("positives"), dbl("negatives")
    return sums.select("positives", "negatives", F.try_divide(F.col("_ranks") - p * (p + 1) / 2, p * n).alias("auc"))


def churn_rows(customers: DataFrame, rfm: DataFrame, train_share: float = 0.8) -> DataFrame:
    """Features, label (segment Churn Risk) and a train mark that gives each label the same share to the row.

    The mark depends on the customer ids alone, so it stays the same across runs. The label comes from the
    same period as the features, so the model describes churners rather than predicts them.
    """
    base = customers.select(
        "customer_id", "total_items", "avg_delivery_days", "avg_rating", ratio("total_revenue", "total_orders").alias("AOV"),
        ratio("promo_lines", "total_lines").alias("promo_usage_rate"), "category_diversity",
    )
    joined = base.join(rfm.select("customer_id", "segment"), "customer_id")
    numbers = [dbl(c).alias(c) for c in CHURN_FEATURES]
    labelled = joined.select("customer_id", *numbers, F.when(F.col("segment") == "Churn Risk", 1.0).otherwise(0.0).alias("label"))
    return materialise(stratified_split(materialise(labelled), "label", "customer_id", train_share))


@dataclass
class ChurnModel:
    model: PipelineModel
    scored: DataFrame

    def auc(self) -> float | None:
        return auc_by_ranks(self.scored, "label", "probability").first()["auc"]

    def confusion(self) -> DataFrame:
        return self.scored.groupBy("label", "prediction").agg(F.count("*").alias("customers"))

    def report(self) -> DataFrame:
        """Accuracy, precision, recall, F1 and AUC of the churn class on the test customers."""
        y, p = F.col("label") == 1, F.col("prediction") == 1
        counts = self.scored.agg(
            count_if(y & p).alias("tp"), count_if(~y & p).alias("fp"), count_if(y & ~p).alias("fn"), F.count("*").alias("n"),
            count_if(F.col("label") == F.col("prediction")).alias("right"),
        )
        return counts.select(
            "n", "tp", "fp", "fn", ratio("right", "n").alias("accuracy"), ratio("tp", F.col("tp") + F.col("fp")).alias("precision"),
            ratio("tp", F.col("tp") + F.col("fn")).alias("recall"),
            ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"), F.lit(self.auc()).cast("double").alias("auc"),
        )

    def importances(self) -> DataFrame:
        return importance_table(self.model, CHURN_FEATURES, self.scored.sparkSession)


def churn_classifier(rows: DataFrame, trees: int = 100, depth: int = 10) -> ChurnModel:
    """Random forest on six behaviour features; missing values take the training mean.

    The node each row has reached in a tree is kept between levels, so a level does not walk every tree from its root; the forest is the same.
    """
    filled = [f"_f_{c}" for c in CHURN_FEATURES]
    stages = [
        Imputer(inputCols=CHURN_FEATURES, outputCols=filled, strategy="mean"),
        VectorAssembler(inputCols=filled, outputCol="features"),
        RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=SEED, cacheNodeIds=True),
    ]
    model = Pipeline(stages=stages).fit(rows.where("is_train"))
    scored = model.transform(rows.where("NOT is_train")).withColumn("probability", vector_to_array("probability")[1])
    return ChurnModel(model, materialise(scored.drop("features", *filled)))


def revenue_saved(scored: DataFrame, rows: DataFrame, success: float = 0.3) -> DataFrame:
    """Churners found × mean order value of churners × success rate."""
    mean = rows.where("label = 1").agg(mean_exact("AOV").alias("m")).scalar()
    found = scored.agg(count_if((F.col("label") == 1) & (F.col("prediction") == 1)).alias("true_positives"))
    return found.select("true_positives", mean.alias("avg_aov_churners"), (F.col("true_positives") * mean * success).alias("revenue_saved"))
