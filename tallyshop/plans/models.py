"""Queries for fitted models. SQL cannot fit them, so they have no oracle."""

from pyspark.sql import functions as F

from tallyshop.functions import calendar as cal
from tallyshop.functions.columns import flag, shown
from tallyshop.operators import blends, customers, features, forecast, information, models, recursion, search, statistics
from tallyshop.operators.marts import customer_base
from tallyshop.plans.daily import daily_table
from tallyshop.plans.features import LUNAR
from tallyshop.plans.registry import query
from tallyshop.session import materialise

HOLD_OUT = "2001-01-01"
HORIZON = 548


def _series(cat):
    return materialise(features.daily_series(cat))


def _rows(cat, value="revenue"):
    return models.training_rows(models.forecast_frame(_series(cat), value))


def _hold_out(rows, estimator, names=None):
    """Accuracy on the last year of a model fitted before it."""
    names = names or models.feature_names(rows)
    marked = rows.withColumn("is_valid", F.year("date") == 2000)
    model = models.pipeline(estimator, names).fit(marked.where(F.col("date") < HOLD_OUT))
    scored = models.predict(model, rows.where(F.col("date") >= HOLD_OUT))
    scale = scored.select("series_id", F.expm1("label").alias("y"), F.expm1("prediction").alias("p"))
    return shown(forecast.forecast_metrics(scale, "y", "p", "series_id", offset=1.0))


@query("gbt_regressor")
def _(cat):
    return _hold_out(_rows(cat), models.gbt(validation=True))


@query("random_forest_regressor")
def _(cat):
    return _hold_out(_rows(cat), models.random_forest())


@query("linear_ridge_trend")
def _(cat):
    rows = _rows(cat)
    names = models.named_subset(models.feature_names(rows), (*models.TREND_KEYWORDS, "lag364_mean"))
    return _hold_out(rows, models.ridge(), names)


@query("linear_elastic_net_seasonal")
def _(cat):
    rows = _rows(cat)
    return _hold_out(rows, models.elastic_net(), models.named_subset(models.feature_names(rows), models.SEASONAL_KEYWORDS))


@query("linear_huber")
def _(cat):
    return _hold_out(_rows(cat), models.huber())


@query("elastic_net_search")
def _(cat):
    rows = _rows(cat)
    return shown(models.elastic_net_search(rows, models.feature_names(rows))[1])


@query("hyperparameter_grid")
def _(cat):
    rows = _rows(cat)
    return shown(models.gbt_search(rows, models.feature_names(rows))[1])


# Short and shallow trees, so that eighty trials end within a minute or two.
_SPACE = {
    "maxIter": search.Range(3, 12, whole=True), "maxDepth": search.Range(2, 4, whole=True), "stepSize": search.Range(0.05, 0.6, log=True),
    "minInstancesPerNode": search.Range(5, 60, whole=True), "featureShare": search.Range(0.4, 1.0),
}


@query("hyperparameter_search")
def _(cat):
    """Eighty trials of an adaptive search over boosted trees of the whole business' series."""
    series = materialise(features.total_series(cat))
    rows = models.training_rows(models.forecast_frame(series, "revenue"))
    table = search.boosting_search(rows, models.feature_names(rows), folds=3, space=_SPACE)[1]
    return shown(table).withColumns({c: flag(F.col(c)) for c in ("stopped", "best")})


@query("feature_importance")
def _(cat):
    rows = _rows(cat)
    names = models.feature_names(rows)
    model = models.pipeline(models.random_forest(), names).fit(rows)
    return shown(models.importance_table(model, names, cat.spark))


@query("oof_stacking")
def _(cat):
    rows = _rows(cat)
    stack, oof = models.stacking(rows, models.feature_names(rows))
    return shown(models.oof_accuracy(oof, stack.names))


@query("cascade_target")
def _(cat):
    series = _series(cat)
    rows = models.training_rows(models.forecast_frame(series, "revenue"))
    _, revenue = models.stacking(rows, models.feature_names(rows))
    stack, oof = models.cascade(series, revenue)
    return shown(models.oof_accuracy(oof, stack.names))


@query("nonneg_blend")
def _(cat):
    rows = _rows(cat)
    bases = {"boost": models.gbt, "ridge": models.ridge, "forest": models.random_forest}
    _, oof = models.out_of_fold(rows, models.feature_names(rows), bases, folds=5, gap=30)
    scale = oof.select(F.expm1("label").alias("y"), *[F.expm1(n).alias(n) for n in bases])
    return shown(blends.best_blend(scale, list(bases), "y")).withColumn("chosen", flag(F.col("chosen")))


@query("block_forecast")
def _(cat):
    series = _series(cat)
    rows = models.training_rows(models.forecast_frame(series, "revenue"))
    model = models.pipeline(models.gbt(), models.feature_names(rows)).fit(rows)
    predicted = models.block_forecast(series, "revenue", model, HORIZON)
    return shown(forecast.spike_clip(predicted, series, "revenue", factor=1.2))


def _day_by_day(cat):
    """Series, and their forecasts by a boosted model that sees the forecasts of earlier days."""
    series = _series(cat)
    known = {**models.known_ahead(), **cal.lunar_features("date", LUNAR)}
    rows = materialise(features.recency_weights(recursion.training_frame(series, "revenue", known)))
    names = [*recursion.PAST, *known]
    model = models.pipeline(models.gbt(), names).fit(rows)
    predicted = recursion.recursive_forecast(series, forecast.horizon(series, HORIZON), "revenue", model, names, known)
    return series, materialise(forecast.spike_clip(predicted, series, "revenue", factor=1.2))


@query("recursive_forecast")
def _(cat):
    return shown(_day_by_day(cat)[1])


@query(
    "recursive_forecast_calendar",
    f"""SELECT series_id, cast(max(date) + interval 1 day AS date) AS first_day, cast(max(date) + interval {HORIZON} day AS date) AS last_day, cast({HORIZON} AS bigint) AS days,
               cast({HORIZON} AS bigint) AS distinct_days, cast({HORIZON} AS bigint) AS within_bounds, cast(0 AS bigint) AS unknown FROM m_series GROUP BY series_id""",
)
def _(cat):
    """Calendar, row count and bounds of the day-by-day forecast."""
    series, found = _day_by_day(cat)
    caps = series.groupBy("series_id").agg((F.percentile("revenue", F.lit(0.95)) * 1.2).alias("cap"))
    return found.join(caps, "series_id").groupBy("series_id").agg(
        F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.count("*").alias("days"), F.count_distinct("date").alias("distinct_days"),
        F.count_if((F.col("forecast") >= 0) & (F.col("forecast") <= F.col("cap"))).alias("within_bounds"), F.count_if(F.col("forecast").isNull()).alias("unknown"),
    )


@query("direct_year_ahead_forecast")
def _(cat):
    series = _series(cat)
    rows = models.training_rows(models.direct_frame(series, "revenue"))
    model = models.pipeline(models.gbt(), models.feature_names(rows)).fit(rows)
    return shown(models.direct_forecast(series, "revenue", model, HORIZON))


@query("residual_model")
def _(cat):
    series = _series(cat)
    rows = models.training_rows(models.residual_frame(series, "revenue"))
    names = models.feature_names(rows, ("trend", "seasonal"))
    model = models.pipeline(models.gbt(), names).fit(rows)
    return shown(models.decomposed_forecast(series, "revenue", model))


@query("stacked_submission")
def _(cat):
    """Revenue stack, COGS stack driven by its forecast, both with the trend frozen, under the ratio guard."""
    series = materialise(features.total_series(cat))
    last = str(series.agg(F.max("date")).first()[0])
    rows = models.training_rows(models.forecast_frame(series, "revenue", last))
    stack, oof = models.stacking(rows, models.feature_names(rows))
    revenue = materialise(models.block_forecast(series, "revenue", stack, HORIZON, last).withColumnRenamed("forecast", "revenue"))
    driver = revenue.select(*models.KEYS, F.log1p("revenue").alias("revenue_pred_log"))
    cogs = models.block_forecast(series, "cogs", models.cascade(series, oof)[0], HORIZON, last, drivers=driver)
    both = revenue.join(cogs, models.KEYS).withColumn("cogs", forecast.ratio_guard("revenue", F.col("forecast"))).drop("forecast")
    from tallyshop.sources.tables import submission_rows

    return submission_rows(both)


def _churn(cat):
    rows = models.churn_rows(customer_base(cat), customers.segments(cat))
    return rows, models.churn_classifier(rows)


@query("churn_classifier")
def _(cat):
    return shown(_churn(cat)[1].report())


@query("churn_confusion")
def _(cat):
    return _churn(cat)[1].confusion()


@query("churn_importances")
def _(cat):
    return shown(_churn(cat)[1].importances())


@query("revenue_saved")
def _(cat):
    rows, churn = _churn(cat)
    return shown(models.revenue_saved(churn.scored, rows))


_CHURN_LABELS = "SELECT customer_id, CASE WHEN segment = 'Churn Risk' THEN 1.0::double ELSE 0.0::double END AS label FROM m_rfm JOIN m_customer USING (customer_id)"
_CHURN_DEALT = f"""SELECT customer_id, label, row_number() OVER (PARTITION BY label ORDER BY ('0x' || substr(md5(customer_id || ':{models.SEED}'), 1, 13))::BIGINT, customer_id)
    <= floor(count(*) OVER (PARTITION BY label) * 0.8::double + 0.5) AS is_train FROM ({_CHURN_LABELS}) l"""


@query("churn_split", f"SELECT customer_id, label, is_train FROM ({_CHURN_DEALT}) d")
def _(cat):
    """Which customers train the churn classifier: four fifths of each class, to the row."""
    return models.churn_rows(customer_base(cat), customers.segments(cat)).select("customer_id", "label", "is_train")


@query(
    "churn_confusion_margins",
    f"SELECT label, count(*) AS customers FROM ({_CHURN_DEALT}) d WHERE NOT is_train GROUP BY label",
)
def _(cat):
    """Test customers per class, added up from the confusion matrix."""
    return _churn(cat)[1].confusion().groupBy("label").agg(F.sum("customers").alias("customers"))


@query(
    "churn_score_auc",
    f"""SELECT cast(sum(label) AS bigint) AS positives, cast(sum(1 - label) AS bigint) AS negatives,
               round((sum(label * rk) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * sum(1 - label)), 6) AS auc
        FROM (SELECT label, rank() OVER (ORDER BY total_items) + (count(*) OVER (PARTITION BY total_items) - 1) / 2.0::double AS rk
              FROM ({_CHURN_LABELS}) l JOIN (SELECT customer_id, cast(total_items AS double) AS total_items FROM m_customer) c USING (customer_id) WHERE total_items IS NOT NULL) x""",
)
def _(cat):
    """How well the number of items bought alone tells churners from others."""
    rows = models.churn_rows(customer_base(cat), customers.segments(cat))
    return shown(models.auc_by_ranks(rows, "label", "total_items"))


def _daily_rows(cat):
    """Training rows from the daily table without the columns that say nothing about the days before the hold-out year."""
    daily = daily_table(cat)
    before = daily.where(F.col("date") < HOLD_OUT)
    names = statistics.numeric_columns(daily, models.LEAKY_COLUMNS)
    ranking = information.feature_ranking(before, names, "Revenue", "1998-01-01")
    return models.daily_rows(daily, useless=tuple(information.useless_features(ranking)))


@query("daily_boosting")
def _(cat):
    """Accuracy on the last year of boosted trees over the daily table, as long as forward folds of the years before say."""
    rows = _daily_rows(cat)
    names = models.feature_names(rows)
    model, lengths = models.staged_boosting(rows.where(F.col("date") < HOLD_OUT), names, folds=3, first=30, limit=120, patience=20)
    scored = models.predict(model, rows.where(F.col("date") >= HOLD_OUT))
    scale = scored.select("series_id", F.expm1("label").alias("y"), F.expm1("prediction").alias("p"))
    trees = lengths.where("chosen").first()["trees"]
    metrics = forecast.forecast_metrics(scale, "y", "p", "series_id", offset=1.0)
    return shown(metrics.withColumns({"features": F.lit(len(names)), "trees": F.lit(trees)}))


@query("boosting_lengths")
def _(cat):
    """Error on forward folds by number of trees, and the number taken."""
    rows = _rows(cat)
    lengths = models.staged_boosting(rows, models.feature_names(rows), folds=3, first=30, limit=240, patience=20, estimator=models.gbt(depth=4, step=0.3))[1]
    return shown(lengths).withColumn("chosen", flag(F.col("chosen")))


FROZEN = ("customer_cumulative", "unique_cities_cumulative", "total_stock_on_hand", "unique_products_in_stock", "avg_fill_rate")


@query(
    "daily_table_forecast_calendar",
    f"""SELECT cast(max(date) + interval 1 day AS date) AS first_day, cast(max(date) + interval {HORIZON} day AS date) AS last_day, cast({HORIZON} AS bigint) AS days, cast(0 AS bigint) AS unknown
        FROM m_spine""",
)
def _(cat):
    """Calendar and gaps of a day-by-day forecast whose drivers (customers, stock) stay at their last known values."""
    daily = daily_table(cat)
    series = daily.select(F.lit("all").alias("series_id"), "date", F.col("Revenue").alias("revenue"), *FROZEN)
    known = models.known_ahead()
    rows = recursion.training_frame(series, "revenue", {**known, **{n: F.col(n).cast("double") for n in FROZEN}})
    names = [*recursion.PAST, *known, *FROZEN]
    model = models.pipeline(models.gbt(), names).fit(materialise(features.recency_weights(rows)))
    future = forecast.frozen_drivers(series, forecast.horizon(series, HORIZON), list(FROZEN))
    found = recursion.recursive_forecast(series, future, "revenue", model, names, known)
    return found.agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.count("*").alias("days"), F.count_if(F.col("forecast").isNull() | (F.col("forecast") < 0)).alias("unknown"))
