"""Models are trained on the features that they are served."""

import math
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tallyshop.operators import models

START = date(2015, 1, 1)
DAYS = 5 * 365


@pytest.fixture(scope="module")
def series(spark):
    rows = [(s, START + timedelta(days=i), 100 + 30 * math.sin(i / 58.1 + len(s)) + (i * 7 % 13)) for s in ("a", "bb") for i in range(DAYS)]
    return spark.createDataFrame(rows, "series_id string, date date, revenue double").repartition(2).cache()


def test_direct_training_rows_equal_the_rows_of_a_forecast_made_then(series):
    frame = models.direct_frame(series, "revenue")
    cut = START + timedelta(days=DAYS - 1 - 365 * 2)
    past = series.where(F.col("date") <= cut).select("series_id", "date", F.log1p("revenue").alias("label"))
    ahead = past.select("series_id").distinct().withColumn("date", F.explode(F.sequence(F.lit(cut + timedelta(days=1)), F.lit(cut + timedelta(days=365)))))
    served = {(r.series_id, r.date): r for r in models.direct_rows(past, ahead).collect()}
    names = [c for c in frame.columns if c not in ("series_id", "date", "label")]
    trained = {(r.series_id, r.date): r for r in frame.collect() if cut < r.date <= cut + timedelta(days=365)}
    assert len(served) == len(trained) == 2 * 365
    for key, row in trained.items():
        assert [row[n] for n in names] == pytest.approx([served[key][n] for n in names], nan_ok=True)
    # a lag of one day on the hundredth day ahead comes from a year before
    key = ("a", cut + timedelta(days=100))
    source = START + timedelta(days=(key[1] - START).days - 1 - 365)
    value = series.where((F.col("series_id") == "a") & (F.col("date") == source)).first().revenue
    assert trained[key]["label_lag1"] == pytest.approx(math.log1p(value))


def test_sources_beyond_a_year_are_known(series):
    future = models.horizon(series, 548)
    logged = series.select("series_id", "date", F.log1p("revenue").alias("label"))
    rows = models.direct_rows(logged, future)
    assert rows.count() == 2 * 548 and rows.dropna().count() == 2 * 548 and rows.where("label_lag1 = 0").count() == 0


def test_residual_lags_are_the_same_on_both_sides_and_never_missing(series):
    frame = models.residual_frame(series, "revenue")
    trained = frame.where("label IS NOT NULL")
    assert trained.count() > 0 and trained.select(*[f"resid_lag{k}" for k in models.RESIDUAL_LAGS]).dropna().count() == trained.count()
    rows = models.training_rows(frame)
    names = models.feature_names(rows, ("trend", "seasonal"))
    model = models.pipeline(models.ridge(), names).fit(rows)
    out = models.decomposed_forecast(series, "revenue", model)
    assert out.count() == 2 * 357 and out.where("forecast IS NULL OR forecast < 10 OR forecast > 400").count() == 0
