"""Day-by-day forecasts against a plain loop over dictionaries that asks the fitted Spark model itself."""

import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyshop.operators import models, recursion

START = date(2018, 1, 1)
DAYS = 1200
AHEAD = 40


def known():
    return {"month": F.month("date").cast("double"), "dow": F.dayofweek("date").cast("double")}


@pytest.fixture(scope="module")
def series(spark):
    """Three series: smooth, with holes, and short of two years."""
    rows = []
    for s, first, holes in (("a", 0, set()), ("b", 0, {5, 6, 700, 701, 702, 836, 1190} | set(range(820, 832))), ("c", 700, {900})):
        for i in range(first, DAYS):
            if i not in holes:
                rows.append((s, START + timedelta(days=i), 100 + 20 * math.sin(i / 58) + 10 * (i % 7) + (i * 37 % 11)))
    return spark.createDataFrame(rows, "series_id string, date date, revenue double").repartition(3).cache()


@pytest.fixture(scope="module")
def future(spark):
    rows = [(s, START + timedelta(days=DAYS + i), float(i % 3)) for s in "abc" for i in range(AHEAD)]
    return spark.createDataFrame([*rows, ("d", START, 0.0), ("a", START, 0.0)], "series_id string, date date, push double").cache()


def fitted(series, estimator):
    rows = recursion.training_frame(series.withColumn("push", F.dayofyear("date") % 3), "revenue", {**known(), "push": F.col("push").cast("double")})
    features = [*recursion.PAST, "month", "dow", "push"]
    return models.pipeline(estimator, features).fit(rows.withColumn("weight", F.lit(1.0))), features


def plain_past(values, day):
    def mean(lag):
        found = [values[day - timedelta(days=lag + d)] for d in range(-7, 8) if day - timedelta(days=lag + d) in values]
        return sum(found) / len(found) if found else None

    def nearest(lag):
        for d in range(0, min(7, lag - 1) + 1):
            for sign in (1, -1):
                at = day - timedelta(days=lag + sign * d)
                if at in values:
                    return values[at]
        return None

    year, two = mean(364), mean(728)
    two = year if two is None else two
    ratio = 1.0 if not two else min(max(year / two, 0.5), 2.0)
    lags = [nearest(k) for k in (7, 14, 28)]
    return year, ratio, [math.log1p(year), math.log1p(two), ratio, *[math.log1p(year if v is None else v) for v in lags]]


@pytest.mark.parametrize("kind", ["boost", "forest", "ridge"])
def test_equals_a_plain_loop_over_the_spark_model(spark, series, future, kind):
    estimator = {"boost": lambda: models.gbt(8, 3), "forest": lambda: models.random_forest(5, 4), "ridge": models.ridge}[kind]()
    model, features = fitted(series, estimator)
    found = recursion.recursive_forecast(series, future, "revenue", model, features, known(), alpha=0.15)
    mine = {(r.series_id, r.date): r.forecast for r in found.collect()}
    values = {s: {r.date: r.revenue for r in series.where(F.col("series_id") == s).collect()} for s in "abc"}
    stage = model.stages[-1]
    from pyspark.ml.linalg import Vectors

    days = 12 if kind == "boost" else 4
    for i in range(days):
        day = START + timedelta(days=DAYS + i)
        for s in "abc":
            year, ratio, past = plain_past(values[s], day)
            x = [*past, float(day.month), float(day.isoweekday() % 7 + 1), float(i % 3)]
            predicted = max(math.expm1(stage.predict(Vectors.dense(x))), 0.0)
            values[s][day] = max(0.15 * year * ratio + 0.85 * predicted, 0.0)
            assert mine[s, day] == pytest.approx(values[s][day], rel=1e-9)
    assert len(mine) == 3 * AHEAD and {s for s, _ in mine} == set("abc")


def test_training_and_serving_see_the_same_past(series):
    rows = {(r.series_id, r.date): r for r in recursion.training_frame(series, "revenue", {}).collect()}
    for s in "abc":
        values = {r.date: r.revenue for r in series.where(F.col("series_id") == s).collect()}
        ring = recursion.Ring()
        for i in range(DAYS):
            day = START + timedelta(days=i)
            number = (day - date(1970, 1, 1)).days
            if (s, day) in rows:
                served = ring.past(number)[0]
                assert np.allclose([rows[s, day][c] for c in recursion.PAST], [served[c] for c in recursion.PAST], rtol=1e-12)
            ring.put(number, values.get(day, np.nan))
    assert {s for s, _ in rows} == set("abc")


def test_forecasts_feed_back(series, future):
    model, features = fitted(series, models.ridge())
    pushed = future.withColumn("push", F.when(F.col("date") == START + timedelta(days=DAYS), 50.0).otherwise(F.col("push")))
    plain, moved = ({r.date: r.forecast for r in recursion.recursive_forecast(series, f, "revenue", model, features, known()).where("series_id = 'a'").collect()} for f in (future, pushed))
    first = START + timedelta(days=DAYS)
    changed = {(d - first).days for d in plain if abs(plain[d] - moved[d]) > 1e-9}
    assert 0 in changed and 7 in changed and not changed & {1, 2, 3, 4, 5, 6}


def test_short_history_gaps_and_unknown_features(spark, series, future):
    model, features = fitted(series, models.ridge())
    with pytest.raises(ValueError):
        recursion.recursive_forecast(series, future.drop("push"), "revenue", model, features, known())
    one = spark.createDataFrame([("a", START + timedelta(days=DAYS - 1), 5.0)], "series_id string, date date, revenue double")
    found = recursion.recursive_forecast(one, future, "revenue", model, features, known()).collect()
    assert len(found) == AHEAD and all(r.forecast >= 0 and r.series_id == "a" for r in found)
    assert recursion.recursive_forecast(one.limit(0), future, "revenue", model, features, known()).collect() == []
