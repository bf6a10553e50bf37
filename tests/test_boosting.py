"""Staged boosting and models on the daily table."""

import math
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tallyshop.operators import models

START = date(2018, 1, 1)


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(1)
    data = []
    for i in range(400):
        a, b = math.sin(i / 9), r.random()
        data.append(("s", START + timedelta(days=i), 5 + 2 * a + (b > 0.5) + r.gauss(0, 0.3), a, b, r.random(), 1.0))
    return spark.createDataFrame(data, "series_id string, date date, label double, a double, b double, c double, weight double").repartition(2).cache()


def test_length_stops_below_the_limit_and_prefixes_agree(rows):
    estimator = models.gbt(depth=3, step=0.3).setSubsamplingRate(1.0).setFeatureSubsetStrategy("all")  # samples depend on how rows lie
    model, table = models.staged_boosting(rows, ["a", "b", "c"], folds=2, gap=5, first=4, limit=64, patience=6, estimator=estimator)
    found = table.orderBy("trees").collect()
    chosen = next(x for x in found if x.chosen)
    assert [x.trees for x in found] == list(range(1, found[0].last + 1)) and sum(x.chosen for x in found) == 1
    assert chosen.trees < chosen.limit and chosen.trees + 6 <= chosen.last and chosen.mae_log == min(x.mae_log for x in found)
    assert model.stages[-1].getNumTrees == chosen.trees
    ready = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(rows)
    errors = []
    for train_to, valid_from, valid_to in models.fold_ranges(rows, 2, 5):
        whole = estimator.copy().setMaxIter(found[0].last).fit(ready.where(F.col("date") <= F.lit(train_to)))
        errors.append(whole.evaluateEachIteration(ready.where(F.col("date").between(F.lit(valid_from), F.lit(valid_to))), "absolute"))
    assert np.allclose(np.mean(errors, axis=0), [x.mae_log for x in found], rtol=1e-9)


def test_limit_is_kept(rows):
    _, table = models.staged_boosting(rows, ["a", "b"], folds=2, gap=5, first=3, limit=5, patience=50, estimator=models.gbt(depth=2))
    assert table.count() == 5 and table.where("chosen").count() == 1


def test_daily_rows_hold_no_leaks(spark):
    days = [(START + timedelta(days=i), float(100 + i % 7), 50.0, i, i % 5, 3, 0 if i % 2 else 4, 1.5, 9) for i in range(500)]
    daily = spark.createDataFrame(days, "date date, Revenue double, COGS double, order_id int, sessions int, total_stock_on_hand int, promo_flag int, payment_value double, traffic_direct int")
    rows = models.daily_rows(daily, useless=("promo_flag", "label_lag60"))
    names = models.feature_names(rows)
    assert not {"Revenue", "COGS", "payment_value", "label", "weight", "date", "series_id", "traffic_direct", "promo_flag", "label_lag60"} & set(names)
    assert {"label_lag7", "label_mean30", "sessions_yoy", "order_id_lag7", "total_stock_on_hand"} <= set(names)
    assert rows.count() == 500 - 365 and rows.dropna().count() == 500 - 365
    first = rows.orderBy("date").first()
    assert first.label_lag7 == pytest.approx(math.log1p(100 + (365 - 7) % 7)) and first.date == START + timedelta(days=365)
