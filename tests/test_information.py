"""Nearest-neighbour mutual information against a plain estimator."""

import math
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tallyshop.operators import information as op

START = date(2019, 1, 1)


def psi(n):
    return sum(1 / i for i in range(1, n)) - 0.57721566490153286


def plain(x, y, k):
    n, total = len(x), 0.0
    for i in range(n):
        radius = sorted(max(abs(x[i] - x[j]), abs(y[i] - y[j])) for j in range(n) if j != i)[k - 1]
        total += psi(1 + sum(abs(x[i] - x[j]) < radius for j in range(n) if j != i)) + psi(1 + sum(abs(y[i] - y[j]) < radius for j in range(n) if j != i))
    return max(0.0, psi(n) + psi(k) - total / n)


@pytest.fixture(scope="module")
def daily(spark):
    r = random.Random(4)
    rows = []
    for i in range(500):
        y = r.gauss(0, 1)
        rows.append((START + timedelta(days=i), 100 + 10 * y, y + r.gauss(0, 0.5), r.gauss(0, 1), float(round(y)), 7, None if i % 3 else y, 1e6 + y * y))
    return spark.createDataFrame(rows, "date date, goal double, close double, noise double, steps double, same int, holes double, far double").repartition(4)


FEATURES = ["close", "noise", "steps", "same", "holes", "far"]


def test_equals_plain_estimator_on_500_rows(daily):
    pairs = {}
    for r in op.scaled_pairs(daily, FEATURES, F.col("goal"), F.unix_date("date")).collect():
        pairs.setdefault(r.feature, []).append((r.x, r.y))
    found = {r.feature: r.mi for r in op.mutual_information(daily, FEATURES, F.col("goal"), F.unix_date("date")).collect()}
    assert set(found) == set(FEATURES)
    for f in FEATURES:
        assert found[f] == pytest.approx(plain(*zip(*pairs[f]), 5), abs=1e-6)
    assert found["close"] > 0.5 > 0.1 > found["noise"] and found["same"] < 0.1 and found["steps"] > 0.5 and found["far"] > 0.3


def test_estimates_a_known_value(spark):
    r = random.Random(9)
    rho, rows = 0.9, []
    for i in range(3000):
        a, b = r.gauss(0, 1), r.gauss(0, 1)
        rows.append((i, a, rho * a + math.sqrt(1 - rho * rho) * b))
    df = spark.createDataFrame(rows, "i int, x double, y double")
    assert op.mutual_information(df, ["x"], F.col("y"), F.col("i")).first().mi == pytest.approx(-0.5 * math.log(1 - rho * rho), abs=0.05)


def test_ranking_and_small_tables(spark, daily):
    table = op.feature_ranking(daily, FEATURES, "goal", "2019-09-01").orderBy("rank_full").collect()
    assert [r.rank_full for r in table] == [1, 2, 3, 4, 5, 6] and sorted(r.rank_era for r in table) == [1, 2, 3, 4, 5, 6]
    assert all(r.delta == pytest.approx(r.mi_era - r.mi_full) and r.useless == int(r.mi_full < 0.01 and r.mi_era < 0.01) for r in table)
    assert op.useless_features(op.feature_ranking(daily, FEATURES, "goal", "2019-09-01", useless=10.0)) == sorted(FEATURES)
    few = op.mutual_information(daily.limit(5), FEATURES, F.col("goal"), F.unix_date("date")).collect()
    assert {r.mi for r in few} == {0.0} and len(few) == len(FEATURES)
    assert op.mutual_information(daily.limit(0), FEATURES, F.col("goal"), F.unix_date("date")).collect() == []
