"""The adaptive search on known surfaces and on a small series."""

import math
import random
from datetime import date, timedelta

import numpy as np
import pytest

from tallyshop.operators import search

SPACE = {"a": search.Range(-5, 5), "b": search.Range(0.001, 1.0, log=True), "c": search.Range(1, 40, whole=True), "d": search.Range(0, 1)}


def surface(p):
    return (p["a"] - 2) ** 2 / 10 + (math.log10(p["b"]) + 1.5) ** 2 + ((p["c"] - 12) / 10) ** 2 + 0.3 * abs(p["d"] - 0.7)


def folds(seen=None):
    def objective(params, report):
        for fold in range(4):
            if seen is not None:
                seen.append(fold)
            if report(surface(params) + 0.01 * fold):
                return

    return objective


def test_better_than_as_many_random_trials():
    adaptive, drawn = [], []
    for seed in range(10):
        adaptive.append(search.best_trial(search.search(SPACE, folds(), trials=80, seed=seed)).loss)
        rng = np.random.default_rng(1000 + seed)
        drawn.append(min(surface({n: r.value(u) for (n, r), u in zip(SPACE.items(), rng.random(4))}) + 0.015 for _ in range(80)))
    assert np.mean(adaptive) < 0.6 * np.mean(drawn) and sum(a < d for a, d in zip(adaptive, drawn)) >= 8


def test_losing_trials_are_stopped_by_fold_and_runs_repeat():
    seen = []
    done = search.search(SPACE, folds(seen), trials=80, seed=3)
    again = search.search(SPACE, folds(), trials=80, seed=3)
    assert [(t.params, t.losses) for t in done] == [(t.params, t.losses) for t in again]
    assert len(done) == 80 and [t.number for t in done] == list(range(80))
    stopped = [t for t in done if t.stopped]
    assert len(stopped) >= 5 and all((len(t.losses) < 4) <= t.stopped for t in done) and len(seen) == sum(len(t.losses) for t in done) < 320
    assert not search.best_trial(done).stopped and search.best_trial(done).loss == min(t.loss for t in done if not t.stopped)


def test_ranges():
    whole = search.Range(3, 5, whole=True)
    assert {whole.value(u / 100) for u in range(101)} == {3, 4, 5} and isinstance(whole.value(0.5), int)
    log = search.Range(0.01, 1.0, log=True)
    assert log.value(0) == pytest.approx(0.01) and log.value(0.5) == pytest.approx(0.1) and log.value(1) == pytest.approx(1)


def test_boosting_search_on_a_series(spark):
    r = random.Random(1)
    rows = [("s", date(2020, 1, 1) + timedelta(days=i), 5 + math.sin(i / 9) + r.gauss(0, 0.1), math.sin(i / 9), r.random(), 1.0) for i in range(160)]
    df = spark.createDataFrame(rows, "series_id string, date date, label double, a double, b double, weight double").coalesce(1).cache()
    space = {"maxIter": search.Range(1, 4, whole=True), "maxDepth": search.Range(1, 3, whole=True), "featureShare": search.Range(0.5, 1.0)}
    model, table = search.boosting_search(df, ["a", "b"], trials=6, folds=2, gap=3, space=space)
    found = table.orderBy("trial").collect()
    best = next(t for t in found if t.best)
    assert len(found) == 6 and best.mae_log == min(t.mae_log for t in found) and best.folds_done == 2
    assert model.stages[-1].getNumTrees == int(best.maxIter)
