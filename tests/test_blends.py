"""Blend weights against exhaustive search."""

import random
from itertools import combinations, permutations, product

import numpy as np
import pytest

from tallyshop.operators import blends


def exhaustive(gram, right):
    """Least squares over every set of columns."""
    k = len(right)
    best, loss = np.zeros(k), 0.0
    for size in range(1, k + 1):
        for chosen in combinations(range(k), size):
            w = np.zeros(k)
            w[list(chosen)] = np.linalg.lstsq(gram[np.ix_(chosen, chosen)], right[list(chosen)], rcond=None)[0]
            now = float(w @ gram @ w - 2 * w @ right)
            if (w >= -1e-12).all() and now < loss - 1e-15:
                best, loss = np.maximum(w, 0), now
    return best, loss


def table(spark, n, k, seed, noise=1.0):
    r = np.random.default_rng(seed)
    y = r.normal(50, 10, n)
    columns = [y * r.uniform(0.7, 1.2) + r.normal(r.uniform(-5, 5), noise * (i + 1), n) for i in range(k)]
    rows = [(float(y[i]), *[float(c[i]) for c in columns]) for i in range(n)]
    names = [f"m{i}" for i in range(k)]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in ["y", *names])).coalesce(1).cache(), names, np.array(rows)


@pytest.mark.parametrize("k", [1, 2, 3, 6, 9])
def test_active_set_equals_exhaustive_search(k):
    for seed in range(12):
        r = np.random.default_rng(seed)
        x, y = r.normal(0, 1, (30, k)), r.normal(0, 1, 30)
        gram, right = x.T @ x, x.T @ y
        w = blends.active_set(gram, right)
        assert (w >= 0).all() and float(w @ gram @ w - 2 * w @ right) == pytest.approx(exhaustive(gram, right)[1], abs=1e-9)


def test_simplex_solution_beats_a_fine_grid():
    for seed in range(10):
        r = np.random.default_rng(seed)
        x, y = r.normal(0, 1, (40, 3)), r.normal(0, 1, 40)
        gram, right = x.T @ x, x.T @ y
        w = blends.active_set(gram, right, simplex=True)
        grid = [np.array([a, b, 100 - a - b]) / 100 for a, b in product(range(101), repeat=2) if a + b <= 100]
        assert w.sum() == pytest.approx(1) and (w >= 0).all()
        assert w @ gram @ w - 2 * w @ right <= min(g @ gram @ g - 2 * g @ right for g in grid) + 1e-9


def test_three_columns_and_an_intercept(spark):
    df, names, rows = table(spark, 80, 3, 1)
    x, y = rows[:, 1:], rows[:, 0]
    assert blends.nonnegative_weights(df, names, "y") == pytest.approx(exhaustive(x.T @ x, x.T @ y)[0], abs=1e-8)
    one = np.column_stack([x, np.ones(len(y))])
    assert blends.nonnegative_weights(df, names, "y", intercept=True) == pytest.approx(exhaustive(one.T @ one, one.T @ y)[0], abs=1e-6)


def test_absolute_error_of_twelve_columns_in_bounded_passes(spark):
    df, names, rows = table(spark, 300, 12, 5)
    weights, error, passes = blends.absolute_error_weights(df, names, "y")
    x, y = rows[:, 1:], rows[:, 0]
    assert passes <= blends.PASSES and sum(weights) == pytest.approx(1) and min(weights) >= 0
    assert error == pytest.approx(np.abs(y - x @ weights).mean())
    # no move of weight from one column to another lowers the error by more than two ten-thousandths
    for i, j in permutations(range(12), 2):
        for step in (0.001, 0.01, 0.1):
            moved = np.array(weights)
            step = min(step, moved[i])
            moved[i], moved[j] = moved[i] - step, moved[j] + step
            assert np.abs(y - x @ moved).mean() >= error * (1 - 2e-4)


def test_absolute_error_beats_the_grid_of_three(spark):
    df, names, rows = table(spark, 200, 3, 8, noise=4.0)
    x, y = rows[:, 1:], rows[:, 0]
    _, error, _ = blends.absolute_error_weights(df, names, "y")
    grid = min(np.abs(y - x @ (np.array([a, b, 50 - a - b]) / 50)).mean() for a, b in product(range(51), repeat=2) if a + b <= 50)
    assert error <= grid * (1 + 1e-5)


def test_ties_nulls_and_empty_tables(spark):
    schema = "y double, a double, b double"
    same = spark.createDataFrame([(float(i), float(i), float(i)) for i in range(9)] + [(None, 1.0, 1.0), (5.0, None, 1.0)], schema)
    weights, error, _ = blends.absolute_error_weights(same, ["a", "b"], "y")
    assert error == 0 and sum(weights) == pytest.approx(1)
    assert sum(blends.nonnegative_weights(same, ["a", "b"], "y")) == pytest.approx(1)
    empty = blends.best_blend(same.limit(0), ["a", "b"], "y").collect()
    assert [r.mae for r in empty] == [0.0, 0.0]
    found = {r.method: r for r in blends.best_blend(same.selectExpr("y", "a", "a * 0 + 3 AS b"), ["a", "b"], "y").collect()}
    assert found["absolute_error"].weight_a == pytest.approx(1) and sum(r.chosen for r in found.values()) == 1


def test_one_hostile_row_does_not_decide(spark):
    r = random.Random(2)
    rows = [(float(v), v + r.gauss(0, 1), v * 0.5) for v in range(1, 100)] + [(1e3, 0.0, 1e3)]
    df = spark.createDataFrame(rows, "y double, good double, bad double")
    weights, *_ = blends.absolute_error_weights(df, ["good", "bad"], "y")
    assert weights[0] > 0.9 and blends.nonnegative_weights(df, ["good", "bad"], "y")[0] < 0.6
