"""Weights of forecast blends: non-negative least squares, and the smallest absolute error on the simplex.

Rows stay in Spark. A pass brings one Gram matrix (columns × columns sums) to the driver, where active-set
solvers work on it; least squares takes one pass, the absolute error at most ``PASSES``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyshop.functions.columns import dbl

# Passes over the rows at most, how little the error may still fall, and the smallest residual that counts, as a share of the mean one.
PASSES, GAIN, FLOOR = 40, 1e-7, 1e-4


def active_set(gram: np.ndarray, right: np.ndarray, simplex: bool = False) -> np.ndarray:
    """Weights w of at least 0 (and summing to 1 on the simplex) that minimise w'Gw - 2w'b.

    Columns enter one at a time, that with the steepest descent first; a step that would make a weight negative ends where it is 0 and
    that column leaves. A column enters only if the loss falls, so no set of columns comes back.
    """
    k = len(right)
    tolerance = 1e-12 * (float(np.abs(gram).max(initial=0.0)) + float(np.abs(right).max(initial=0.0)) + 1e-300)
    w = np.zeros(k)
    inside: list[int] = []
    if simplex:
        inside = [int(np.argmin(np.diag(gram) - 2 * right))]
        w[inside] = 1.0

    def best(columns: list[int]) -> np.ndarray:
        m = len(columns)
        g, b = gram[np.ix_(columns, columns)], right[columns]
        if not simplex:
            return np.linalg.lstsq(g, b, rcond=None)[0]
        scale = max(float(np.abs(g).max()), 1e-300)
        system = np.block([[g / scale, np.ones((m, 1))], [np.ones((1, m)), np.zeros((1, 1))]])
        return np.linalg.lstsq(system, np.concatenate([b / scale, [1.0]]), rcond=None)[0][:m]

    def entered(column: int) -> tuple[np.ndarray, list[int]]:
        trial, members = w.copy(), [*inside, column]
        while members:
            aim = best(members)
            if (aim > 0).all():
                trial[:] = 0
                trial[members] = aim
                break
            now = trial[members]
            steps = [(now[i] / (now[i] - aim[i]) if now[i] > aim[i] else 0.0, i) for i in range(len(members)) if aim[i] <= 0]
            share, out = min(steps)
            trial[members] = now + share * (aim - now)
            trial[members[out]] = 0.0
            members = [c for i, c in enumerate(members) if i != out]
        return trial, members

    for _ in range(8 * k + 8):
        slope = gram @ w - right
        level = float(slope[inside].mean()) if simplex else 0.0
        outside = sorted((j for j in range(k) if j not in inside and slope[j] < level - tolerance), key=lambda j: slope[j])
        loss = float(w @ gram @ w - 2 * w @ right)
        for j in outside:
            trial, members = entered(j)
            if float(trial @ gram @ trial - 2 * trial @ right) < loss:
                w, inside = np.maximum(trial, 0.0), members
                break
        else:
            break
    return w / w.sum() if simplex else w


def gram_sums(rows: DataFrame, columns: list[Column], target: Column, weight: Column | None = None, more: list[Column] | None = None) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Gram matrix, right side and further sums in one pass; a null in any column leaves its row out."""
    k = len(columns)
    complete = target.isNotNull()
    for c in columns:
        complete = complete & c.isNotNull()
    weight = F.lit(1.0) if weight is None else weight
    cells = [F.sum(weight * columns[i] * columns[j]) for i in range(k) for j in range(i, k)]
    right = [F.sum(weight * c * target) for c in columns]
    row = rows.where(complete).agg(*[c.alias(f"c{i}") for i, c in enumerate([*cells, *right, *(more or [])])]).first()
    sums = [float(v or 0.0) for v in row]
    gram, at = np.zeros((k, k)), 0
    for i in range(k):
        for j in range(i, k):
            gram[i, j] = gram[j, i] = sums[at]
            at += 1
    return gram, np.array(sums[at : at + k]), sums[at + k :]


def nonnegative_weights(rows: DataFrame, columns: list[str], target: str, intercept: bool = False, ridge: float = 0.0) -> list[float]:
    """Least squares with weights of at least zero (the intercept too, last); ``ridge`` is added to the Gram matrix's diagonal."""
    gram, right, _ = gram_sums(rows, [*[dbl(c) for c in columns], *([F.lit(1.0)] if intercept else [])], dbl(target))
    return [float(v) for v in active_set(gram + ridge * np.eye(len(right)), right)]


def _residual(columns: list[str], weights: np.ndarray, target: str) -> Column:
    mixed = F.lit(0.0)
    for c, w in zip(columns, weights.tolist(), strict=True):
        mixed = mixed + dbl(c) * F.lit(w)
    return F.abs(dbl(target) - mixed)


def absolute_error_weights(rows: DataFrame, columns: list[str], target: str, passes: int = PASSES) -> tuple[list[float], float, int]:
    """Weights on the simplex with the smallest mean absolute error, that error, and the passes taken.

    Iterated weights: each pass solves least squares with rows weighed by one over their last residual (not below
    a ten-thousandth of the mean one), starting from equal weights, and stops when the error falls by less than a ten-millionth.
    On the simplex a residual is the weighted sum of the columns' own errors, so only those are multiplied.
    """
    errors = [dbl(target) - dbl(c) for c in columns]
    w = np.full(len(columns), 1.0 / len(columns))
    best, best_error, taken = w, float("inf"), 0
    error = None
    for taken in range(1, passes + 1):
        residual = _residual(columns, w, target)
        weight = F.lit(1.0) if error is None else 1 / F.greatest(residual, F.lit(max(error * FLOOR, 1e-300)))
        gram, right, (total, n) = gram_sums(rows, errors, F.lit(0.0), weight, [F.sum(residual), F.count("*")])
        if not n:
            return [float(v) for v in w], 0.0, taken
        last, error = error, total / n
        if error < best_error:
            best, best_error = w, error
        if error == 0 or (last is not None and taken > 3 and abs(last - error) <= GAIN * last):
            break
        w = active_set(gram, right, simplex=True)
    return [float(v) for v in best], best_error, taken


def best_blend(rows: DataFrame, columns: list[str], target: str, ridge: float = 0.0) -> DataFrame:
    """Least-squares weights (scaled to add up to 1) against those with the smallest absolute error, by MAE.

    The two are compared as they would be applied: (method, mae, chosen, passes, weight_<column>...).
    """
    raw = nonnegative_weights(rows, columns, target, ridge=ridge)
    total = sum(raw) or 1.0
    scaled = np.array([v / total for v in raw])
    *_, (loss, n) = gram_sums(rows, [dbl(c) for c in columns], dbl(target), None, [F.sum(_residual(columns, scaled, target)), F.count("*")])
    weights, error, passes = absolute_error_weights(rows, columns, target)
    table = [("least_squares", loss / n if n else 0.0, 2, scaled.tolist()), ("absolute_error", error, passes, weights)]
    chosen = min(table, key=lambda r: r[1])[0]
    data = [(m, float(e), m == chosen, p, *map(float, w)) for m, e, p, w in table]
    schema = "method string, mae double, chosen boolean, passes int, " + ", ".join(f"weight_{c} double" for c in columns)
    return rows.sparkSession.createDataFrame(data, schema)
