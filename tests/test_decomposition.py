"""STL against local regressions solved one by one."""

import math
import random
from datetime import date, timedelta

import numpy as np
import pytest

from tallyshop.operators import decomposition as op

START = date(2020, 1, 1)


def line_at(at, xs, ys, rw, span):
    """One local line by weighted least squares over the nearest points."""
    n = len(xs)
    order = sorted(range(n), key=lambda i: (abs(xs[i] - at), xs[i]))[: min(span, n)]
    order = sorted(order)
    while order[0] > 0 and abs(xs[order[0] - 1] - at) < abs(xs[order[-1]] - at):
        order = [order[0] - 1, *order[:-1]]
    reach = max(abs(xs[i] - at) for i in order) + max(span - n, 0) // 2
    us = [abs(xs[i] - at) / reach if reach else 0 for i in order]
    kernel = [1.0 if u <= 0.001 else (1 - u**3) ** 3 if u <= 0.999 else 0.0 for u in us]
    w = [k * rw[i] for k, i in zip(kernel, order, strict=True)]
    w = w if sum(w) > 0 else kernel
    if sum(v > 0 for v in w) == 1:  # no line through one point
        return float(ys[order[max(range(len(w)), key=w.__getitem__)]])
    a = np.array([[1.0, xs[i] - at] for i in order]) * np.sqrt(w)[:, None]
    b = np.array([ys[i] for i in order]) * np.sqrt(w)
    return float(np.linalg.lstsq(a, b, rcond=None)[0][0])


def plain_stl(y, spans):
    n, p = len(y), spans.period
    trend, rw = [0.0] * n, [1.0] * n
    for outer in range(spans.outer + 1):
        for _ in range(spans.inner):
            cycle = [0.0] * (n + 2 * p)
            for phase in range(p):
                days = list(range(phase, n, p))
                for k in range(-1, len(days) + 1):
                    cycle[phase + (k + 1) * p] = line_at(k, list(range(len(days))), [y[d] - trend[d] for d in days], [rw[d] for d in days], spans.seasonal)
            low = cycle
            for width in (p, p, 3):
                low = [sum(low[i : i + width]) / width for i in range(len(low) - width + 1)]
            low = [line_at(i, range(n), low, [1.0] * n, spans.low_pass) for i in range(n)]
            seasonal = [cycle[p + i] - low[i] for i in range(n)]
            trend = [line_at(i, range(n), [y[j] - seasonal[j] for j in range(n)], rw, spans.trend) for i in range(n)]
        rest = [abs(y[i] - seasonal[i] - trend[i]) for i in range(n)]
        if outer < spans.outer:
            limit = 6 * float(np.median(rest))
            rw = [1.0 if r / limit <= 0.001 else (1 - (r / limit) ** 2) ** 2 if r / limit <= 0.999 else 0.0 for r in rest]
    return trend, seasonal, rw


def made(n, period, seed=1, noise=0.3):
    r = random.Random(seed)
    return [10 + 0.05 * i + 3 * math.sin(2 * math.pi * i / period) + r.gauss(0, noise) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(s, START + timedelta(days=i), v) for s, i, v in rows], "series_id string, date date, v double").repartition(4)


@pytest.mark.parametrize("span", [3, 5, 9, 31, 60])
def test_local_lines_equal_least_squares(span):
    y, rw = np.array(made(40, 7)), np.array([random.Random(i).random() for i in range(40)])
    found = op.Loess(40, span).smooth(y, rw)
    assert found == pytest.approx([line_at(i, range(40), y, rw, span) for i in range(40)], abs=1e-9)


@pytest.mark.parametrize("n,outer", [(61, 0), (70, 4)])
def test_equals_plain_stl(spark, n, outer):
    spans = op.Spans(period=7, seasonal=7, outer=outer)
    data = {"a": made(n, 7, 1), "b": made(n + 3, 7, 2)}
    data["a"][30] += 25
    parts = op.decompose(frame(spark, [(s, i, v) for s, y in data.items() for i, v in enumerate(y)]), "v", spans).collect()
    for s, y in data.items():
        rows = sorted((r for r in parts if r.series_id == s), key=lambda r: r.date)
        trend, seasonal, rw = plain_stl(y, spans)
        assert [r.trend for r in rows] == pytest.approx(trend, abs=1e-6) and [r.seasonal for r in rows] == pytest.approx(seasonal, abs=1e-6)
        assert [r.robust_weight for r in rows] == pytest.approx(rw, abs=1e-5)
        assert [r.trend + r.seasonal + r.residual for r in rows] == pytest.approx(y)


def test_an_outlier_day_does_not_move_the_trend(spark):
    y = made(90, 7, 3)
    spoiled = [*y[:45], y[45] + 60, *y[46:]]

    def trend(values, outer):
        rows = op.decompose(frame(spark, [("s", i, v) for i, v in enumerate(values)]), "v", op.Spans(period=7, outer=outer)).collect()
        return np.array([r.trend for r in sorted(rows, key=lambda r: r.date)]), {r.date: r.robust_weight for r in rows}

    clean, weights = trend(spoiled, 10)
    assert np.abs(clean - trend(y, 10)[0]).max() < 0.1 < 1 < np.abs(trend(spoiled, 0)[0] - trend(y, 0)[0]).max()
    assert weights[START + timedelta(days=45)] == 0


def test_gaps_repeats_and_short_series(spark):
    line = [("gap", i, float(i)) for i in range(30) if i not in (10, 11, 12)] + [("gap", 3, 3.0), ("short", 0, 1.0), ("short", 4, 5.0), ("none", 0, None)]
    rows = op.decompose(frame(spark, line), "v", op.Spans(period=7, outer=1)).collect()
    gap = sorted((r for r in rows if r.series_id == "gap"), key=lambda r: r.date)
    assert [r.value for r in gap] == [float(i) for i in range(30)] and all(abs(r.trend - r.value) < 1e-6 for r in gap)
    short = sorted((r for r in rows if r.series_id == "short"), key=lambda r: r.date)
    assert [r.value for r in short] == [1.0, 2.0, 3.0, 4.0, 5.0] and all(r.trend is None for r in short)
    assert {r.series_id for r in rows} == {"gap", "short"}
    assert op.decompose(frame(spark, line).limit(0), "v").collect() == []


def test_strengths(spark):
    parts = op.decompose(frame(spark, [("s", i, v) for i, v in enumerate(made(140, 7, noise=0.01))]), "v", op.Spans(period=7, outer=2))
    row = op.strengths(parts).first()
    assert row.days == 140 and row.trend_strength > row.residual_strength and row.seasonal_strength > 0.5 and row.residual_strength < 0.05
