"""Seasonal-trend decomposition by LOESS (STL) with robustness weights, per daily series.

Series are spread over the cluster; a group is one series, which the calendar bounds. A local line needs five windowed
sums (of w, wx, wx², wy and wxy), taken for all days of a series at once. After Cleveland, Cleveland, McRae and Terpenning (1990).
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyshop.functions.columns import dbl
from tallyshop.operators.features import SERIES

# The groups run in Python workers, which need no path to this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _odd(x: float) -> int:
    """The smallest odd whole number of at least ``x``."""
    whole = math.ceil(x)
    return whole if whole % 2 else whole + 1


@dataclass(frozen=True)
class Spans:
    """Days of a period, points of each smoother, and how often the loops run."""

    period: int = 365
    seasonal: int = 7
    inner: int = 2
    outer: int = 15

    @property
    def trend(self) -> int:
        return _odd(1.5 * self.period / (1 - 1.5 / self.seasonal))

    @property
    def low_pass(self) -> int:
        return _odd(self.period + 1)


class Loess:
    """Local lines through ``n`` evenly spaced points, each from the ``span`` points next to a target, by tricube weights.

    With fewer points than the span all are used and the kernel widens by half of what is missing.
    """

    def __init__(self, n: int, span: int, targets: np.ndarray | None = None) -> None:
        at = np.arange(n) if targets is None else targets
        width = min(span, n)
        first = np.clip(at - width // 2, 0, n - width)
        self.near = first[:, None] + np.arange(width)
        self.offset = (self.near - at[:, None]).astype(float)
        reach = np.abs(self.offset).max(axis=1, keepdims=True) + max(span - n, 0) // 2
        u = np.abs(self.offset) / np.where(reach > 0, reach, 1.0)
        self.kernel = np.where(u <= 0.001, 1.0, np.where(u <= 0.999, (1 - u**3) ** 3, 0.0))
        self.range = max(n - 1, 1)

    def smooth(self, values: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Lines through the last axis of ``values``, read at the targets; where all weights are 0 the values count alike."""
        w = self.kernel * weights[..., self.near]
        total = w.sum(axis=-1)
        w = np.where((total > 0)[..., None], w, self.kernel)
        total, y, x = w.sum(axis=-1), values[..., self.near], self.offset
        mean_x, mean_y = (w * x).sum(axis=-1) / total, (w * y).sum(axis=-1) / total
        spread = (w * x * x).sum(axis=-1) / total - mean_x**2
        lean = (w * x * y).sum(axis=-1) / total - mean_x * mean_y
        steep = spread > (0.001 * self.range) ** 2
        return mean_y - np.where(steep, lean / np.where(steep, spread, 1.0), 0.0) * mean_x


def _moving_mean(values: np.ndarray, width: int) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(values)])
    return (sums[width:] - sums[:-width]) / width


def _bisquare(residual: np.ndarray) -> np.ndarray:
    """Robustness weights: 1 near the curve, 0 beyond six median absolute residuals."""
    size = np.abs(residual)
    limit = 6 * np.median(size)
    u = size / limit if limit > 0 else np.where(size > 0, 1.0, 0.0)
    return np.where(u <= 0.001, 1.0, np.where(u <= 0.999, (1 - u**2) ** 2, 0.0))


def stl(values: np.ndarray, spans: Spans) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trend, seasonal part and robustness weights of evenly spaced values (two periods at least)."""
    n, period = len(values), spans.period
    trend_line, low_line = Loess(n, spans.trend), Loess(n, spans.low_pass)
    cycles = {k: Loess(k, spans.seasonal, np.arange(-1, k + 1)) for k in {n // period, -(-n // period)}}
    trend, seasonal, weights = np.zeros(n), np.zeros(n), np.ones(n)
    for last in range(spans.outer + 1):
        for _ in range(spans.inner):
            loose = values - trend
            cycle = np.zeros(n + 2 * period)
            for k, line in cycles.items():
                phases = [p for p in range(period) if len(range(p, n, period)) == k]
                if phases:
                    days = np.array(phases)[:, None] + period * np.arange(k)
                    smooth = line.smooth(loose[days], weights[days])
                    cycle[np.array(phases)[:, None] + period * np.arange(k + 2)] = smooth
            low = low_line.smooth(_moving_mean(_moving_mean(_moving_mean(cycle, period), period), 3), np.ones(n))
            seasonal = cycle[period : period + n] - low
            trend = trend_line.smooth(values - seasonal, weights)
        if last < spans.outer:
            weights = _bisquare(values - seasonal - trend)
    return trend, seasonal, weights


def decompose(daily: DataFrame, value: str, spans: Spans = Spans()) -> DataFrame:
    """(series_id, date, value, trend, seasonal, residual, robust_weight) for every calendar day of each series.

    Days without a value are interpolated on the straight line between their neighbours first. A series shorter than two
    periods has null parts; of repeated days the mean counts; a series without any value gives no rows.
    """
    days = daily.where(F.col("date").isNotNull()).groupBy(SERIES, "date").agg(F.avg(dbl(value)).alias("v")).where("v IS NOT NULL")
    rows = days.select(SERIES, "date", F.unix_date("date").cast("long").alias("day"), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by("day")
        known = table.column("day").to_numpy()
        day = np.arange(known[0], known[-1] + 1)
        values = np.interp(day, known, table.column("v").to_numpy())
        names = [SERIES, "date", "value", "trend", "seasonal", "residual", "robust_weight"]
        name = table.column(SERIES).combine_chunks()
        head = [name.take(pa.array(np.zeros(len(day), dtype=np.int64))), pa.array(day.astype("datetime64[D]")), pa.array(values)]
        if len(day) < 2 * spans.period:
            parts = [pa.nulls(len(day), pa.float64())] * 4
        else:
            trend, seasonal, weights = stl(values, spans)
            parts = [pa.array(p) for p in (trend, seasonal, values - trend - seasonal, weights)]
        yield pa.RecordBatch.from_arrays([*head, *parts], names=names)

    kind = daily.schema[SERIES].dataType.simpleString()
    return rows.groupBy(SERIES).applyInArrow(run, f"{SERIES} {kind}, date date, value double, trend double, seasonal double, residual double, robust_weight double")


def strengths(parts: DataFrame) -> DataFrame:
    """Deviation of each part over the deviation of the series, and the days whose robustness weight is 0."""
    spread = F.stddev_samp("value")
    return parts.groupBy(SERIES).agg(
        F.count("*").alias("days"), *[F.try_divide(F.stddev_samp(c), spread).alias(f"{c}_strength") for c in ("trend", "seasonal", "residual")],
        F.count_if(F.col("robust_weight") == 0).alias("outlier_days"),
    )
