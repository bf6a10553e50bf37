"""Day-by-day forecasts: every predicted day becomes history for the days after it.

Series are spread over the cluster, one group per series, and a group is bounded by the calendar: the last two years of
history, kept in a ring of days, and the days ahead. What a day needs that does not depend on earlier forecasts (calendar, trend,
drivers) comes from the DataFrame; the loop only adds lags of the ring.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyshop.functions.columns import clip, dbl
from tallyshop.operators.features import SERIES, centred_year_ago, lag_nearest
from tallyshop.session import shared_folder

# The loop runs in Python workers, which need no path to this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEYS = [SERIES, "date"]
YEAR, TWO_YEARS = 364, 728
SHORT_LAGS = (7, 14, 28)
# Days to either side of a year lag that are averaged, and at most how far from a lag the nearest known day may lie.
AROUND = 7
RING = TWO_YEARS + AROUND + 1
RATIO_LOW, RATIO_HIGH = 0.5, 2.0
PAST = ("past_year", "past_two_years", "past_ratio", *[f"past_lag{k}" for k in SHORT_LAGS])


def _reach(lag: int) -> int:
    """How far from a lag to look for a known day: never on the day itself or later."""
    return min(AROUND, lag - 1)


# --- training side -------------------------------------------------------------------------------


def past_columns(value: str) -> dict[str, Column]:
    """What the loop knows of the days before a day, as columns over a series (training side).

    past_year and past_two_years are log means of the 15 days around 364 and 728 days ago, the latter falling back on the former;
    past_ratio is the first over the second, held to 0.5 .. 2 and 1 where the second is 0; past_lag7, 14 and 28 are logs of the
    value that many days ago, else of the nearest known day (farther back first), else past_year.
    """
    year = centred_year_ago(value, YEAR, AROUND)
    two = F.coalesce(centred_year_ago(value, TWO_YEARS, AROUND), year)
    share = F.try_divide(year, two)
    ratio = F.when(share.isNull(), 1.0).otherwise(clip(share, RATIO_LOW, RATIO_HIGH))

    def log(c: Column) -> Column:
        return F.when(c.isNotNull(), F.log1p(F.greatest(c, F.lit(0.0))))

    lags = {f"past_lag{k}": log(F.coalesce(lag_nearest(value, k, _reach(k), alternate=True), year)) for k in SHORT_LAGS}
    return {"past_year": log(year), "past_two_years": log(two), "past_ratio": ratio, **lags}


def training_frame(series: DataFrame, value: str, known: dict[str, Column]) -> DataFrame:
    """Rows with label log1p(value), the past columns and ``known`` ones; days without a known year before are left out."""
    base = series.select(*KEYS, dbl(value).alias("_v"), *[c.alias(n) for n, c in known.items()])
    rows = base.withColumns({"label": F.log1p(clip("_v", low=0.0)), **past_columns("_v")})
    return rows.where("label IS NOT NULL AND past_year IS NOT NULL").drop("_v")


# --- models without a session ----------------------------------------------------------------------


@dataclass
class Trees:
    """A fitted forest or boosted ensemble as arrays: one row per tree, one column per node."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    weight: np.ndarray
    depth: int

    def predict(self, x: np.ndarray) -> float:
        rows = np.arange(len(self.weight))
        node = np.zeros(len(rows), dtype=np.int64)
        for _ in range(self.depth):
            at = self.feature[rows, node]
            lower = x[np.maximum(at, 0)] <= self.threshold[rows, node]
            node = np.where(at < 0, node, np.where(lower, self.left[rows, node], self.right[rows, node]))
        return float(self.value[rows, node] @ self.weight)


@dataclass
class Linear:
    """A fitted linear model."""

    coefficients: np.ndarray
    intercept: float

    def predict(self, x: np.ndarray) -> float:
        return float(x @ self.coefficients + self.intercept)


def portable(model: PipelineModel, spark) -> Trees | Linear:
    """The last stage of a fitted pipeline in a form that tasks can apply row by row: tree ensembles and linear models.

    Node tables come from the model's own saved Parquet form and are as large as the model.
    """
    stage = model.stages[-1]
    if hasattr(stage, "coefficients"):
        return Linear(stage.coefficients.toArray(), float(stage.intercept))
    folder = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    stage.write().save(folder)
    nodes = spark.read.parquet(f"{folder}/data").select("treeID", "nodeData.*").select(
        "treeID", "id", "prediction", "leftChild", "rightChild", "split.featureIndex", F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold")
    ).collect()
    shape = (max(n.treeID for n in nodes) + 1, max(n.id for n in nodes) + 1)
    feature, left, right = (np.full(shape, fill, dtype=np.int64) for fill in (-1, 0, 0))
    threshold, value = np.zeros(shape), np.zeros(shape)
    for n in nodes:
        at = n.treeID, n.id
        value[at] = n.prediction
        if n.leftChild >= 0:
            feature[at], threshold[at], left[at], right[at] = n.featureIndex, n.threshold, n.leftChild, n.rightChild
    weight = np.array(stage.treeWeights, dtype=float)
    mean = weight / weight.sum() if type(stage).__name__.startswith("RandomForest") else weight
    return Trees(feature, threshold, left, right, value, mean, max(t.depth for t in stage.trees))


# --- the loop ----------------------------------------------------------------------------------------


class Ring:
    """Values of the last two years by day; a day without a value is NaN."""

    def __init__(self) -> None:
        self.values = np.full(RING, np.nan)

    def put(self, day: int, value: float) -> None:
        self.values[day % RING] = value

    def mean_around(self, day: int) -> float:
        found = self.values[np.arange(day - AROUND, day + AROUND + 1) % RING]
        found = found[~np.isnan(found)]
        return float(found.mean()) if len(found) else float("nan")

    def nearest(self, day: int, reach: int) -> float:
        for off in range(reach + 1):
            for at in (day - off, day + off):  # farther back first
                if not np.isnan(self.values[at % RING]):
                    return float(self.values[at % RING])
        return float("nan")

    def past(self, day: int) -> tuple[dict[str, float], float, float]:
        """The past columns of a day, the plain mean around a year ago and the ratio of the two years."""
        year = self.mean_around(day - YEAR)
        two = self.mean_around(day - TWO_YEARS)
        two = year if np.isnan(two) else two
        ratio = 1.0 if np.isnan(year) or np.isnan(two) or two == 0 else min(max(year / two, RATIO_LOW), RATIO_HIGH)
        out = {"past_year": np.log1p(max(year, 0.0)), "past_two_years": np.log1p(max(two, 0.0)), "past_ratio": ratio}
        for k in SHORT_LAGS:
            lag = self.nearest(day - k, _reach(k))
            out[f"past_lag{k}"] = np.log1p(max(year if np.isnan(lag) else lag, 0.0))
        return out, year, ratio


def recursive_forecast(
    series: DataFrame, future: DataFrame, value: str, model: PipelineModel, features: list[str], known: dict[str, Column], alpha: float = 0.15
) -> DataFrame:
    """(series_id, date, forecast) of the days in ``future`` (series_id, date, drivers), one after the other.

    ``model`` predicts log1p(value) from ``features``: past columns, ``known`` ones and drivers of ``future``. A day's forecast is
    (1 - alpha) of the prediction plus alpha of the mean around a year ago times the ratio of the last two years (the prediction where
    there is no year ago), at least 0; days after it see that forecast as history. A past column without any known day counts
    as 0 in the model. Series without history have no forecast; days that lie in the history are not predicted again.
    """
    asked = [f for f in features if f not in PAST]
    strange = set(asked) - set(known) - set(future.columns)
    if strange:
        raise ValueError(f"no source for {sorted(strange)}")
    spark = series.sparkSession
    flat = portable(model, spark)
    ends = series.groupBy(SERIES).agg(F.max("date").alias("_end"))
    unknown = [F.lit(None).cast("double").alias(n) for n in asked]
    recent = series.join(ends, SERIES).where(F.datediff("_end", "date") < RING)
    history = recent.select(SERIES, "date", F.unix_date("date").alias("day"), dbl(value).alias("v"), F.lit(False).alias("ahead"), *unknown)
    rows = future.withColumns({n: known[n] for n in asked if n in known})
    ahead = rows.join(ends, SERIES).where("date > _end").select(
        SERIES, "date", F.unix_date("date").alias("day"), F.lit(None).cast("double").alias("v"), F.lit(True).alias("ahead"), *[dbl(n).alias(n) for n in asked]
    )
    order = [features.index(n) for n in asked]
    past_at = {n: i for i, n in enumerate(features) if n in PAST}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by("day")
        days, values, is_ahead = (table.column(c).to_numpy() for c in ("day", "v", "ahead"))
        matrix = np.column_stack([table.column(n).to_numpy() for n in asked]) if asked else np.zeros((len(days), 0))
        ring, x, last, found = Ring(), np.zeros(len(features)), None, []
        for i, day in enumerate(days.tolist()):
            for gap in range(max((last or day) + 1, day - RING), day):
                ring.put(gap, np.nan)
            last = day
            if not is_ahead[i]:
                ring.put(day, values[i])
                continue
            past, year, ratio = ring.past(day)
            x[order] = matrix[i]
            for n, at in past_at.items():
                x[at] = 0.0 if np.isnan(past[n]) else past[n]
            predicted = max(float(np.expm1(flat.predict(x))), 0.0)
            base = predicted if np.isnan(year) else year
            forecast = max(alpha * base * ratio + (1 - alpha) * predicted, 0.0)
            ring.put(day, forecast)
            found.append((i, forecast))
        if found:
            at = pa.array([i for i, _ in found])
            yield pa.RecordBatch.from_arrays(
                [table.column(SERIES).take(at).combine_chunks(), table.column("date").take(at).combine_chunks(), pa.array([v for _, v in found])], names=[*KEYS, "forecast"]
            )

    kind = series.schema[SERIES].dataType.simpleString()
    return history.unionByName(ahead).groupBy(SERIES).applyInArrow(run, f"{SERIES} {kind}, date date, forecast double")
