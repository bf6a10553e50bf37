"""Mutual information of numeric columns with a target by nearest neighbours, and the ranking of features by it."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyshop.functions.columns import clip, dbl, flag
from tallyshop.operators.quality import long_values

# The groups run in Python workers, which need no path to this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Size of the noise that parts equal values, in standard deviations, and points whose neighbours are found at a time.
NOISE, AT_ONCE = 1e-10, 256
EULER = 0.57721566490153286


def nearest_neighbour_information(x: np.ndarray, y: np.ndarray, neighbours: int) -> float:
    """Kraskov's first estimator, in nats: the k-th neighbour in the larger of both distances, and points nearer than that on each axis."""
    n = len(x)
    if n <= neighbours:
        return 0.0
    psi = np.concatenate([[0.0, 0.0], np.cumsum(1.0 / np.arange(1, n + 1))]) - EULER  # digamma of whole numbers from 1
    total = 0.0
    for start in range(0, n, AT_ONCE):
        dx, dy = (np.abs(v[start : start + AT_ONCE, None] - v[None, :]) for v in (x, y))
        radius = np.partition(np.maximum(dx, dy), neighbours, axis=1)[:, neighbours, None]  # the point itself is the first
        total += (psi[(dx < radius).sum(axis=1)] + psi[(dy < radius).sum(axis=1)]).sum()
    return max(0.0, float(psi[n] + psi[neighbours] - total / n))


def scaled_pairs(df: DataFrame, features: list[str], target: Column, key: Column) -> DataFrame:
    """(feature, x, y) rows: each feature and the target over their deviation, null as 0, with noise that the key decides."""
    data = df.select(key.alias("_key"), dbl(target).alias("_target"), *[dbl(f).alias(f) for f in features]).where("_target IS NOT NULL")
    values = long_values(data, [*features, "_target"], ("_key",)).select("_key", "column", F.coalesce("value", F.lit(0.0)).alias("value"))
    spread = values.groupBy("column").agg(F.stddev_pop("value").alias("s"), F.avg(F.abs("value")).alias("m"))
    scale = F.when(F.col("s") > 0, F.col("s")).otherwise(1.0)
    noise = (F.pmod(F.xxhash64("column", "_key"), F.lit(1 << 30)) / F.lit(float(1 << 30)) - 0.5) * NOISE
    # one row per column of the table
    noisy = values.join(F.broadcast(spread), "column").select("column", "_key", (F.col("value") / scale + noise * F.greatest(F.lit(1.0), F.col("m") / scale)).alias("v"))
    goal = noisy.where("column = '_target'").select("_key", F.col("v").alias("y"))
    return noisy.where("column <> '_target'").join(goal, "_key").select(F.col("column").alias("feature"), F.col("v").alias("x"), "y")


def mutual_information(df: DataFrame, features: list[str], target: Column, key: Column, neighbours: int = 5) -> DataFrame:
    """(feature, mi) of each feature with the target, in nats.

    Features are spread over the cluster; a group holds one feature on the days of the calendar (``key`` names a row),
    and distances are taken some hundred days at a time.
    """
    pairs = scaled_pairs(df, features, target, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by([("x", "ascending"), ("y", "ascending")])
        mi = nearest_neighbour_information(table.column("x").to_numpy(), table.column("y").to_numpy(), neighbours)
        yield pa.RecordBatch.from_arrays([pa.array([table.column("feature")[0].as_py()]), pa.array([mi])], names=["feature", "mi"])

    return pairs.groupBy("feature").applyInArrow(run, "feature string, mi double")


def feature_ranking(daily: DataFrame, features: list[str], target: str, era_start: str, neighbours: int = 5, useless: float = 0.01) -> DataFrame:
    """Mutual information with the log target over the whole calendar and over a recent era: change, ranks, useless flag."""
    goal, key = F.log1p(clip(dbl(target), low=0.0)), F.unix_date("date")
    full = mutual_information(daily, features, goal, key, neighbours).withColumnRenamed("mi", "mi_full")
    recent = daily.where(F.col("date") >= F.lit(era_start).cast("date"))
    era = mutual_information(recent, features, goal, key, neighbours).withColumnRenamed("mi", "mi_era")
    ranks = [F.row_number().over(Window.orderBy(F.round(m, 9).desc(), "feature")) for m in ("mi_full", "mi_era")]
    return full.join(era, "feature").select(
        "feature", "mi_full", "mi_era", (F.col("mi_era") - F.col("mi_full")).alias("delta"), ranks[0].alias("rank_full"), ranks[1].alias("rank_era"),
        flag((F.col("mi_full") < useless) & (F.col("mi_era") < useless)).alias("useless"),
    )  # one row per feature


def useless_features(ranking: DataFrame) -> list[str]:
    """Names of the features that the ranking calls useless in both eras: at most as many as there are columns."""
    return sorted(r.feature for r in ranking.where("useless = 1").select("feature").collect())
