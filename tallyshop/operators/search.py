"""Adaptive hyperparameter search: densities of good and bad trials say where to try next.

The driver holds the table of trials (a few numbers each); what a trial fits runs in Spark, several trials side by side. A
trial reports its loss fold by fold and is stopped when it falls behind.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyshop.operators.models import fold_ranges, gbt
from tallyshop.session import materialise


@dataclass(frozen=True)
class Range:
    """Values of one parameter: whole numbers or not, evenly or on a logarithmic scale."""

    low: float
    high: float
    whole: bool = False
    log: bool = False

    def value(self, u: float) -> float | int:
        if self.log:
            found = math.exp(math.log(self.low) + u * (math.log(self.high) - math.log(self.low)))
        else:
            found = self.low + u * (self.high - self.low + (1 if self.whole else 0))
        return int(min(max(math.floor(found), self.low), self.high)) if self.whole else float(min(max(found, self.low), self.high))


@dataclass
class Trial:
    number: int
    place: np.ndarray
    params: dict[str, float | int]
    losses: list[float] = field(default_factory=list)
    stopped: bool = False

    @property
    def loss(self) -> float:
        return float(np.mean(self.losses)) if self.losses else float("inf")


def _density(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log density at each place of a mixture of bells around ``points`` and one even component, per coordinate."""
    n = len(points)
    out = np.zeros(len(at))
    for d in range(points.shape[1]):
        order = np.sort(points[:, d])
        padded = np.concatenate([[0.0], order, [1.0]])
        gaps = np.maximum(padded[1:-1] - padded[:-2], padded[2:] - padded[1:-1])
        width = np.clip(gaps, 1.0 / min(100, 1 + n), 1.0)
        z = (at[:, d, None] - order[None, :]) / width[None, :]
        inside = np.array([0.5 * (math.erf((1 - m) / (w * math.sqrt(2))) - math.erf(-m / (w * math.sqrt(2)))) for m, w in zip(order, width, strict=True)])
        bells = np.exp(-0.5 * z * z) / (math.sqrt(2 * math.pi) * width[None, :] * np.maximum(inside, 1e-12)[None, :])
        out += np.log((bells.sum(axis=1) + 1.0) / (n + 1))
    return out


def propose(trials: list[Trial], dims: int, rng: np.random.Generator, start: int = 16, share: float = 0.2, candidates: int = 32) -> np.ndarray:
    """The next place to try, in the unit cube: at random for the first trials, then where good trials are dense and bad ones are not.

    Good are the best ``share`` of the finished trials; stopped ones are bad. Candidates are drawn around good trials, now and then anywhere.
    """
    if len(trials) < start:
        return rng.random(dims)
    ranked = sorted(trials, key=lambda t: (t.stopped, t.loss, t.number))
    n_good = max(2, math.ceil(share * sum(not t.stopped for t in ranked)))
    good, bad = (np.array([t.place for t in part]) for part in (ranked[:n_good], ranked[n_good:]))
    width = max(0.5 * n_good ** (-1 / (dims + 4)) * float(good.std(axis=0).mean() + 0.05), 0.02)
    picks = good[rng.integers(0, n_good, candidates)] + rng.normal(0, width, (candidates, dims))
    anywhere = rng.random((max(candidates // 8, 1), dims))
    places = np.concatenate([np.abs(1 - np.abs(1 - np.clip(picks, -1, 2))), anywhere])
    score = _density(good, places) - (_density(bad, places) if len(bad) else 0.0)
    return places[int(np.argmax(score))]


def search(
    space: dict[str, Range], objective: Callable[[dict, Callable[[float], bool]], None], trials: int = 80, parallel: int = 4, start: int = 16, seed: int = 42
) -> list[Trial]:
    """Trials in the order in which they were made.

    ``objective(params, report)`` calls ``report(loss)`` after each fold; where that returns True the trial has fallen behind (its mean
    loss so far is above the median, at that fold, of the ``start`` trials that reached it before) and should end. Trials run ``parallel`` at a time, and a
    group only sees the groups before it, so the same seed gives the same trials.
    """
    rng = np.random.default_rng(seed)
    done: list[Trial] = []

    def run(trial: Trial) -> Trial:
        def report(loss: float) -> bool:
            trial.losses.append(float(loss))
            fold = len(trial.losses)
            others = [float(np.mean(t.losses[:fold])) for t in done[-2 * start :] if len(t.losses) >= fold][-start:]
            trial.stopped = len(done) >= start and len(others) >= 4 and trial.loss > float(np.median(others))
            return trial.stopped

        objective(trial.params, report)
        return trial

    with ThreadPool(parallel) as pool:
        while len(done) < trials:
            group, seen = [], list(done)
            for i in range(min(parallel, trials - len(done))):
                place = propose(seen, len(space), rng, start)
                group.append(Trial(len(done) + i, place, {n: r.value(float(u)) for (n, r), u in zip(space.items(), place, strict=True)}))
                seen.append(Trial(len(done) + i, place, {}, [float("inf")], True))  # others of the group keep away from it
            done += pool.map(run, group, chunksize=1)
    return done


def best_trial(trials: list[Trial]) -> Trial:
    """The finished trial with the smallest mean loss."""
    return min((t for t in trials if not t.stopped), key=lambda t: (t.loss, t.number))


BOOSTING_SPACE = {
    "maxIter": Range(20, 120, whole=True), "maxDepth": Range(2, 7, whole=True), "stepSize": Range(0.02, 0.4, log=True),
    "minInstancesPerNode": Range(5, 60, whole=True), "subsamplingRate": Range(0.6, 1.0), "featureShare": Range(0.4, 1.0),
}


def boosting_search(
    rows: DataFrame, features: list[str], trials: int = 80, folds: int = 5, gap: int = 30, space: dict[str, Range] | None = None, parallel: int = 8, seed: int = 42
) -> tuple[PipelineModel, DataFrame]:
    """Boosted trees tuned on forward folds, and the trials: (trial, <parameters>, mae_log, folds_done, stopped, best)."""
    space = space or BOOSTING_SPACE
    assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    ready = materialise(assembler.transform(rows).select("date", "label", "weight", "features"))
    evaluator = RegressionEvaluator(labelCol="label", metricName="mae")
    ranges = fold_ranges(rows, folds, gap)

    def estimator(params: dict):
        model = gbt()
        for name, value in params.items():
            param, setting = ("featureSubsetStrategy", f"{value:.4f}") if name == "featureShare" else (name, value)
            model = model.copy({model.getParam(param): setting})
        return model

    def objective(params: dict, report: Callable[[float], bool]) -> None:
        for train_to, valid_from, valid_to in ranges:
            model = estimator(params).fit(ready.where(F.col("date") <= F.lit(train_to)))
            if report(evaluator.evaluate(model.transform(ready.where(F.col("date").between(F.lit(valid_from), F.lit(valid_to)))))):
                return

    done = search(space, objective, trials, parallel, seed=seed)
    best = best_trial(done)
    table = [(t.number, *[float(t.params[n]) for n in space], t.loss, len(t.losses), t.stopped, t is best) for t in done]
    schema = f"trial int, {', '.join(f'{n} double' for n in space)}, mae_log double, folds_done int, stopped boolean, best boolean"
    return Pipeline(stages=[assembler, estimator(best.params)]).fit(rows), rows.sparkSession.createDataFrame(table, schema)
