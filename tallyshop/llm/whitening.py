"""Embedding whitening: an exact covariance by polarisation, its leading components, and whitened coordinates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyshop.llm.common import staged

SCALE = 256
COMPONENTS = 4
# 32-bit limbs of an exact total that leaves a task: totals up to 2^127 over up to 2^31 tasks.
LIMBS = 4
# Squares and sums of integers below these stay in 64 bits; beyond them numpy counts in Python integers.
SAFE, LONG_MAX = 1 << 60, (1 << 63) - 1


@dataclass(frozen=True)
class Model:
    """What ``fit`` finds: the number of distinct vectors, exact sums, components (one a row) and their eigenvalues."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float


def _usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != F.lit(float("inf"))))


def quantised(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, x): entries as floor(256 * c) in 64 bits. Rows whose vector is null or holds a null or non-finite entry are left out.

    Vectors of one length make a table: rows of another length than the most frequent (of ties the longest) are left out too.
    Entries beyond 64 bits take the nearest 64-bit value.
    """
    whole = vectors.where(_usable(F.col(column))).select(
        "vec_id", F.transform(column, lambda c: F.floor(c.cast("double") * SCALE).cast("long")).alias("x")
    )
    lengths = whole.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    return whole.where(F.size("x") == (lengths[0].dims if lengths else 0))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of integer arrays, in Python integers where 64 bits might not do."""
    if max(int(np.abs(v.astype(object)).max()) if v.dtype == object else max(-int(v.min()), int(v.max())) for v in (a, b)) < SAFE:
        return a.astype(np.int64) + b.astype(np.int64)
    return a.astype(object) + b.astype(object)


def _column_squares(values: np.ndarray) -> list[int]:
    """Exact sum of the squares of each column."""
    top = max(-int(values.min()), int(values.max()))
    if top * top * len(values) >= 1 << 63:
        values = values.astype(object)
    return [int(t) for t in (values * values).sum(axis=0)]


def _limbs(total: int) -> list[int]:
    return [(total >> (32 * i)) & 0xFFFFFFFF for i in range(LIMBS - 1)] + [total >> (32 * (LIMBS - 1))]


def _totals(rows: DataFrame, measure) -> list[int]:
    """Sums over all rows of the exact numbers that ``measure`` makes of a matrix; as many as it gives, whatever the rows.

    Each task adds its own batches up and sends one row per number, in 32-bit limbs that Spark can sum without overflow.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: list[int] | None = None
        for batch in batches:
            if batch.num_rows:
                found = measure(_matrix(batch.column(0)))
                totals = found if totals is None else [a + b for a, b in zip(totals, found, strict=True)]
        if totals:
            limbs = list(zip(*map(_limbs, totals), strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(totals)), pa.int64()), *[pa.array(limb, pa.int64()) for limb in limbs]], names=["k", *[f"l{i}" for i in range(LIMBS)]]
            )

    parts = rows.select("x").mapInArrow(work, "k long, " + ", ".join(f"l{i} long" for i in range(LIMBS)))
    sums = parts.groupBy("k").agg(*[F.sum(f"l{i}").alias(f"l{i}") for i in range(LIMBS)]).collect()
    return [sum(r[f"l{i}"] << (32 * i) for i in range(LIMBS)) for r in sorted(sums, key=lambda r: r.k)]


def _first_moments(x: np.ndarray) -> list[int]:
    low, high = x & 0xFFFFFFFF, x >> 32
    return [len(x), *[int(a) + (int(b) << 32) for a, b in zip(low.sum(axis=0), high.sum(axis=0), strict=True)]]


def _polar_squares(middle: list[int]):
    """Sums of squares of every dimension, then of every sum of two dimensions, of values centred at ``middle``."""

    def measure(x: np.ndarray) -> list[int]:
        centred = _plus(x, -np.array(middle, dtype=object)[None, :].repeat(len(x), axis=0) if max(map(abs, middle)) >= SAFE else -np.array(middle, dtype=np.int64)[None, :])
        found = _column_squares(centred)
        for i in range(centred.shape[1] - 1):
            found += _column_squares(_plus(centred[:, i : i + 1], centred[:, i + 1 :]))
        return found

    return measure


def exact_covariance(fit_list: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """(n, S, C) of a table of distinct vectors ``x``: C[i][j] is the exact sum over rows of (n*x_i - S_i) * (n*x_j - S_j).

    By polarisation: tasks only ever square one number, a centred dimension or a centred sum of two; half of what
    the square sum of a pair has over those of its two dimensions is the pair's cross product. So that squares stay short, rows are
    centred at the integer next to the mean, and the exact remainder is taken off the totals.
    """
    n, *sums = _totals(fit_list, _first_moments) or [0]
    if n == 0 or not sums:
        return n, sums, []
    middle = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * m for s, m in zip(sums, middle, strict=True)]
    squares = _totals(fit_list, _polar_squares(middle))
    dims = len(sums)
    own = [n * n * squares[i] - n * rest[i] ** 2 for i in range(dims)]
    cross = [[0] * dims for _ in range(dims)]
    at = dims
    for i in range(dims):
        cross[i][i] = own[i]
        for j in range(i + 1, dims):
            both = n * n * squares[at] - n * (rest[i] + rest[j]) ** 2
            cross[i][j] = cross[j][i] = (both - own[i] - own[j]) // 2
            at += 1
    return n, sums, cross


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n*x - S, exact."""
    top = max(-int(x.min()), int(x.max()), 1) if x.size else 1
    if top * n + max(map(abs, sums)) < SAFE:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def _whiten(z: np.ndarray, n: int, components: np.ndarray, eigenvalues: np.ndarray) -> np.ndarray:
    return (z.astype(np.float64) / n) @ components.T / np.sqrt(eigenvalues)


def _identity_error(fit_list: DataFrame, n: int, sums: tuple[int, ...], components: np.ndarray, eigenvalues: np.ndarray) -> float:
    """Largest absolute entry of (covariance of the whitened fit list - identity). Rows are centred by the exact mean before they are multiplied."""
    k = len(components)
    pairs = [(a, b) for a in range(k) for b in range(a, k)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + len(pairs))
        for batch in batches:
            if batch.num_rows:
                w = _whiten(_centred(_matrix(batch.column(0)), n, sums), n, components, eigenvalues)
                total += np.concatenate([w.sum(axis=0), [w[:, a] @ w[:, b] for a, b in pairs]])
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in total], names=[f"s{i}" for i in range(len(total))])

    names = [f"s{i}" for i in range(k + len(pairs))]
    parts = fit_list.select("x").mapInArrow(work, ", ".join(f"{c} double" for c in names))
    means = np.array(parts.agg(*[F.sum(c).alias(c) for c in names]).first()) / n
    return float(max(abs(means[k + i] - means[a] * means[b] - (a == b)) for i, (a, b) in enumerate(pairs)))


def fit(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Model | None:
    """The whitening of a table of vectors, from each distinct quantised vector once; None if no vector can be used.

    The covariance is exact up to its last rounding to doubles, then ``eigh``. Components are unit vectors, numbered by falling
    eigenvalue, with the sign that makes their largest entry positive. Directions without variance (an eigenvalue that is
    zero up to rounding) are no components, so there may be fewer than asked for, or none.
    What comes to the driver are dims * (dims + 1) / 2 totals, whatever the rows.
    """
    return _fit(quantised(vectors, column), components)


def _fit(rows: DataFrame, components: int) -> Model | None:
    fit_list = staged(rows.select("x").distinct(), "distinct-vectors")
    n, sums, cross = exact_covariance(fit_list)
    if n == 0:
        return None
    if not sums:
        return Model(n, (), np.zeros((0, 0)), np.zeros(0), np.zeros(0), 0.0)
    values, vectors = np.linalg.eigh(np.array([[c / n**3 for c in row] for row in cross], dtype=np.float64))
    order = np.argsort(-values, kind="stable")
    real = [i for i in order if values[i] > max(values[order[0]], 0.0) * len(sums) * np.finfo(float).eps][:components]
    basis = vectors[:, real].T
    if len(real):
        basis = basis * np.sign(basis[np.arange(len(real)), np.abs(basis).argmax(axis=1)])[:, None]
    kept, trace = values[real], sum(cross[i][i] for i in range(len(sums))) / n**3
    error = _identity_error(fit_list, n, tuple(sums), basis, kept) if len(real) else 0.0
    return Model(n, tuple(sums), basis, kept, kept / trace if len(real) else kept, error)


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def apply(rows: DataFrame, model: Model) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of quantised rows, a row per component.

    deviation is the exact sum over dimensions of (n*x - S)^2, null where it passes 64 bits.
    """
    k = len(model.components)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            if not rows or not k:
                continue
            z = _centred(_matrix(batch.column(1)), model.n, model.sums)
            deviation = [d if d <= LONG_MAX else None for d in _column_squares(z.T)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(rows), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, model.n)), pa.array([d for d in deviation for _ in range(k)], pa.int64()),
                    pa.array(_whiten(z, model.n, model.components, model.eigenvalues).ravel()), pa.array(np.tile(model.explained, rows)),
                    pa.array(np.full(rows * k, model.identity_error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(work, SCHEMA)


def whiten(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates of every usable row of ``vectors``, fitted on its distinct quantised vectors.

    Every row with a usable vector is returned once per component, repeated rows and null ids included, but copies of a vector
    count once in the fit. An empty table, one without usable vectors, and one whose vectors are all equal give no rows. Other columns
    are ignored. A vector that a third of all rows share is one row per task before it moves.
    """
    rows = quantised(vectors, column)
    model = _fit(rows, components)
    return vectors.sparkSession.createDataFrame([], SCHEMA) if model is None else apply(rows, model)
