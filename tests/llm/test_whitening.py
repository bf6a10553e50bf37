"""Whitening against exact fractions and numpy's own covariance."""

import math
from fractions import Fraction

import numpy as np
import pytest

from tallyshop.llm import whitening
from tallyshop.llm.queries import op12_whitening

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(parts)


def quantise(rows):
    return [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows]


def exact(rows):
    """n, S and the exact covariance as fractions, over distinct vectors."""
    fit = sorted({tuple(x) for _, x in rows})
    n, dims = len(fit), len(fit[0])
    sums = [sum(x[d] for x in fit) for d in range(dims)]
    centred = [[Fraction(x[d]) - Fraction(sums[d], n) for d in range(dims)] for x in fit]
    return n, sums, [[sum(c[i] * c[j] for c in centred) / n for j in range(dims)] for i in range(dims)]


def check(found, rows, top=4):
    n, sums, cov = exact(rows)
    values, vectors = np.linalg.eigh(np.array(cov, dtype=float))
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(top, sum(v > values[0] * 1e-12 for v in values))
    trace = float(sum(cov[d][d] for d in range(len(sums))))
    by = {}
    for r in found:
        by.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    signs = {}
    for vec_id, x in rows:
        assert sorted(by[vec_id]) == list(range(1, k + 1))
        y = np.array([float(Fraction(a) - Fraction(s, n)) for a, s in zip(x, sums, strict=True)])
        for c in range(k):
            r = by[vec_id][c + 1][0]
            assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
            mine = y @ vectors[:, c] / math.sqrt(values[c])
            if abs(mine) > 1e-3:
                assert signs.setdefault(c, mine * r.whitened > 0) == (mine * r.whitened > 0)
            assert abs(abs(mine) - abs(r.whitened)) < 1e-7
            assert abs(r.explained - values[c] / trace) < 1e-9 and r.identity_error < 1e-8


def gaussian(n, dims, seed=1):
    spread = np.arange(1, dims + 1)[::-1] / dims
    return [(i, [float(np.float32(c)) for c in row]) for i, row in enumerate(np.random.default_rng(seed).normal(0.3, 1, (n, dims)) * spread)]


def test_equals_exact_fractions(spark):
    rows = gaussian(150, 7) + [(900, gaussian(3, 7)[0][1]), (900, gaussian(3, 7)[0][1])]
    found = whitening.whiten(table(spark, rows)).collect()
    assert len(found) == 4 * len(rows)
    check(found, quantise(rows))


def test_polarisation_gives_exact_cross_products(spark):
    rows = quantised = [(i, [float(v) for v in row]) for i, row in enumerate(np.random.default_rng(3).integers(-9, 9, (40, 5)))]
    fit = whitening.quantised(table(spark, rows)).select("x").distinct()
    n, sums, cross = whitening.exact_covariance(fit)
    m, totals, cov = exact(quantise(quantised))
    assert (n, sums) == (m, totals)
    assert [[Fraction(c, n**3) for c in row] for row in cross] == cov


def test_large_entries_stay_exact(spark):
    rows = [(i, [1e16 * (i % 4), -3e16 + i * 1e12, float(i)]) for i in range(20)]
    vectors = spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<double>")
    fit = whitening.quantised(vectors).select("x").distinct()
    n, sums, cross = whitening.exact_covariance(fit)
    m, totals, cov = exact([(i, [math.floor(256 * c) for c in v]) for i, v in rows])
    assert (n, sums) == (m, totals) and [[Fraction(c, n**3) for c in row] for row in cross] == cov
    assert whitening.whiten(vectors).where("deviation IS NULL").count() > 0


def test_unusable_rows_are_left_out(spark):
    rows = gaussian(30, 3)
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, float("nan"), 0.0]), (103, [float("inf"), 0.0, 0.0]), (104, []), (105, [1.0])]
    found = whitening.whiten(table(spark, rows + bad + [(None, rows[0][1])])).collect()
    assert {r.vec_id for r in found} == {i for i, _ in rows} | {None}
    check([r for r in found if r.vec_id is not None], quantise(rows), top=3)


def test_degenerate_tables(spark):
    assert whitening.whiten(table(spark, [])).collect() == []
    assert whitening.whiten(table(spark, [(1, None)])).collect() == []
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    line = [(i, [float(i), 2.0 * i, 5.0]) for i in range(6)]
    found = whitening.whiten(table(spark, line)).collect()
    assert {r.component for r in found} == {1} and len(found) == 6
    check(found, quantise(line), top=1)


def test_copies_count_once_and_partitioning_does_not_matter(spark):
    rows = gaussian(40, 4)
    hot = rows + [(1000 + i, rows[0][1]) for i in range(300)]
    a = {(r.vec_id, r.component): r for r in whitening.whiten(table(spark, hot, 1)).collect()}
    b = {(r.vec_id, r.component): r for r in whitening.whiten(table(spark, hot, 9)).collect()}
    assert a.keys() == b.keys() and all(a[k].deviation == b[k].deviation and abs(a[k].whitened - b[k].whitened) < 1e-12 for k in a)
    assert {r.n for r in a.values()} == {40}


@pytest.mark.parametrize("clash", ["x", "n", "component", "whitened"])
def test_clashing_columns(spark, clash):
    rows = gaussian(20, 4)
    found = whitening.whiten(table(spark, rows).selectExpr("*", f"1 AS {clash}")).collect()
    check(found, quantise(rows))


def test_query(spark):
    frame = op12_whitening(spark, FOLDER)
    assert dict(frame.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    found = frame.collect()
    assert len(found) == 4 * len(rows)
    n, dims = len({tuple(x) for _, x in quantise(rows)}), 64
    x = np.array([v for _, v in quantise(rows)], dtype=float)
    values = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    assert {r.n for r in found} == {n} and dims == x.shape[1]
    for r in found:
        assert abs(r.explained - values[r.component - 1] / values.sum()) < 1e-9 and r.identity_error < 1e-9
