"""Tail probabilities against published tables and closed forms."""

import math

import pytest

from tallyshop.functions import distributions as d


def values(spark, rows, schema, expression):
    """The expression for each row, in order."""
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "at int, " + schema)
    return [r.p for r in frame.select("at", expression.alias("p")).orderBy("at").collect()]


def test_log_gamma_and_erfc(spark):
    xs = [0.05, 0.5, 1.0, 1.5, 2.0, 3.7, 10.0, 171.3, 1e5]
    assert values(spark, [(x,) for x in xs], "x double", d.log_gamma("x")) == pytest.approx([math.lgamma(x) for x in xs], rel=1e-13, abs=1e-13)
    zs = [i / 7 for i in range(-30, 100)]
    assert values(spark, [(z,) for z in zs], "x double", d.erfc("x")) == pytest.approx([math.erfc(z) for z in zs], rel=1e-11)


# Published critical values: (statistic, degrees of freedom, tail probability).
STUDENT = [(12.7062047364, 1, 0.05), (4.3026527297, 2, 0.05), (2.2281388520, 10, 0.05), (2.7500, 30, 0.01000), (2.7045, 40, 0.01000), (1.9799304051, 120, 0.05)]
CHI_SQUARE = [(3.8414588207, 1, 0.05), (5.9914645471, 2, 0.05), (11.0704976935, 5, 0.05), (18.3070380533, 10, 0.05), (124.3421134, 100, 0.05), (6.6348966010, 1, 0.01)]


def test_published_tables(spark):
    found = values(spark, [(t, float(v)) for t, v, _ in STUDENT], "t double, v double", d.student_two_sided("t", "v"))
    assert found[:3] + found[5:] == pytest.approx([0.05] * 4, abs=1e-8) and found[3:5] == pytest.approx([0.01, 0.01], rel=2e-3)
    found = values(spark, [(x, float(k)) for x, k, _ in CHI_SQUARE], "x double, k double", d.chi_square_sf("x", "k"))
    assert found == pytest.approx([p for *_, p in CHI_SQUARE], abs=1e-8)


def chi_even(x, k):
    """Even degrees of freedom: a Poisson distribution function."""
    return math.fsum(math.exp(i * math.log(x / 2) - x / 2 - math.lgamma(i + 1)) for i in range(k // 2))


def student_closed(t, v):
    """Finite sums for whole degrees of freedom (odd and even)."""
    angle, cosine = math.atan(t / math.sqrt(v)), v / (v + t * t)
    if v == 1:
        return 1 - 2 * angle / math.pi
    term = total = math.sqrt(cosine) if v % 2 else 1.0
    for i in range(1, (v - 1) // 2 if v % 2 else v // 2):
        term *= (2 * i) / (2 * i + 1) * cosine if v % 2 else (2 * i - 1) / (2 * i) * cosine
        total += term
    return 1 - 2 / math.pi * (angle + math.sin(angle) * total) if v % 2 else 1 - math.sin(angle) * total


def test_closed_forms_at_any_degrees(spark):
    rows = [(f * k, k) for k in (2, 4, 10, 40, 200, 1000) for f in (0.01, 0.5, 0.9, 1.0, 1.2, 1.5)]
    assert values(spark, [(x, float(k)) for x, k in rows], "x double, k double", d.chi_square_sf("x", "k")) == pytest.approx([chi_even(x, k) for x, k in rows], rel=1e-9, abs=1e-250)
    rows = [(t, v) for v in (1, 2, 3, 5, 10, 11, 100, 101, 1000, 10_000, 19_999, 20_002, 100_000) for t in (0.01, 0.5, 1.0, 1.96, 3.0)]
    assert values(spark, [(t, float(v)) for t, v in rows], "t double, v double", d.student_two_sided("t", "v")) == pytest.approx([student_closed(t, v) for t, v in rows], abs=1e-10)


def test_large_degrees_and_fractions(spark):
    rows = [(39_998.0 + x, 39_998.0) for x in (-400, 0, 300, 700)] + [(40_006.0 + x, 40_006.0) for x in (-400, 0, 300, 700)]
    assert values(spark, rows, "x double, k double", d.chi_square_sf("x", "k")) == pytest.approx([chi_even(x, int(k)) for x, k in rows], abs=1e-6)
    # gamma_q(a + 1, x) = gamma_q(a, x) + x^a e^-x / gamma(a + 1) holds for any a
    a, x = 2.3, 4.1
    low, high = (values(spark, [(v, x)], "a double, x double", d.gamma_q("a", "x"))[0] for v in (a, a + 1))
    assert high - low == pytest.approx(x**a * math.exp(-x) / math.gamma(a + 1), rel=1e-11)


def test_edges(spark):
    assert values(spark, [(0.0, 3.0), (-1.0, 3.0), (None, 3.0), (1.0, None), (1.0, 0.0)], "x double, k double", d.chi_square_sf("x", "k")) == [1.0, 1.0, None, None, None]
    assert values(spark, [(0.0, 3.0), (None, 3.0), (1.0, 0.0), (1e6, 3.0)], "t double, v double", d.student_two_sided("t", "v"))[:3] == [1.0, None, None]
    found = values(spark, [(1.0, 5), (-1.0, 5), (0.5, 2), (0.0, 10), (None, 9)], "r double, n int", d.correlation_p("r", "n"))
    assert found == [0.0, 0.0, None, 1.0, None]
