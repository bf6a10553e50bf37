"""Tail probabilities as column expressions (no Python per row).

The regularised incomplete gamma and beta functions are summed by higher-order functions over a fixed number of terms, so any
degrees of freedom will do. Up to 40,000 degrees (20,000 of Student's t) probabilities are right to nine digits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyshop.functions.columns import col, dbl

# Terms of the gamma series and fraction, and of the beta fraction. They converge like the square root of the larger parameter.
GAMMA_TERMS, BETA_TERMS = 1300, 300
# From SHIFT on Stirling's series gives 1e-15; beyond LARGE the tails are taken from the normal distribution.
SHIFT, LARGE = 10, 20_000.0
TINY = 1e-300


def log_gamma(x: Column | str) -> Column:
    """Logarithm of the gamma function for x > 0: Stirling's series after a shift by ten."""
    x = dbl(x)
    product = x
    for i in range(1, SHIFT):
        product = product * (x + i)
    y = x + SHIFT
    inverse = 1 / (y * y)
    # Bernoulli numbers over 2k (2k - 1): 1/12, -1/360, 1/1260, -1/1680, 1/1188
    series = ((((inverse / 1188 - 1 / 1680) * inverse + 1 / 1260) * inverse - 1 / 360) * inverse + 1 / 12) / y
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def _nonzero(c: Column) -> Column:
    return F.when(F.abs(c) < TINY, TINY).otherwise(c)


def _fraction(terms: int, start: list[Column], step) -> Column:
    """A continued fraction by Lentz's method: ``step(i)`` gives its (a, b) for i from 1; state is (c, d, value)."""
    state = F.struct(start[0].alias("c"), start[1].alias("d"), start[2].alias("h"))

    def next_(acc: Column, i: Column) -> Column:
        a, b = step(i.cast("double"))
        made = F.struct((1 / _nonzero(b + a * acc["d"])).alias("d"), _nonzero(b + a / acc["c"]).alias("c"))
        return F.transform(F.array(made), lambda m: F.struct(m["c"].alias("c"), m["d"].alias("d"), (acc["h"] * m["c"] * m["d"]).alias("h")))[0]

    return F.aggregate(F.sequence(F.lit(1), F.lit(terms)), state, next_)["h"]


def gamma_q(a: Column | str, x: Column | str) -> Column:
    """Upper regularised incomplete gamma function Q(a, x) for a > 0; 1 for x <= 0.

    The series of P below a + 1, the continued fraction of Q above, each with 1,300 terms, which do for a up to 20,000;
    beyond, the Wilson-Hilferty normal, whose error there is below 1e-6.
    """
    a, x = dbl(a), dbl(x)
    scale = F.exp(a * F.log(x) - x - log_gamma(a))
    start = F.struct((1 / a).alias("term"), (1 / a).alias("sum"))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] * x / (a + i)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    low = 1 - scale * F.aggregate(F.sequence(F.lit(1), F.lit(GAMMA_TERMS)), start, add)["sum"]
    b = x + 1 - a
    high = scale * _fraction(GAMMA_TERMS, [F.lit(1 / TINY), 1 / _nonzero(b), 1 / _nonzero(b)], lambda i: (-i * (i - a), b + 2 * i))
    small = F.when(x < a + 1, low).otherwise(high)
    z = (F.pow(x / a, F.lit(1 / 3)) - (1 - 1 / (9 * a))) * 3 * F.sqrt(a)
    known = x.isNotNull() & a.isNotNull()
    return F.when(known & (x <= 0), 1.0).when(known & (a > LARGE), normal_sf(z)).when(known, small)


def erfc(x: Column | str) -> Column:
    """Complementary error function: Q(1/2, x^2), mirrored for negative x."""
    x = dbl(x)
    square = x * x
    scale = F.exp(-square) * F.abs(x) / math.sqrt(math.pi)
    start = F.struct(F.lit(2.0).alias("term"), F.lit(2.0).alias("sum"))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] * square / (i + 0.5)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    low = 1 - scale * F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, add)["sum"]
    b = square + 0.5
    high = scale * _fraction(80, [F.lit(1 / TINY), 1 / _nonzero(b), 1 / _nonzero(b)], lambda i: (-i * (i - 0.5), b + 2 * i))
    tail = F.when(square < 4, low).otherwise(high)
    return F.when(x >= 0, tail).when(x < 0, 2 - tail)


def normal_sf(z: Column | str) -> Column:
    """P(Z > z) of the standard normal."""
    return erfc(col(z) / math.sqrt(2)) / 2


def normal_two_sided(z: Column | str) -> Column:
    return erfc(F.abs(col(z)) / math.sqrt(2))


def chi_square_sf(x: Column | str, dof: Column | str | float) -> Column:
    """P(X > x) of a chi-square with any positive degrees of freedom; null where there are none."""
    freedom = F.lit(float(dof)) if isinstance(dof, (int, float)) else dbl(dof)
    return F.when(freedom > 0, gamma_q(freedom / 2, dbl(x) / 2))


def beta_i(a: Column | str, b: Column | str, x: Column | str, rest: Column | None = None) -> Column:
    """Regularised incomplete beta function I_x(a, b) for a, b > 0 and x in [0, 1].

    ``rest`` is 1 - x where the caller knows it better than subtraction does. The continued fraction has 300 terms.
    """
    a, b, x = dbl(a), dbl(b), dbl(x)
    rest = 1 - x if rest is None else rest
    scale = F.exp(a * F.log(x) + b * F.log(rest) + log_gamma(a + b) - log_gamma(a) - log_gamma(b))

    def fraction(p: Column, q: Column, z: Column) -> Column:
        first = 1 / _nonzero(1 - (p + q) * z / (p + 1))

        def step(i: Column) -> tuple[Column, Column]:
            m = F.floor((i + 1) / 2).cast("double")
            even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
            odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
            return F.when(i % 2 == 1, even).otherwise(odd), F.lit(1.0)

        # the even and the odd term of one m follow one another, so the step number i stands for m = (i + 1) / 2
        return _fraction(2 * BETA_TERMS, [F.lit(1.0), first, first], step) / p

    inside = F.when(x < (a + 1) / (a + b + 2), scale * fraction(a, b, x)).otherwise(1 - scale * fraction(b, a, rest))
    return F.when(x <= 0, 0.0).when(rest <= 0, 1.0).otherwise(inside)


def student_two_sided(t: Column | str, dof: Column | str | float) -> Column:
    """P(|T| > |t|) of Student's t with any positive degrees of freedom; null where there are none.

    Beyond 20,000 degrees the normal tail of t with its first two corrections in 1/dof.
    """
    t = F.abs(dbl(t))
    v = F.lit(float(dof)) if isinstance(dof, (int, float)) else dbl(dof)
    square = t * t
    exact = beta_i(v / 2, F.lit(0.5), v / (v + square), square / (v + square))
    density = F.exp(-square / 2) / math.sqrt(2 * math.pi)
    first = t * (square + 1) / 4
    second = t * (((3 * square - 7) * square - 5) * square - 3) / 96
    far = normal_two_sided(t) + 2 * density * (first / v + second / (v * v))
    return F.when((v > 0) & t.isNotNull(), F.when(v > LARGE, far).otherwise(exact))


def correlation_t(r: Column | str, n: Column | str) -> Column:
    """t statistic of a correlation coefficient."""
    r = dbl(r)
    return r * F.sqrt(F.try_divide(dbl(n) - 2, 1 - r * r))


def correlation_p(r: Column | str, n: Column | str) -> Column:
    """Two-sided p-value of a correlation of n pairs: Student's t with n - 2 degrees; 0 for a perfect one, null for n < 3."""
    r, n = dbl(r), dbl(n)
    return F.when((n > 2) & (F.abs(r) >= 1), 0.0).when(n > 2, student_two_sided(correlation_t(r, n), n - 2))
