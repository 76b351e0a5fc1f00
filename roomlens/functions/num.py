"""Numeric expressions and guarded aggregates."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(x: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf), x)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded as the ROUND of DuckDB does it: the product with the power of ten to the nearest integer, halves away from zero. Spark's own goes by the shortest decimals
    of ``x``, which differs where the product comes out as a half."""
    return F.round(x * 10.0**digits) / 10.0**digits


def reaches(total: Column, floor: float) -> Column:
    """Whether a sum is ``floor`` or more, to nine decimals: the last bits of a sum hang on the order of its rows, so one that is ``floor`` exactly may come out below."""
    return F.round(total, 9) >= floor


def weighted_mean(x: Column, w: Column, floor: float = 0.0) -> Column:
    """Mean over rows with a value and a positive weight; null where those weights sum to less than ``floor``."""
    ok = x.isNotNull() & (w > 0)
    total = F.sum(F.when(ok, w))
    return F.when(reaches(total, floor), F.try_divide(F.sum(F.when(ok, x * w)), total))


def add(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def distribution(columns: list[Column]) -> list[Column]:
    """Clipped shares; equal shares where the sum is not positive."""
    own = [F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0)) for c in columns]
    total = add(own)
    return [F.when(total > 0, c / total).otherwise(F.lit(1.0 / len(own))) for c in own]


def entropy(shares: list[Column]) -> Column:
    """Shannon entropy over its maximum."""
    if len(shares) < 2:
        return F.lit(1.0)
    return -add([F.when(p > 0, p * F.log(p)).otherwise(F.lit(0.0)) for p in shares]) / math.log(len(shares))


def imbalance(shares: list[Column]) -> Column:
    """Total variation distance to equal shares."""
    return 0.5 * add([F.abs(p - 1.0 / len(shares)) for p in shares])


def min_max(x: Column, low: Column, high: Column) -> Column:
    """Scaled to 0..1; a constant gives 0 if it is 0, else 0.5; null gives 0."""
    v = F.coalesce(x, F.lit(0.0))
    return F.when(high > low, (v - low) / (high - low)).when(high == 0, F.lit(0.0)).otherwise(F.lit(0.5))


def interval_error(v: Column, low: Column, high: Column) -> Column:
    return F.greatest(low - v, v - high, F.lit(0.0))


def logistic(x: Column, clip: float = 30.0) -> Column:
    return 1 / (1 + F.exp(-clamp(x, -clip, clip)))


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation; null where a side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def log_gamma(z: Column) -> Column:
    """Logarithm of the gamma function for z > 0: Stirling's series eight steps further up, to about 1e-12."""
    y = z + 8
    tail = 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3.0))) + 1 / (1260 * F.pow(y, F.lit(5.0))) - 1 / (1680 * F.pow(y, F.lit(7.0)))
    steps = reduce(lambda a, b: a + b, [F.log(z + k) for k in range(8)])
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + tail - steps


def _beta_fraction(x: Column, a: Column, b: Column, terms: int) -> Column:
    """The continued fraction of the incomplete beta function, from its last term to the first."""
    def term(k: Column) -> Column:
        m = F.floor(k / 2)
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        return F.when(k % 2 == 1, odd).otherwise(even)

    return F.aggregate(F.sequence(F.lit(terms), F.lit(1), F.lit(-1)), F.lit(1.0), lambda f, k: 1 + term(k) / f)


def incomplete_beta(x: Column, a: Column, b: Column, terms: int = 400) -> Column:
    """Regularised incomplete beta function, for 0 <= x <= 1 and a, b > 0."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x))
    low = front / a / _beta_fraction(x, a, b, terms)
    high = 1 - front / b / _beta_fraction(1 - x, b, a, terms)
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).when(x < (a + 1) / (a + b + 2), low).otherwise(high)


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation (of values or of ranks) of ``n`` pairs, by Student's t with n - 2 degrees; null below three pairs."""
    rest = 1 - r * r
    # df / (df + t^2) is 1 - r^2
    p = F.when(rest <= 0, F.lit(0.0)).otherwise(incomplete_beta(rest, (n - 2) / 2.0, F.lit(0.5)))
    return F.when((n > 2) & r.isNotNull(), p)
