"""Statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def wilson(successes: Column, count: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson score interval of a proportion."""
    p, w = successes / count, F.lit(z * z) / count
    half = F.lit(z) * F.sqrt(p * (1 - p) / count + w / (4 * count))
    return (p + w / 2 - half) / (1 + w), (p + w / 2 + half) / (1 + w)


def guarded_corr(x: Column, y: Column) -> Column:
    """Pearson correlation, null where either side does not vary."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def smoothed_odds(successes: Column, count: Column) -> Column:
    """Odds with half a success and half a failure added."""
    return (successes + 0.5) / (count - successes + 0.5)


def sigmoid(x: Column) -> Column:
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def log_loss(eta: Column, y: Column) -> Column:
    """log(1 + exp(eta)) - y * eta without overflow."""
    return F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta))) - y * eta


def soft_threshold(x: Column, penalty: Column) -> Column:
    return F.signum(x) * F.greatest(F.abs(x) - penalty, F.lit(0.0))


def bound(value: Column, body) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def softmax(scores: Column) -> Column:
    """Softmax of an array column, shifted by its maximum; lambdas compute what they hold for every element, so both sums are bound before."""
    exponents = lambda x: bound(F.array_max(x), lambda top: F.transform(x, lambda s: F.exp(s - top)))
    shares = lambda e: bound(F.aggregate(e, F.lit(0.0), lambda a, s: a + s), lambda total: F.transform(e, lambda s: s / total))
    return bound(scores, lambda x: bound(exponents(x), shares))
