"""Poisson upper tail as a Column expression.

``P(X >= n)`` for mean ``lam``.  The larger tail is never subtracted from one:
above the mean the series runs upwards from the first term, otherwise the lower
sum runs downwards from ``n - 1``.  The number of terms follows from count and mean,
so it is not capped at a size that only fits small counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def ln_factorial(n: Column) -> Column:
    """ln n!, exact factorials up to 20 and Stirling's series beyond."""
    x = n.cast("double")
    series = (
        x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x)
        + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    )
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def _series(first: Column, terms: Column, ratio) -> Column:
    """first * (1 + r1 + r1*r2 + ...), kept in scale by running the bracket."""
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(acc, i):
        term = acc["term"] * ratio(i)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    return first * F.aggregate(F.sequence(F.lit(1), terms), start, step, lambda acc: acc["total"])


def upper_tail(n: Column, lam: Column) -> Column:
    """P(X >= n) for X ~ Poisson(lam), lam > 0; 1 when n is 0."""
    n = n.cast("long")
    x, lam = n.cast("double"), lam.cast("double")
    # Terms shrink at least like exp(-k^2 / 2(n+k)) and at least geometrically by the
    # first ratio; the shorter of the two leaves nothing above 1e-16 of the first term.
    bell = F.lit(39.0) + F.sqrt(F.lit(1521.0) + F.lit(78.0) * F.greatest(x, lam))

    def reach(ratio):
        return F.ceil(F.least(bell, F.coalesce(F.try_divide(F.lit(37.0), F.log(ratio)), bell)) + 1).cast("int")

    above = _series(
        F.exp(-lam + x * F.log(lam) - ln_factorial(n)), reach(F.greatest((x + 1) / lam, F.lit(1.0))),
        lambda i: lam / (x + i),
    )
    last = x - 1
    terms = reach(F.greatest(lam / F.greatest(last, F.lit(1.0)), F.lit(1.0)))
    down = F.greatest(F.lit(1), F.least(terms, n.cast("int")))
    below = _series(
        F.exp(-lam + last * F.log(lam) - ln_factorial(F.greatest(n - 1, F.lit(0)))), down,
        lambda i: F.greatest(last - i + 1, F.lit(0.0)) / lam,
    )
    return F.when(n <= 0, F.lit(1.0)).when(x > lam, F.least(above, F.lit(1.0))).otherwise(
        F.greatest(F.lit(1.0) - below, F.lit(0.0))
    )
