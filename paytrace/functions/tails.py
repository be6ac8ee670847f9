"""Tail probabilities as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS = 600


def _log_gamma_half(k: Column) -> Column:
    """Logarithm of the gamma function at k / 2, for whole k of at least 1."""
    odd = k % 2 == 1
    first = F.when(odd, 0.5).otherwise(1.0)
    count = F.floor((k - F.when(odd, 1).otherwise(2)) / 2).cast("int")
    steps = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.when(odd, math.log(math.pi) / 2).otherwise(0.0), lambda total, i: total + F.log(first + i))


def chi_square_tail(x: Column, degrees: Column) -> Column:
    """Probability that a chi-square variable with ``degrees`` of freedom is at least ``x``; null where x is.

    The regularised incomplete gamma function: its series below the mean, a continued fraction above it.
    """
    a, y = degrees.cast("double") / 2, x.cast("double") / 2
    scale = F.exp(-y + a * F.log(y) - _log_gamma_half(degrees.cast("int")))
    steps = F.sequence(F.lit(1), F.lit(STEPS))
    one = F.struct((F.lit(1.0) / a).alias("term"), (F.lit(1.0) / a).alias("total"))

    def series(s: Column, i: Column) -> Column:
        term = s["term"] * y / (a + i)
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    start = y + 1 - a
    begin = F.struct(start.alias("b"), F.lit(1e300).alias("c"), (F.lit(1.0) / start).alias("d"), (F.lit(1.0) / start).alias("h"))

    def fraction(s: Column, i: Column) -> Column:
        an, b = -i * (i - a), s["b"] + 2
        d, c = F.lit(1.0) / (an * s["d"] + b), b + an / s["c"]
        return F.struct(b.alias("b"), c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

    below = 1 - scale * F.aggregate(steps, one, series, lambda s: s["total"])
    above = scale * F.aggregate(steps, begin, fraction, lambda s: s["h"])
    return F.when(x <= 0, 1.0).when(y < a + 1, below).when(x.isNotNull(), above)
