"""Tail probabilities as column expressions (no Python in the plan)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of the error function's series below SPLIT and of its fraction from there on.
_TERMS, _SPLIT = 60, 3.0


def erfc(z: Column) -> Column:
    """Complementary error function of ``z >= 0``."""
    steps = F.sequence(F.lit(1), F.lit(_TERMS))
    # erf: sum of z^(2n+1) 2^n / (2n+1)!!, each term from the one before
    series = F.aggregate(steps, F.struct(z.alias("term"), z.alias("total")),
                         lambda s, n: F.struct((s["term"] * 2 * z * z / (2 * n + 1)).alias("term"),
                                               (s["total"] + s["term"] * 2 * z * z / (2 * n + 1)).alias("total")),
                         lambda s: s["total"])
    near = 1 - 2 / math.sqrt(math.pi) * F.exp(-z * z) * series
    fraction = F.aggregate(F.reverse(steps), F.lit(1.0), lambda f, n: 1 + n / (2 * z * z * f))
    far = F.exp(-z * z) / (z * math.sqrt(math.pi) * fraction)
    return F.when(z < _SPLIT, near).otherwise(far)


def chi_square_tail(x: Column, df: Column) -> Column:
    """P(chi-squared with ``df`` degrees of freedom > x), by its finite sum for
    whole degrees of freedom; 1 for x = 0, NULL without degrees of freedom."""
    x, df = x.cast("double"), df.cast("int")
    h, odd = x / 2, df % 2
    n = F.floor((df - odd) / 2).cast("int")  # terms besides the error function's
    # odd: h^(k-1/2) / gamma(k+1/2), k = 1..n; even: h^(k-1) / gamma(k), k = 1..n; times exp(-h), added as logarithms
    first = -h + F.when(odd == 1, 0.5 * F.ln(h) - math.lgamma(1.5)).otherwise(F.lit(0.0))
    some = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(some, F.struct(first.alias("log"), F.lit(0.0).alias("total")),
                        lambda s, k: F.struct((s["log"] + F.ln(h) - F.ln(k + 0.5 * odd)).alias("log"),
                                              (s["total"] + F.exp(s["log"])).alias("total")),
                        lambda s: s["total"])
    tail = total + F.when(odd == 1, erfc(F.sqrt(h))).otherwise(F.lit(0.0))
    return F.when(df >= 1, F.when(x <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), tail)))
