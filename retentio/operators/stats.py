"""Statistics behind the reference's charts: histograms, a least-squares line,
pattern matches.  (The drawing itself is not rebuilt.)"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# -- G1..G3 -------------------------------------------------------------------
def histogram(df: DataFrame, col: str, bins: int = 30, boundary: str = "range") -> DataFrame:
    """Equal-width histogram with ``bins`` bins.

    ``boundary='range'``: bins divide [min, max], the last one closed.
    ``boundary='ggplot'``: the plotting library's default, width
    range / (bins - 1) with the first bin centred on the minimum, each bin
    closed on the right.
    Rows ``(bin, bin_lower, bin_upper, n)`` for non-empty bins only; a
    constant column gives one bin.  The values are first reduced to distinct
    value -> count (partial aggregation); min / max (one scalar subquery) and
    the binning both read that reduced table, whose exchange Spark computes
    once and reuses.
    """
    x = F.col(col).cast("double")
    vc = (df.select(x.alias("__x")).filter(F.col("__x").isNotNull() & ~F.isnan("__x"))
            .groupBy("__x").agg(F.count(F.lit(1)).alias("__n")))
    rng = vc.agg(F.struct(F.min("__x").alias("lo"), F.max("__x").alias("hi"))).scalar()
    lo, hi = rng.getField("lo"), rng.getField("hi")
    if boundary == "ggplot":
        width = (hi - lo) / (bins - 1)
        start = lo - width / 2
        at = F.ceil((F.col("__x") - start) / width) - 1
    elif boundary == "range":
        width, start = (hi - lo) / bins, lo
        at = F.floor((F.col("__x") - lo) / (hi - lo) * bins)
    else:
        raise ValueError("boundary must be 'range' or 'ggplot'")
    idx = F.when(hi == lo, F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(at, F.lit(bins - 1)))).cast("int")
    counts = vc.groupBy(idx.alias("bin")).agg(F.sum("__n").cast("bigint").alias("n"))
    if boundary == "ggplot":
        return counts.select("bin", (start + F.col("bin") * width).alias("bin_lower"),
                             (start + (F.col("bin") + 1) * width).alias("bin_upper"), "n")
    return counts.select(
        "bin",
        (lo + F.col("bin") * (hi - lo) / bins).alias("bin_lower"),
        (lo + (F.col("bin") + 1) * (hi - lo) / bins).alias("bin_upper"),
        "n")


# -- G6 -----------------------------------------------------------------------
P_STEPS = 20_000


def two_sided_p(t: Column, df: Column) -> Column:
    """P(|T| > |t|) of Student's t with ``df`` degrees of freedom.

    The incomplete beta integral after substituting y = x exp(-2 v^2 / df)
    with x = df / (df + t^2), by the midpoint rule; its constant from the
    asymptotic series of Gamma(a + 1/2) / Gamma(a), after eight steps of the
    recurrence that make a large.
    """
    a = df / 2
    big = a + 8
    ratio = F.sqrt(big) * (1 - 1 / (8 * big) + 1 / (128 * big ** 2) + 5 / (1024 * big ** 3) - 21 / (32768 * big ** 4))
    for k in range(8):
        ratio = ratio * (a + k) / (a + k + 0.5)
    x = df / (df + t * t)
    h = 6.5 / P_STEPS

    def add(total, k):
        v = (k + 0.5) * h
        return total + F.exp(-v * v) / F.sqrt(1 - x * F.exp(-2 * v * v / df)) * 2 * v

    area = F.aggregate(F.sequence(F.lit(0), F.lit(P_STEPS - 1)), F.lit(0.0), add) * h
    return F.least(F.lit(1.0), ratio / F.sqrt(F.lit(math.pi)) * F.exp(a * F.ln(x)) * (2 / df) * area)


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least squares ``y ~ 1 + x``: estimate, standard error, t and p per term.

    Rows missing x or y are left out, as ``lm`` does.  One aggregation of the
    centred moments (Spark merges them by means, so large values do not
    cancel); everything after is arithmetic on one row.  With a constant x the
    slope, and with two rows or fewer the errors, are NULL.
    """
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    complete = df.select(xs.alias("x"), ys.alias("y")).filter(
        F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
    m = complete.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"),
                     F.regr_sxx("y", "x").alias("sxx"), F.regr_sxy("y", "x").alias("sxy"), F.regr_syy("y", "x").alias("syy"))
    m = m.withColumn("b1", F.try_divide("sxy", "sxx")).withColumn("b0", F.col("my") - F.col("b1") * F.col("mx"))
    m = m.withColumn("s2", F.when(F.col("n") > 2, F.greatest(F.lit(0.0), F.col("syy") - F.col("b1") * F.col("sxy"))
                                  / F.nullif(F.col("n") - 2, F.lit(0.0))))
    m = m.withColumn("se1", F.sqrt(F.try_divide("s2", "sxx")))
    m = m.withColumn("se0", F.sqrt(F.col("s2") * (F.try_divide(F.lit(1.0), F.col("n")) + F.try_divide(F.col("mx") * F.col("mx"), F.col("sxx")))))
    term = lambda name, b, se: F.struct(F.lit(name).alias("term"), F.col(b).alias("estimate"), F.col(se).alias("std_error"),
                                        (F.col("n") - 2).alias("__df"))
    rows = m.select(F.inline(F.array(term("(Intercept)", "b0", "se0"), term(x, "b1", "se1"))))
    rows = rows.withColumn("t_value", F.try_divide("estimate", "std_error"))
    return rows.withColumn("p_value", F.when(F.col("t_value").isNotNull(), two_sided_p(F.col("t_value"), F.col("__df")))).drop("__df")


def linear_fit_pvalues(df: DataFrame, x: str, y: str) -> DataFrame:
    """The same table; kept under its own name."""
    return linear_fit(df, x, y)


# -- G7 -----------------------------------------------------------------------
def grep_values(df: DataFrame, col: str, pattern: str) -> DataFrame:
    """Values of ``col`` matching the regular expression (duplicates kept)."""
    return df.select(col).filter(F.col(col).rlike(pattern))
