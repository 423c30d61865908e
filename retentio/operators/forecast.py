"""Growth towards a target: exponential smoothing with trend over a monthly
series, folded in month order inside one expression.

The series has one value a month, so it is gathered into one array per series
(bounded by the months the table spans); the fold is an ``aggregate`` over
it.  Months without a row count as zero, as no customer joined in them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALPHA, BETA = 0.5, 0.3
#: Months looked ahead at most.
HORIZON = 120


def monthly_series(df: DataFrame, month: str, value: str, by: list[str] | None = None) -> DataFrame:
    """by, first_month, last_month and ``values``: a number for every month from
    the first to the last, missing ones 0."""
    per = df.filter(F.col(month).isNotNull()).groupBy(*(by or []), F.trunc(month, "month").alias("__m")).agg(F.sum(value).cast("double").alias("__v"))
    cells = F.map_from_entries(F.collect_list(F.struct((F.year("__m") * 12 + F.month("__m")).alias("k"), F.coalesce("__v", F.lit(0.0)).alias("v"))))
    out = per.groupBy(*(by or [])).agg(F.min("__m").alias("first_month"), F.max("__m").alias("last_month"), cells.alias("__cells")) \
             .filter(F.col("first_month").isNotNull())
    first, last = [F.year(c) * 12 + F.month(c) for c in ("first_month", "last_month")]
    values = F.transform(F.sequence(first, last), lambda k: F.coalesce(F.try_element_at(F.col("__cells"), k), F.lit(0.0)))
    return out.select(*(by or []), "first_month", "last_month", values.alias("values"))


def smoothed(values: Column, alpha: float = ALPHA, beta: float = BETA) -> Column:
    """level, trend, n and the sum of squared one-step errors after the last
    value.  The level starts at the first value, the trend at the first
    difference (0 for a single value); errors count from the third value on."""
    if not (0 < alpha <= 1 and 0 < beta <= 1):
        raise ValueError("alpha and beta must be above 0 and at most 1")
    trend = F.when(F.size(values) > 1, F.get(values, F.lit(1)) - F.get(values, F.lit(0))).otherwise(F.lit(0.0))
    start = F.struct(F.get(values, F.lit(0)).alias("level"), trend.alias("trend"), F.lit(0).alias("n"), F.lit(0.0).alias("sse"))

    def step(s: Column, x: Column) -> Column:
        ahead = s["level"] + s["trend"]
        level = alpha * x + (1 - alpha) * ahead
        slope = beta * (level - s["level"]) + (1 - beta) * s["trend"]
        miss = F.when(s["n"] >= 2, (x - ahead) * (x - ahead)).otherwise(F.lit(0.0))
        moved = s["n"] >= 1  # the first value is the start itself
        return F.struct(F.when(moved, level).otherwise(s["level"]).alias("level"), F.when(moved, slope).otherwise(s["trend"]).alias("trend"),
                        (s["n"] + 1).alias("n"), (s["sse"] + miss).alias("sse"))

    return F.aggregate(values, start, step)


def growth_forecast(series: DataFrame, target: float, alpha: float = ALPHA, beta: float = BETA, horizon: int = HORIZON) -> DataFrame:
    """Per series: what there is, the fitted level and trend, the one-step
    error (root mean square, NULL under three months) and the months until the
    running total reaches ``target``: expected, and at the optimistic and the
    pessimistic end of one error a month.  0 if it is reached already, NULL if
    it is not within ``horizon`` months.

    A month's forecast is never below 0: nobody un-joins.
    """
    keep = [c for c in series.columns if c != "values"]
    s = series.withColumn("__s", smoothed(F.col("values"), alpha, beta)) \
              .withColumn("total", F.aggregate("values", F.lit(0.0), lambda a, x: a + x))
    s = s.withColumn("error", F.when(F.col("__s.n") > 2, F.sqrt(F.col("__s.sse") / (F.col("__s.n") - 2))))

    def months(shift: Column) -> Column:
        start = F.struct(F.col("total").alias("sum"), F.when(F.col("total") >= target, 0).alias("at"))
        end = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, lambda a, h: F.struct(
            (a["sum"] + F.greatest(F.lit(0.0), F.col("__s.level") + h * F.col("__s.trend") + shift)).alias("sum"),
            F.coalesce(a["at"], F.when(a["sum"] + F.greatest(F.lit(0.0), F.col("__s.level") + h * F.col("__s.trend") + shift) >= target, h)).alias("at")))
        return end["at"].cast("int")

    width = F.coalesce("error", F.lit(0.0))
    return s.select(*keep, "total", F.col("__s.level").alias("level"), F.col("__s.trend").alias("trend"), "error",
                    months(F.lit(0.0)).alias("months_to_target"), months(width).alias("months_at_best"), months(-width).alias("months_at_worst"))
