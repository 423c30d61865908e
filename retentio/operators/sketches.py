"""Stored sketches: distinct customers and quantiles of any range of months
from a table of mergeable summaries, without reading the orders again.

Distinct counts use theta sketches, which can be united and intersected
("active in both"); their relative standard error is about 1 / sqrt(2^lg_k),
and a set of up to 2^lg_k keys is counted exactly.  Quantiles use KLL
sketches, whose rank error falls with k.  Both are built by aggregates with a
partial step, so a cell that holds a third of all orders is summarised where
its rows lie; merging is associative and needs no order.

A cell is (cohort, month), or a month and a column: the tables grow with the
months, not with the orders.  NULL keys and values are not counted.
"""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentio.operators import cohort as co

LG_K = 12
#: Items of a KLL sketch's largest level (rank error about 1.3 % at 200).
KLL_K = 200


def relative_error(lg_k: int = LG_K) -> float:
    """Relative standard error of a distinct estimate."""
    return 1 / sqrt(2 ** lg_k - 1)


# -- distinct customers -----------------------------------------------------------
def activity_sketches(df: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """cohort_id, order_month and a theta sketch of the customers active there."""
    months = co.customer_months(df.filter(F.col("customer").isNotNull() & F.col("order_month").isNotNull()))
    cohorts = co.keys_from_months(months).select("customer", "cohort_id")
    each = months.select("customer", "order_month").join(cohorts, "customer")
    return each.groupBy("cohort_id", "order_month").agg(F.theta_sketch_agg("customer", lg_k).alias("customers"))


def merge_activity(*tables: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """Several tables of sketches as one (a customer in two of them counts once).
    The order of merging does not matter."""
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    return every.groupBy("cohort_id", "order_month").agg(F.theta_union_agg("customers", lg_k).alias("customers"))


def _within(first: Column | str, last: Column | str) -> Column:
    return F.col("order_month").between(F.lit(first).cast("date"), F.lit(last).cast("date"))


def active_between(sketches: DataFrame, first: str, last: str, by: list[str] | None = None, lg_k: int = LG_K) -> DataFrame:
    """Estimated distinct customers active in any month of a range, in all or per cohort."""
    return sketches.filter(_within(first, last)).groupBy(*(by or [])) \
                   .agg(F.theta_union_agg("customers", lg_k).alias("__s")) \
                   .select(*(by or []), F.theta_sketch_estimate("__s").alias("customers"))


def active_in_each(sketches: DataFrame, bucket: Column, lg_k: int = LG_K) -> DataFrame:
    """One sketch for each value of an expression of order_month (a quarter, a year)."""
    return sketches.groupBy(bucket.alias("bucket")).agg(F.theta_union_agg("customers", lg_k).alias("customers"))


def active_in_both(sketches: DataFrame, one: tuple[str, str], two: tuple[str, str], by: list[str] | None = None, lg_k: int = LG_K) -> DataFrame:
    """Estimated customers active in both of two ranges of months, with the
    estimate of either range: one scan of the sketches."""
    inside = [F.theta_union_agg(F.when(_within(*r), F.col("customers")), lg_k) for r in (one, two)]
    both = sketches.groupBy(*(by or [])).agg(inside[0].alias("__1"), inside[1].alias("__2"))
    return both.select(*(by or []), F.theta_sketch_estimate("__1").alias("first"), F.theta_sketch_estimate("__2").alias("second"),
                       F.theta_sketch_estimate(F.theta_intersection("__1", "__2")).alias("both"))


# -- quantiles --------------------------------------------------------------------
def quantile_sketches(df: DataFrame, columns: list[str], month: str = "order_month", k: int = KLL_K) -> DataFrame:
    """month, column_name, n (values) and a KLL sketch of every column and month."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("__v")) for c in columns])
    long = df.select(month, F.inline(cells)).filter(F.col("__v").isNotNull() & ~F.isnan("__v"))
    return long.groupBy(month, "column_name").agg(F.count("__v").alias("n"), F.kll_sketch_agg_double("__v", k).alias("sketch"))


def merged_quantiles(sketches: DataFrame, probabilities: list[float], by: list[str] | None = None, k: int = KLL_K) -> DataFrame:
    """Quantiles of each column over all rows of ``sketches`` (filter them to a
    range of months first), per group of ``by`` if given."""
    keys = [*(by or []), "column_name"]
    merged = sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", k).alias("sketch"))
    values = F.array(*[F.struct(F.lit(float(p)).alias("probability"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias("value"))
                       for p in probabilities])
    return merged.select(*keys, "n", F.inline(values))


def rank_range(rows: DataFrame, quantiles: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """``quantiles`` (by, column_name, probability, value) with the share of the
    exact values below and up to each: how far a sketch is off in rank."""
    cells = F.array(*[F.struct(F.lit(c).alias("__column"), F.col(c).cast("double").alias("__v")) for c in columns])
    long = rows.select(*[F.col(c).alias(f"__{c}") for c in by], F.inline(cells)).filter(F.col("__v").isNotNull() & ~F.isnan("__v"))
    same = F.col("__column") == F.col("column_name")
    for c in by:
        same = same & F.col(f"__{c}").eqNullSafe(F.col(c))
    n = F.count(F.lit(1))
    return long.join(quantiles, same).groupBy(*by, "column_name", "probability", "value") \
               .agg((F.count_if(F.col("__v") < F.col("value")) / n).alias("below"), (F.count_if(F.col("__v") <= F.col("value")) / n).alias("up_to"), n.alias("n"))
