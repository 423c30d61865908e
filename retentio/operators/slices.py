"""Many slices at once: grouping sets over the cohort tables, ranked slices
with confidence bounds, and the association of attributes with an outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retentio.functions.dates import cohort_period
from retentio.functions.distributions import chi_square_tail
from retentio.operators import cohort as co

#: Standard normal quantile of a two-sided 95 % bound.
Z95 = 1.959963984540054


# -- grouping sets --------------------------------------------------------------
def slice_name(attrs: list[str]) -> str:
    return "+".join(attrs) or "all"


def _attrs_of(slices: list[list[str]]) -> list[str]:
    out: list[str] = []
    for s in slices:
        out += [c for c in s if c not in out]
    return out


def _rolled(df: DataFrame, keys: list[str], slices: list[list[str]], value: str) -> DataFrame:
    """``value`` summed for every slice from one aggregation.

    Each output row names its slice: ``grouping_id`` tells a column that the
    slice does not group by from a real NULL level, which values cannot."""
    attrs = _attrs_of(slices)
    sets = [[*keys, *s] for s in slices]
    name = None
    for s in slices:
        bits = sum(1 << k for k, c in enumerate(reversed([*keys, *attrs])) if c not in (*keys, *s))
        one = F.when(F.col("__gid") == bits, F.lit(slice_name(s)))
        name = one if name is None else F.coalesce(name, one)
    rolled = df.groupingSets(sets, *keys, *attrs).agg(F.sum(value).cast("bigint").alias(value), F.grouping_id(*keys, *attrs).alias("__gid"))
    return rolled.withColumn("slice", name).select("slice", *keys, *attrs, value)


def slice_counts(counts: DataFrame, slices: list[list[str]]) -> DataFrame:
    """Cohort sizes of several slices: slice, cohort_id, attributes, cohort_count."""
    return _rolled(counts, ["cohort_id"], _distinct(slices), "cohort_count")


def slice_activity(activity: DataFrame, slices: list[list[str]]) -> DataFrame:
    """Active customers per month and cohort of several slices, with the period."""
    out = _rolled(activity, ["order_month", "cohort_id"], _distinct(slices), "active_customers")
    return out.withColumn("cohort_period", cohort_period("cohort_id", "order_month"))


def _distinct(slices: list[list[str]]) -> list[list[str]]:
    out: list[list[str]] = []
    for s in slices:
        if sorted(s) not in [sorted(x) for x in out]:
            out.append(list(s))
    return out


def slice_retention(activity: DataFrame, counts: DataFrame, slices: list[list[str]]) -> DataFrame:
    """Retention of several slices in one plan: each cohort table is
    aggregated once for all slices, and one join finds every slice's sizes
    (NULL levels match NULL levels of their own slice)."""
    keys = ["slice", "cohort_id", *_attrs_of(slices)]
    act, size = slice_activity(activity, slices), slice_counts(counts, slices)
    right = size.select(*[F.col(c).alias(f"__r{k}") for k, c in enumerate(keys)], "cohort_count")
    cond = F.lit(True)
    for k, c in enumerate(keys):
        cond = cond & F.col(c).eqNullSafe(F.col(f"__r{k}"))
    out = act.join(right, cond, "left").drop(*[f"__r{k}" for k in range(len(keys))])
    return out.withColumn("retention_rate", F.try_divide(F.col("active_customers"), F.col("cohort_count").cast("double")))


# -- ranked slices --------------------------------------------------------------
def wilson(hits: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Lower and upper Wilson bound of a share; NULL for n = 0."""
    n, p = n.cast("double"), F.try_divide(hits, n.cast("double"))
    centre = F.try_divide(p + z * z / (2 * n), 1 + z * z / n)
    half = F.try_divide(z * F.sqrt(F.greatest(F.lit(0.0), p * (1 - p) / n + z * z / (4 * n * n))), 1 + z * z / n)
    ok = n > 0
    # exact where none or all are hits, so that such slices tie
    return (F.when(ok, F.when(hits == 0, F.lit(0.0)).otherwise(centre - half)), F.when(ok, F.when(p == 1, F.lit(1.0)).otherwise(centre + half)))


def slice_rates(activity: DataFrame, counts: DataFrame, by: list[str], period: int, z: float = Z95) -> DataFrame:
    """Per slice: customers whose ``period`` lies within the data, how many of
    them were active in it, the rate and its Wilson bounds.

    Cohorts too young to have reached the period are left out on both sides,
    so a slice that grows fast is not ranked down for it.
    """
    if period < 1:
        raise ValueError("period counts from 1")
    last = activity.agg(F.max("order_month")).scalar()
    reached = counts.filter(F.add_months("cohort_id", period - 1) <= last)
    size = reached.groupBy(*by).agg(F.sum("cohort_count").cast("bigint").alias("customers"), F.lit(0).cast("bigint").alias("retained"))
    hits = activity.filter(F.col("cohort_period") == period) \
                   .groupBy(*by).agg(F.lit(0).cast("bigint").alias("customers"), F.sum("active_customers").cast("bigint").alias("retained"))
    per = size.unionByName(hits).groupBy(*by).agg(F.sum("customers").alias("customers"), F.sum("retained").alias("retained"))
    lo, hi = wilson(F.col("retained"), F.col("customers"), z)
    return per.withColumn("rate", F.try_divide("retained", F.col("customers").cast("double"))).withColumn("lower", lo).withColumn("upper", hi)


def best_slices(rates: DataFrame, by: list[str], k: int, within: list[str] | None = None) -> DataFrame:
    """The ``k`` slices with the highest lower bound, in all or ``within``
    every group of some of their columns, with their ``rank``.

    Ties: the higher upper bound (fewer customers, the same evidence), then
    the slice's values in ascending order, NULL last; so ranks are gapless and
    reruns agree.  Within groups every task first keeps its own k rows a group
    (the planner's group limit), so what is shuffled and ranked is bounded by
    tasks x groups x k; without groups it is a top-k of the partial top-k.
    """
    order = [F.round("lower", 12).desc_nulls_last(), F.round("upper", 12).desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in by]]
    if not within:
        top = rates.orderBy(*order).limit(k)
        return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    return rates.withColumn("rank", F.row_number().over(Window.partitionBy(*within).orderBy(*order))).filter(F.col("rank") <= k)


# -- association ----------------------------------------------------------------
def customer_outcome(df: DataFrame, attrs: list[str], within: int) -> DataFrame:
    """One row a customer: attributes of the first order (lowest order_id of
    ties) and ``returned``, whether they were active again in periods 2 to
    ``within`` + 1.  Customers whose last of these periods lies behind the
    data are left out, as their outcome is not known."""
    months = co.customer_months(df.filter(F.col("customer").isNotNull() & F.col("order_month").isNotNull()))
    first = co.customer_cohort(df, attrs, ties="first")
    last = df.agg(F.max("order_month")).scalar()
    later = months.select("customer", "order_month").join(first.select("customer", "cohort_id"), "customer") \
                  .filter(cohort_period("cohort_id", "order_month").between(2, within + 1)).select("customer").distinct()
    known = first.filter(F.add_months("cohort_id", within) <= last)
    return known.join(later.withColumn("returned", F.lit(True)), "customer", "left").select("customer", *attrs, F.coalesce("returned", F.lit(False)).alias("returned"))


def contingency(rows: DataFrame, outcome: str, attrs: list[str]) -> DataFrame:
    """attribute, level, n, hits (rows with the outcome) for all attributes from
    one aggregation; NULL is a level of its own."""
    cells = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("level")) for a in attrs])
    return rows.filter(F.col(outcome).isNotNull()).select(F.inline(cells), F.col(outcome).cast("int").alias("__hit")) \
               .groupBy("attribute", "level").agg(F.count(F.lit(1)).alias("n"), F.sum("__hit").cast("bigint").alias("hits"))


def association(cells: DataFrame) -> DataFrame:
    """Chi-squared test of independence per attribute: levels, n, chi_squared,
    degrees of freedom, p_value and Cramer's V, strongest first.

    Every level has both cells, empty ones included.  An attribute with one
    level, or an outcome that all or none have, leaves nothing to test: zero
    degrees of freedom, everything else NULL.
    """
    total = cells.groupBy("attribute").agg(F.count(F.lit(1)).alias("levels"), F.sum("n").alias("__rows"), F.sum("hits").alias("__hits"))
    both = cells.join(total, "attribute")
    n, hits, share = F.col("n").cast("double"), F.col("hits").cast("double"), F.col("__hits") / F.col("__rows").cast("double")
    part = F.try_divide((hits - n * share) ** 2, n * share * (1 - share))  # both cells of the level together
    per = both.groupBy("attribute").agg(F.max("levels").alias("levels"), F.max("__rows").alias("n"), F.max("__hits").alias("__h"), F.sum(part).alias("__x"))
    tested = (F.col("levels") > 1) & (F.col("__h") > 0) & (F.col("__h") < F.col("n"))
    out = per.withColumn("df", F.when(tested, F.col("levels") - 1).otherwise(0)).withColumn("chi_squared", F.when(tested, F.col("__x")))
    return out.select("attribute", "levels", "n", "chi_squared", "df", F.when(tested, chi_square_tail(F.col("chi_squared"), F.col("df"))).alias("p_value"),
                      F.sqrt(F.col("chi_squared") / F.col("n")).alias("cramers_v")).orderBy(F.col("cramers_v").desc_nulls_last(), "attribute")
