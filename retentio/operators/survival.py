"""Customer lifetimes with censoring: spells, life tables, the log-rank test.

Retention compares a month's active customers with the cohort, so a young
cohort has few periods and its customers' later months are unknown, not lost.
Here every customer has a spell of activity that either ended (they stayed
away for ``lapse`` whole months) or was still open when the data end, in
which case it is censored: it counts as at risk up to its last active month
and not as a loss.

Physical design: spells come from the distinct customer-months (a customer
has at most one row a month, so no window holds more rows than there are
months).  They are then reduced by one grouped count to (slice, duration,
events, censored); everything behind works on that table, at most months x
slices rows, by running sums within a slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retentio.functions.dates import cohort_period
from retentio.functions.distributions import chi_square_tail
from retentio.operators import cohort as co

#: Whole months without an order after which a customer counts as lost.
LAPSE = 3


def customer_spells(df: DataFrame, lapse: int = LAPSE, as_of: Column | None = None) -> DataFrame:
    """Spells of activity: customer, spell (from 1), first_month, last_month,
    duration (periods from the first to the last active month) and ``ended``.

    A spell ends where ``lapse`` or more whole months without an order follow
    its last month; the months up to ``as_of`` (the last month of the table)
    count as known, so a later silence is censored.  Orders without a customer
    or a month have no part in it.
    """
    if lapse < 1:
        raise ValueError("lapse must be at least one month")
    known = df.filter(F.col("customer").isNotNull() & F.col("order_month").isNotNull())
    months = co.customer_months(known).select("customer", "order_month")
    end = as_of if as_of is not None else known.agg(F.max("order_month")).scalar()
    by_month = Window.partitionBy("customer").orderBy("order_month")

    def away(a: Column, b: Column) -> Column:  # whole months between two active months
        return cohort_period(a, b) - 2

    before = F.lag("order_month").over(by_month)
    opens = F.when(before.isNull() | (away(before, F.col("order_month")) >= lapse), 1).otherwise(0)
    marked = months.withColumn("opens", opens)
    numbered = marked.withColumn("spell", F.sum("opens").over(by_month.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spells = numbered.groupBy("customer", "spell").agg(F.min("order_month").alias("first_month"), F.max("order_month").alias("last_month"))
    later = F.max("spell").over(Window.partitionBy("customer")) > F.col("spell")
    silent = cohort_period(F.col("last_month"), end) - 1 >= lapse
    return spells.select("customer", "spell", "first_month", "last_month",
                         cohort_period("first_month", "last_month").alias("duration"), (later | silent).alias("ended"))


def first_lifetimes(df: DataFrame, by: list[str] | None = None, lapse: int = LAPSE, as_of: Column | None = None) -> DataFrame:
    """The first spell of each customer with attributes of their first order
    (the one with the lowest order_id where several tie): one row a customer."""
    by = list(by or [])
    spells = customer_spells(df, lapse, as_of).filter(F.col("spell") == 1)
    if not by:
        return spells
    attrs = co.customer_cohort(df, by, ties="first").drop("cohort_id")
    return spells.join(attrs, "customer", "inner")


# -- product limit --------------------------------------------------------------
def spell_counts(lifetimes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Ended and censored spells per slice and duration."""
    ended = F.col("ended").cast("int")
    return lifetimes.groupBy(*(by or []), "duration").agg(F.sum(ended).cast("bigint").alias("events"),
                                                         F.sum(1 - ended).cast("bigint").alias("censored"))


def _every_period(counts: DataFrame, by: list[str]) -> DataFrame:
    """A row for each period from 1 to the slice's longest duration."""
    at = F.map_from_entries(F.collect_list(F.struct("duration", F.struct("events", "censored"))))  # one entry a month
    per = counts.groupBy(*by).agg(F.max("duration").alias("longest"), at.alias("held"))
    rows = per.select(*by, "held", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("longest"))).alias("period"))
    held = F.try_element_at(F.col("held"), F.col("period"))
    return rows.select(*by, "period", *[F.coalesce(held.getField(c), F.lit(0)).alias(c) for c in ("events", "censored")])


def life_table(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Product-limit estimate per slice: period, at_risk, events, censored,
    survival (the share still active behind the period) and its standard
    error by Greenwood's formula (NULL once nobody is left)."""
    by = list(by or [])
    rows = _every_period(counts, by)
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ahead = part.orderBy("period").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    so_far = part.orderBy("period").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    table = rows.withColumn("at_risk", F.sum(F.col("events") + F.col("censored")).over(ahead).cast("bigint"))
    n, d = F.col("at_risk").cast("double"), F.col("events").cast("double")
    spread = F.sqrt(F.sum(F.try_divide(d, n * (n - d))).over(so_far))
    return table.select(*by, "period", "at_risk", "events", "censored", F.product(1 - d / n).over(so_far).alias("survival"),
                        F.when(F.min(n - d).over(so_far) > 0, spread).alias("__spread")) \
                .select(*by, "period", "at_risk", "events", "censored", "survival", (F.col("survival") * F.col("__spread")).alias("std_err"))


def lifetime_summary(table: DataFrame, by: list[str] | None = None, horizon: int = 24) -> DataFrame:
    """Per slice of a life table: customers, losses, the median lifetime (first
    period with at most half still active, NULL if not reached) and the mean
    lifetime within ``horizon`` periods (area under the survival steps)."""
    by = list(by or [])
    inside = F.when(F.col("period") < horizon, F.col("survival"))
    last = F.max_by("survival", "period")
    beyond = F.greatest(F.lit(0), F.lit(horizon - 1) - F.max("period"))
    return table.groupBy(*by).agg(
        F.max("at_risk").alias("customers"), F.sum("events").cast("bigint").alias("events"),
        F.min(F.when(F.col("survival") <= 0.5, F.col("period"))).alias("median_lifetime"),
        (1 + F.coalesce(F.sum(inside), F.lit(0.0)) + last * beyond).alias("mean_lifetime"))


# -- log-rank -------------------------------------------------------------------
def log_rank(table: DataFrame, by: list[str]) -> DataFrame:
    """Each slice of a life table against all others together: observed and
    expected losses, variance, chi-squared (one degree of freedom) and its
    p-value.  Without variance (a single slice, or no losses at a period with
    more than one customer) the test is NULL.

    The totals per period are one row a month and join back by period.
    """
    total = table.groupBy("period").agg(F.sum("events").cast("double").alias("__d"), F.sum("at_risk").cast("double").alias("__n"))
    own, d, n = F.col("at_risk").cast("double"), F.col("__d"), F.col("__n")
    expected = d * own / n
    variance = F.when(n > 1, d * (own / n) * (1 - own / n) * (n - d) / (n - 1)).otherwise(F.lit(0.0))
    per = table.join(total, "period").groupBy(*by).agg(
        F.max("at_risk").alias("customers"), F.sum("events").cast("bigint").alias("observed"),
        F.sum(expected).alias("expected"), F.sum(variance).alias("variance"))
    gap = F.col("observed") - F.col("expected")
    tested = per.withColumn("chi_squared", F.when(F.col("variance") > 1e-12, gap * gap / F.col("variance")))
    return tested.withColumn("p_value", F.when(F.col("chi_squared").isNotNull(), chi_square_tail(F.col("chi_squared"), F.lit(1))))
