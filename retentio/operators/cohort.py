"""Cohort stage: first orders, cohort assignment, monthly activity.

Physical design (see README "Scale design"): everything that touches the
full orders table is an aggregation with a map-side partial step, or a join
on ``(customer, date_purchased)``.  No step puts all rows of one customer
into one task, so a customer holding a third of all orders is pre-aggregated
before any shuffle instead of landing on one executor.

* ``customer_months``   groupBy(customer, order_month): min(date_purchased)
  - the active months, and (rolled up by ``keys_from_months``) each
  customer's first purchase and cohort month, from one read of the orders
* ``first_order_rows``  join back on (customer, date_purchased = first_ts);
  a heavy customer's rows spread over many timestamps
* ``weighted_cohort``   tied or copied first orders become a weight
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentio.functions.dates import cohort_period
from retentio.schema import FIRST_ORDER_ATTRS

TIES = ("all", "first")


def _check_ties(ties: str) -> None:
    if ties not in TIES:
        raise ValueError(f"ties must be one of {TIES}")


def customer_months(df: DataFrame, ts: str = "date_purchased") -> DataFrame:
    """Distinct (customer, order_month) with the month's earliest purchase text.

    One partial aggregation over the orders gives both the active months and,
    rolled up once more, each customer's first purchase and cohort month - so
    the cohort stage reads the orders for these two only once.
    """
    return df.groupBy("customer", "order_month").agg(F.min(ts).alias("__first_ts"))


# A month row exists because of a purchase, so it has a purchase text (or, for
# input that was never cleaned, no month at all).  Filtering on it changes no
# row; it keeps the text column in the months branch, so that branch and the
# first-purchase branch read one and the same customer-month exchange.
def _has_purchase():
    return F.col("__first_ts").isNotNull() | F.col("order_month").isNull()


def keys_from_months(cm: DataFrame) -> DataFrame:
    return cm.groupBy("customer").agg(F.min("__first_ts").alias("first_ts"),
                                      F.min("order_month").alias("cohort_id"))


def first_order_keys(df: DataFrame, key: str = "customer", ts: str = "date_purchased",
                     month: str = "order_month") -> DataFrame:
    """Per customer: earliest purchase text (ISO, so earliest instant) and
    earliest order month.  A grouped ``min`` with a partial step per map task,
    so a customer with very many orders is reduced before the shuffle."""
    return df.groupBy(key).agg(F.min(ts).alias("first_ts"), F.min(month).alias("cohort_id"))


def first_order_rows(df: DataFrame, key: str = "customer", ts: str = "date_purchased",
                     ties: str = "all", keys: DataFrame | None = None) -> DataFrame:
    """Order rows at each customer's earliest ``ts``, plus ``cohort_id``.

    ``ties='all'`` keeps every order at the first instant (the reference's
    join keeps them all); ``ties='first'`` keeps the one with the lowest
    ``order_id``.  Both are a join on (customer, instant), so a customer with
    very many orders is spread over many tasks; the 'first' pick is a
    grouped ``min`` over (order_id, row) with a partial step, not a window.
    """
    _check_ties(ties)
    if ties == "first" and keys is None:
        # one aggregation with a partial step: no second scan, no join
        rest = [c for c in df.columns if c not in (key, ts, "order_id")]
        first = F.min(F.when(F.col(ts).isNotNull(), F.struct(ts, "order_id", *rest)))
        best = df.filter(F.col(key).isNotNull()).groupBy(key).agg(first.alias("__r"), F.min("order_month").alias("__cohort"))
        best = best.filter(F.col("__r").isNotNull())
        return best.select(key, "__r.*", F.col("__cohort").alias("cohort_id")).select(*df.columns, "cohort_id")
    keys = keys if keys is not None else first_order_keys(df, key, ts)
    k = keys.select(F.col(key).alias("__k"), "first_ts", "cohort_id")
    rows = df.join(k, (F.col(key) == F.col("__k")) & (F.col(ts) == F.col("first_ts")), "inner")
    rows = rows.drop("__k", "first_ts")
    if ties == "first":
        rest = [c for c in rows.columns if c not in (key, ts, "order_id")]
        best = (rows.groupBy(key, ts)
                    .agg(F.min(F.struct(F.col("order_id").alias("order_id"), *rest)).alias("__r")))
        rows = best.select(key, ts, "__r.*")
    return rows.select(*df.columns, "cohort_id")


# -- E1 -----------------------------------------------------------------------
def customer_first_order(df: DataFrame, ties: str = "all") -> DataFrame:
    """Full order row(s) at each customer's first purchase instant."""
    return first_order_rows(df, ties=ties).drop("cohort_id")


# -- E2 -----------------------------------------------------------------------
def customer_cohort(df: DataFrame, attrs: list[str] | None = None, ties: str = "all",
                    keys: DataFrame | None = None) -> DataFrame:
    """``cohort_id`` (first order month) and first-order attributes per customer."""
    attrs = list(FIRST_ORDER_ATTRS if attrs is None else attrs)
    rows = first_order_rows(df, ties=ties, keys=keys)
    return rows.select("customer", "cohort_id", *attrs)


# -- E3 -----------------------------------------------------------------------
def active_months(df: DataFrame) -> DataFrame:
    """Distinct (customer, order_month)."""
    return df.select("customer", "order_month").distinct()


def customer_activity(df: DataFrame, cohort: DataFrame | None = None,
                      attrs: list[str] | None = None, ties: str = "all") -> DataFrame:
    """Every month a customer ordered in, with the customer's cohort attributes."""
    if cohort is not None:
        return active_months(df).join(cohort, on="customer", how="left")
    # Same two reads of the orders as ``cohort_tables``: the customer-month
    # table gives both the months and the first purchases.
    attrs = list(FIRST_ORDER_ATTRS if attrs is None else attrs)
    cm = customer_months(df)
    cohort = (first_order_rows(df, ties=ties, keys=keys_from_months(cm))
              .select("customer", "cohort_id", *attrs))
    months = cm.filter(_has_purchase()).select("customer", "order_month")
    return months.join(cohort, on="customer", how="left")


# -- E4 -----------------------------------------------------------------------
def weighted_cohort(cohort: DataFrame, attrs: list[str]) -> DataFrame:
    """One row per (customer, cohort, attributes) with ``__w`` = how many
    first-order rows carry them (1 unless first orders tie or are copied)."""
    return cohort.groupBy("customer", "cohort_id", *attrs).agg(F.count(F.lit(1)).alias("__w"))


def activity_from_weighted(df: DataFrame, weighted: DataFrame, attrs: list[str]) -> DataFrame:
    act = active_months(df).join(weighted, on="customer", how="inner")
    out = (act.groupBy("order_month", "cohort_id", *attrs)
              .agg(F.sum("__w").alias("active_customers")))
    return out.withColumn("cohort_period", cohort_period("cohort_id", "order_month"))


def counts_from_weighted(weighted: DataFrame, attrs: list[str]) -> DataFrame:
    return weighted.groupBy("cohort_id", *attrs).agg(F.sum("__w").alias("cohort_count"))


def cohort_activity(df: DataFrame, attrs: list[str] | None = None, ties: str = "all",
                    cohort: DataFrame | None = None) -> DataFrame:
    """Active customers per order_month x cohort x attributes, with cohort_period.

    Same numbers as counting the rows of ``customer_activity``, without
    building it: first-order rows are first collapsed to one weighted row per
    (customer, cohort, attributes) - duplicated first orders become a
    weight, not a fan-out - and the weight is summed over the active months.
    """
    attrs = list(FIRST_ORDER_ATTRS if attrs is None else attrs)
    if cohort is None:
        return cohort_tables(df, attrs, ties)[0]
    return activity_from_weighted(df, weighted_cohort(cohort, attrs), attrs)


def cohort_tables(df: DataFrame, attrs: list[str] | None = None,
                  ties: str = "all") -> tuple[DataFrame, DataFrame]:
    """``(cohort_activity, cohort_counts)`` for the whole cohort stage.

    The orders are read twice: once into the customer-month table (active
    months, and first purchase / cohort month rolled up from it) and once
    for the join back to the first-order rows.  The weighted first-order
    table feeds both outputs, so its exchange is computed once and reused.
    """
    attrs = list(FIRST_ORDER_ATTRS if attrs is None else attrs)
    cm = customer_months(df)
    keys = keys_from_months(cm)
    cohort = first_order_rows(df, ties=ties, keys=keys if ties == "all" else None).select("customer", "cohort_id", *attrs)
    weighted = weighted_cohort(cohort, attrs)
    act = cm.filter(_has_purchase()).join(weighted, on="customer", how="inner")
    activity = (act.groupBy("order_month", "cohort_id", *attrs)
                   .agg(F.sum("__w").alias("active_customers"))
                   .withColumn("cohort_period", cohort_period("cohort_id", "order_month")))
    return activity, counts_from_weighted(weighted, attrs)


# -- E5 -----------------------------------------------------------------------
def cohort_counts(cohort: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Cohort size per every column but ``customer`` (or per ``by``)."""
    by = list(by) if by is not None else [c for c in cohort.columns if c != "customer"]
    return cohort.groupBy(*by).agg(F.count(F.lit(1)).alias("cohort_count"))
