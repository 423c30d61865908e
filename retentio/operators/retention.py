"""Retention: rollups of the cohort tables, rates, matrices, seeds, churn.

The inputs here are cohort tables (months x cohorts x slice values).  No join
forces a broadcast: AQE broadcasts at run time when the measured size of a
side is under the threshold and shuffles otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from retentio.functions.dates import cohort_period, previous_month
from retentio.functions.labels import percent_label
from retentio.operators import cohort as co


# -- F1 / F4 / F7 -------------------------------------------------------------
def cohort_size(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = list(by or [])
    return counts.groupBy("cohort_id", *by).agg(
        F.sum("cohort_count").cast("bigint").alias("cohort_count"))


# -- F2 / F5 / F8 -------------------------------------------------------------
def cohort_active(activity: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = list(by or [])
    out = activity.groupBy("order_month", "cohort_id", *by).agg(
        F.sum("active_customers").cast("bigint").alias("active_customers"))
    return out.withColumn("cohort_period", cohort_period("cohort_id", "order_month"))


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    r = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys],
                     *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        e = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        cond = e if cond is None else cond & e
    return left.join(r, cond, how).drop(*[f"__r_{k}" for k in keys])


# -- F3 / F6 / F9 -------------------------------------------------------------
def retention(activity: DataFrame, counts: DataFrame, by: list[str] | None = None,
              with_cohort_text: bool | None = None) -> DataFrame:
    """Active customers / cohort size per order month x cohort [x slice].

    Slice keys match NULL to NULL (the reference's joins do).  ``cohort`` is
    the cohort month as text, added for sliced forms as the reference does.
    The join is left to the planner, which broadcasts the cohort sizes at run
    time when their measured size is under its threshold.
    """
    by = list(by or [])
    act = cohort_active(activity, by)
    size = cohort_size(counts, by)
    out = _null_safe_join(act, size, ["cohort_id", *by], "left")
    out = out.withColumn("retention_rate",
                         F.try_divide(F.col("active_customers"), F.col("cohort_count").cast("double")))
    if with_cohort_text is None:
        with_cohort_text = bool(by)
    if with_cohort_text:
        out = out.withColumn("cohort", F.col("cohort_id").cast("string"))
    return out


# -- F10 ----------------------------------------------------------------------
def matrix_periods(df: DataFrame, month: str = "order_month") -> list[int]:
    """Every period that can occur: 1 to the number of months the table spans.
    (Two dates come to the driver.)"""
    r = df.agg(F.min(month).alias("lo"), F.max(month).alias("hi")).head()
    if r["lo"] is None:
        return []
    return list(range(1, (r["hi"].year - r["lo"].year) * 12 + r["hi"].month - r["lo"].month + 2))


def periods_between(first_month: str, cutoff: str) -> list[int]:
    """Every period of a table whose months lie from ``first_month`` up to, but
    not including, ``cutoff`` (ISO dates): what is known of a table without
    reading it."""
    a, b = date.fromisoformat(first_month), date.fromisoformat(cutoff)
    return list(range(1, (b.year - a.year) * 12 + b.month - a.month + (b.day > 1) + 1))


def retention_matrix(ret: DataFrame, periods: list[int], by: list[str] | None = None,
                     prefix: str = "p") -> DataFrame:
    """Cohort rows x period columns of retention_rate.

    The period list is given (``periods_between`` takes it from known months,
    ``matrix_periods`` reads it from a table), so the schema is fixed; a period of ``ret`` that the list misses fails the query, so no
    cell is dropped.
    """
    by = list(by or [])
    period = F.col("cohort_period")
    known = period.isNull() | period.isin([int(p) for p in periods])
    checked = ret.withColumn("cohort_period", F.when(known, period).otherwise(F.raise_error(
        F.concat(F.lit("retention_matrix: period not in the list: "), period.cast("string"))).cast("bigint")))
    piv = (checked.groupBy("cohort_id", *by)
              .pivot("cohort_period", list(periods))
              .agg(F.max("retention_rate")))
    return piv.select("cohort_id", *by,
                      *[F.col(str(p)).alias(f"{prefix}{p}") for p in periods])


def matrix_to_long(matrix: DataFrame, periods: list[int], by: list[str] | None = None,
                   prefix: str = "p") -> DataFrame:
    """Inverse of ``retention_matrix`` (non-NULL cells only)."""
    by = list(by or [])
    long = matrix.unpivot(["cohort_id", *by], [f"{prefix}{p}" for p in periods],
                          "period_col", "retention_rate")
    return (long.filter(F.col("retention_rate").isNotNull())
                .withColumn("cohort_period",
                            F.substring("period_col", len(prefix) + 1, 10).cast("bigint"))
                .drop("period_col"))


# -- F11 ----------------------------------------------------------------------
def retention_labels(ret: DataFrame, na_label: str | None = None) -> DataFrame:
    return ret.withColumn("label", percent_label("retention_rate", na_label))


# -- F12..F14 -----------------------------------------------------------------
def activity_by(activity: DataFrame, facet: str | None) -> DataFrame:
    keys = ["cohort_id", "order_month"] + ([facet] if facet else [])
    return activity.groupBy(*keys).agg(
        F.sum("active_customers").cast("bigint").alias("active_customers"))


# -- F15 ----------------------------------------------------------------------
def stacked_bands(act: DataFrame, facet: str | None = None) -> DataFrame:
    """Cohorts stacked oldest at the bottom, per facet and month.

    The window holds one facet-month: at most one row per cohort.
    """
    part = ([facet] if facet else []) + ["order_month"]
    w = (Window.partitionBy(*part).orderBy("cohort_id")
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    upper = F.sum("active_customers").over(w).cast("bigint")
    return (act.withColumn("band_upper", upper)
               .withColumn("band_lower", F.col("band_upper") - F.col("active_customers")))


# -- F16 / F17 ----------------------------------------------------------------
def with_seed_rows(activity: DataFrame) -> DataFrame:
    """Adds a zero row per cohort in the month before it (area-plot baseline)."""
    seeds = (activity.select("cohort_id").distinct()
             .select(previous_month("cohort_id").alias("order_month"), "cohort_id",
                     F.lit(0).cast("bigint").alias("active_customers"),
                     F.lit(0).cast("bigint").alias("cohort_period")))
    return activity.unionByName(seeds, allowMissingColumns=True)


def area_series(activity: DataFrame) -> DataFrame:
    seeded = with_seed_rows(activity)
    return seeded.groupBy("cohort_id", "order_month").agg(
        F.sum("active_customers").cast("bigint").alias("active_customers"))


# -- F18 ----------------------------------------------------------------------
def churn(ret: DataFrame) -> DataFrame:
    return ret.withColumn("churn_rate", 1 - F.col("retention_rate"))


# -- I1..I5 -------------------------------------------------------------------
def retention_by(df: DataFrame, attr: str, ties: str = "all") -> DataFrame:
    """Retention sliced by one first-order attribute (any column or expression
    already added to ``df``)."""
    act, counts = co.cohort_tables(df, [attr], ties)
    return retention(act, counts, [attr], with_cohort_text=False)


def audience_segments(df: DataFrame) -> DataFrame:
    """Per customer: cohort, last active month and its period, number of active
    months, and ``active`` / ``lapsed`` by whether the last month of the table
    is among them.  One grouped aggregation of the distinct customer-months."""
    months = co.active_months(df.filter(F.col("order_month").isNotNull()))
    last = df.agg(F.max("order_month")).scalar()
    per = months.groupBy("customer").agg(F.min("order_month").alias("cohort_id"), F.max("order_month").alias("last_month"),
                                         F.count(F.lit(1)).alias("active_months"))
    return per.withColumn("last_period", cohort_period("cohort_id", "last_month")) \
              .withColumn("segment", F.when(F.col("last_month") == last, "active").otherwise("lapsed"))


def acquisition_growth(counts: DataFrame) -> DataFrame:
    """New customers per cohort month, change from the previous cohort, running total.

    Input is the per-cohort size table (one row per cohort month).
    """
    size = cohort_size(counts)
    w = Window.orderBy("cohort_id")
    prev = F.lag("cohort_count").over(w)
    run = F.sum("cohort_count").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (size.withColumn("prev_count", prev)
                .withColumn("growth_rate", F.try_divide(F.col("cohort_count") - F.col("prev_count"),
                                                        F.col("prev_count").cast("double")))
                .withColumn("customers_to_date", run.cast("bigint")))



@dataclass
class RetentionReport:
    """Retention per slice over one persisted pair of cohort tables."""
    activity: DataFrame
    counts: DataFrame
    slices: dict[tuple[str, ...], DataFrame] = field(default_factory=dict)

    def __getitem__(self, by) -> DataFrame:
        return self.slices[tuple(by)]

    def unpersist(self) -> None:
        self.activity.unpersist()
        self.counts.unpersist()


def retention_report(df: DataFrame, slices: list[list[str]] | None = None, ties: str = "all",
                     storage_level=None) -> RetentionReport:
    """Retention for several slices from one cohort computation.

    The cohort tables are built once and persisted - they are small (months x
    cohorts x attribute levels), so keeping them costs little and every
    slice after the first reads them instead of the orders.  Each slice's
    retention is a rollup of the same persisted tables.  Persisted blocks
    lost with an executor are recomputed from lineage.  Call ``unpersist()``
    on the report when done.
    """
    from pyspark import StorageLevel

    slices = slices if slices is not None else [[], ["has_promo_value"], ["promo_value"]]
    attrs = sorted({c for s in slices for c in s})
    act, counts = co.cohort_tables(df, attrs, ties)
    level = storage_level or StorageLevel.MEMORY_AND_DISK
    report = RetentionReport(act.persist(level), counts.persist(level))
    for s in slices:
        report.slices[tuple(s)] = retention(report.activity, report.counts, list(s))
    return report
