"""Cleaning stage: missing values, lookup imputation, dates, trim, flags.

Every operator is a lazy DataFrame transformation; ``clean_orders`` composes
them into one plan with no intermediate action, so Catalyst sees the whole
stage and pushes the filters into the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentio.functions.dates import order_date, order_month, order_week
from retentio.functions.nulls import missing_in, na_max, na_min
from retentio.session import scratch_path


# -- B1 -----------------------------------------------------------------------
def missing_columns(df: DataFrame) -> DataFrame:
    """Columns holding at least one missing value, with how many.

    One aggregation pass over all columns, unpivoted afterwards; output rows
    ``(column_name, n_missing)`` for columns with ``n_missing > 0``.
    """
    counts = df.agg(*[
        F.count_if(missing_in(df, c)).alias(c) for c in df.columns
    ])
    stacked = counts.unpivot([], df.columns, "column_name", "n_missing")
    return stacked.filter(F.col("n_missing") > 0)


# -- B2 / B3 ------------------------------------------------------------------
def missing_rows(df: DataFrame, col: str) -> DataFrame:
    return df.filter(missing_in(df, col))


def drop_missing(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.filter(~missing_in(df, c))
    return df


# -- B4 / B5 ------------------------------------------------------------------
def impute_by_lookup(df: DataFrame, lookup: DataFrame, left_key: str, right_key: str,
                     target: str, value: str) -> DataFrame:
    """Inner join on ``left_key = right_key``; ``target`` takes the lookup value.

    Unmatched rows vanish and duplicate lookup keys fan out, as an inner join
    does.  The lookup side is left to the planner: a small lookup is
    broadcast from its known size, a large one is shuffled.
    """
    lk = lookup.select(F.col(right_key).alias("__lk"), F.col(value).alias("__lv"))
    joined = df.join(lk, F.col(left_key) == F.col("__lk"), "inner")
    return joined.withColumn(target, F.col("__lv")).drop("__lk", "__lv")


def append(df1: DataFrame, df2: DataFrame) -> DataFrame:
    """All rows of both, matched by column name, duplicates kept."""
    return df1.unionByName(df2, allowMissingColumns=True)


def impute_missing(df: DataFrame, lookup: DataFrame, left_key: str, right_key: str,
                   target: str, value: str) -> DataFrame:
    """``append(complete rows, impute_by_lookup(rows missing target))`` in one pass.

    Same rows as the split / join / union form, but the input is read once:
    a left join whose condition also requires the target to be missing, so
    complete rows never match (no fan-out for them) and pass through, while
    rows missing the target keep one row per lookup match and are dropped
    when nothing matches.
    """
    is_miss = missing_in(df, target)
    lk = lookup.select(F.col(right_key).alias("__lk"), F.col(value).alias("__lv"),
                       F.lit(True).alias("__hit"))
    joined = df.join(lk, (F.col(left_key) == F.col("__lk")) & is_miss, "left")
    kept = joined.filter(~is_miss | F.col("__hit").isNotNull())
    return (kept.withColumn(target, F.when(is_miss, F.col("__lv")).otherwise(F.col(target)))
                .drop("__lk", "__lv", "__hit"))


# -- B6 / B7 / B8 -------------------------------------------------------------
def with_has_promo(df: DataFrame) -> DataFrame:
    """``has_promo_value = promo_value != 0``; a NULL promo stays NULL."""
    return df.withColumn("has_promo_value", F.col("promo_value") != 0)


def filter_equals(df: DataFrame, col: str, value) -> DataFrame:
    return df.filter(F.col(col) == F.lit(value))


def null_if(df: DataFrame, col: str, value) -> DataFrame:
    return df.withColumn(col, F.nullif(F.col(col), F.lit(value)))


# -- B9 -----------------------------------------------------------------------
def encode_levels(df: DataFrame, cols: str | list[str]) -> DataFrame:
    """Adds ``<col>_code`` per column: 1-based position of the value among its sorted levels.

    One pass over the rows finds the distinct values of all columns together
    (partial aggregation, so a value that many rows hold costs one row per
    task).  The numbered levels are written to the shared scratch folder:
    their size is then known, and the planner broadcasts them to the rows if
    they are small and shuffles otherwise.
    """
    cols = [cols] if isinstance(cols, str) else list(cols)
    pairs = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in cols])
    levels = df.select(F.inline(pairs)).filter(F.col("value").isNotNull()).distinct()
    order = F.col("value") if len({df.schema[c].dataType for c in cols} | {T.StringType()}) == 1 else None
    if order is None:  # numbers sort as numbers
        order = F.coalesce(*[F.when(F.col("col") == c, F.struct(F.col("value").cast(df.schema[c].dataType).cast("double"), "value"))
                             if not isinstance(df.schema[c].dataType, T.StringType)
                             else F.when(F.col("col") == c, F.struct(F.lit(None).cast("double"), "value")) for c in cols])
    coded = levels.withColumn("code", F.row_number().over(Window.partitionBy("col").orderBy(order)).cast("int"))
    path = scratch_path(df.sparkSession, "levels")
    coded.write.parquet(path)
    coded = df.sparkSession.read.schema(coded.schema).parquet(path)
    for k, c in enumerate(cols):
        own = coded.filter(F.col("col") == c).select(F.col("value").alias(f"__v{k}"), F.col("code").alias(f"{c}_code"))
        df = df.join(own, F.col(c).cast("string") == F.col(f"__v{k}"), "left").drop(f"__v{k}")
    return df


# -- C1..C3, C5 ---------------------------------------------------------------
def with_dates(df: DataFrame, ts_col: str = "date_purchased", week_start: str = "sunday") -> DataFrame:
    d = order_date(ts_col)
    return df.withColumns({"order_date": d, "order_month": order_month(d),
                           "order_week": order_week(d, week_start)})


def trim_before(df: DataFrame, col: str, cutoff: str, month_col: str | None = None) -> DataFrame:
    """Keep rows with ``col < cutoff`` (drops a partial trailing period).

    ``month_col`` names the month column a saved table is partitioned by; the
    implied ``month_col <= trunc(cutoff)`` predicate is added so whole later
    months are pruned at file listing instead of being read and filtered.
    """
    cut = F.lit(cutoff).cast("date")
    out = df.filter(F.col(col) < cut)
    if month_col is not None:
        out = out.filter(F.col(month_col) <= F.trunc(cut, "month"))
    return out


def date_range(df: DataFrame, col: str = "order_date") -> DataFrame:
    """First and last date; NULL as soon as one date is (``min`` without ``na.rm``)."""
    return df.agg(na_min(col).alias("min_date"), na_max(col).alias("max_date"))


# -- B11 ----------------------------------------------------------------------
def clean_orders(orders: DataFrame, lookup: DataFrame, cutoff: str | None,
                 sentinel: str | None = "/", repair_sentinel: bool = True,
                 week_start: str = "sunday") -> DataFrame:
    """The whole cleaning stage, in the reference's order.

    drop missing date -> drop missing customer -> impute missing state from
    the postal-code lookup (unmatched rows dropped) -> date columns -> trim
    -> promo flag -> sentinel payment method to NULL.
    """
    df = drop_missing(orders, "date_purchased", "customer")
    df = impute_missing(df, lookup, "postal_code", "zip", "state", "state_id")
    df = with_dates(df, "date_purchased", week_start)
    if cutoff is not None:
        df = trim_before(df, "order_date", cutoff)
    df = with_has_promo(df)
    if repair_sentinel and sentinel is not None:
        df = null_if(df, "payment_method", sentinel)
    return df

