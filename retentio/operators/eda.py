"""Descriptive queries: distinct counts, per-value counts and shares, levels,
revenue per shop, headline KPIs, schema profile and numeric summary.

Scalars (total orders, total customers) enter other queries as scalar
subqueries (``DataFrame.scalar()``): Spark runs them as their own small job
and folds the value in, with no join and no driver round trip.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from retentio.functions.nulls import na_sum

#: Amounts are added exactly: 26 digits before the point, 12 behind it.
AMOUNT = T.DecimalType(38, 12)


# -- D1 / D2 ------------------------------------------------------------------
def n_distinct_col(col: str, na_rm: bool = False, approx: bool = False) -> Column:
    """Distinct values of ``col`` as an aggregate Column.

    ``na_rm=False`` counts NULL as one more value (R ``n_distinct``);
    ``approx=True`` uses HyperLogLog++ for very large inputs.
    """
    c = F.col(col)
    base = F.approx_count_distinct(c) if approx else F.count_distinct(c)
    if na_rm:
        return base
    return base + F.max(F.when(c.isNull(), 1).otherwise(0))


def n_distinct(df: DataFrame, col: str, alias: str, na_rm: bool = False,
               approx: bool = False) -> DataFrame:
    return df.agg(n_distinct_col(col, na_rm, approx).cast("bigint").alias(alias))


def n_orders(df: DataFrame) -> DataFrame:
    return n_distinct(df, "order_id", "n_orders", na_rm=False)


def n_customers(df: DataFrame, approx: bool = False) -> DataFrame:
    return n_distinct(df, "customer", "n_customers", na_rm=True, approx=approx)


# -- D3 -----------------------------------------------------------------------
def avg_orders_per_customer(df: DataFrame) -> DataFrame:
    """Distinct orders, distinct customers and their ratio in one aggregation
    (one scan; Spark expands the two distinct counts side by side)."""
    agg = df.agg(n_distinct_col("order_id").cast("bigint").alias("n_orders"),
                 n_distinct_col("customer", na_rm=True).cast("bigint").alias("n_customers"))
    return agg.withColumn("avg_orders_per_customer",
                          F.try_divide(F.col("n_orders"), F.col("n_customers").cast("double")))


# -- D4 / D7 / D8 / D16..D18 --------------------------------------------------
def count_by(df: DataFrame, col: str, alias: str = "orders") -> DataFrame:
    """Rows per value of ``col`` (NULL is its own group)."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias(alias))


def orders_per_customer(df: DataFrame) -> DataFrame:
    return count_by(df, "customer", "num_orders")


# -- D5 / D6 ------------------------------------------------------------------
def _bucket_table(df: DataFrame) -> DataFrame:
    """Customers per order count, ``__named`` without the NULL customer."""
    return orders_per_customer(df).groupBy("num_orders").agg(F.count(F.lit(1)).alias("customer_count"),
                                                            F.count("customer").alias("__named"))


def order_buckets(df: DataFrame) -> DataFrame:
    """Customers per order count, and their share of all distinct customers.
    The denominator is a scalar subquery over the bucket table itself, whose
    exchange is shared, so the orders are not read a second time."""
    b = _bucket_table(df)
    total = b.agg(F.sum("__named")).scalar().cast("double")
    return b.select("num_orders", "customer_count", F.try_divide(F.col("customer_count"), total).alias("pct_customers"))


def order_buckets_cumulative(df: DataFrame) -> DataFrame:
    """Running share of customers with at most k orders, and its complement.
    One sort of the bucket table gives the running sums and the total."""
    w = Window.orderBy("num_orders")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.col("__total")
    return (_bucket_table(df)
            .withColumn("customers_at_most", F.sum("customer_count").over(so_far).cast("bigint"))
            .withColumn("__total", F.sum("__named").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).cast("double"))
            .select("num_orders", "customer_count", F.try_divide(F.col("customer_count"), total).alias("pct_customers"), "customers_at_most",
                    F.try_divide(F.col("customers_at_most"), total).alias("pct_at_most"),
                    F.try_divide(total - F.col("customers_at_most"), total).alias("pct_more")))


# -- D9 / D12..D15 ------------------------------------------------------------
def levels(df: DataFrame, col: str, na: str = "last") -> DataFrame:
    """Distinct values; ``na='drop'`` removes NULL, ``'last'`` keeps it (sorted last)."""
    d = df.select(col).distinct()
    if na == "drop":
        return d.filter(F.col(col).isNotNull()).orderBy(col)
    return d.orderBy(F.col(col).asc_nulls_last())


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


# -- D10 / D19 ----------------------------------------------------------------
def share_by(df: DataFrame, col: str) -> DataFrame:
    """Orders per value with share of all distinct orders."""
    total = n_orders(df).scalar().cast("double")
    return count_by(df, col, "orders").withColumn("pct", F.try_divide(F.col("orders"), total))


# -- D11 ----------------------------------------------------------------------
def revenue_by_shop(df: DataFrame) -> DataFrame:
    """Sum of order totals per shop, rounded half to even to whole units.

    Summed as decimal(38,12), so the result does not depend on row order and
    no amount is cut to cents; a NULL total makes the shop's sum NULL.
    """
    amt = F.col("restaurant_total").cast(AMOUNT)
    return df.groupBy("shops_id").agg(
        F.bround(na_sum(amt), 0).cast("double").alias("rest_revenue"))


# -- D20 ----------------------------------------------------------------------
def kpi_summary(df: DataFrame) -> DataFrame:
    """Transactions, first / last order month, customers, orders per customer,
    average order value (decimal, rounded to cents half-even)."""
    agg = df.agg(n_distinct_col("order_id").cast("bigint").alias("transactions"),
                 n_distinct_col("customer", na_rm=True).cast("bigint").alias("customers"),
                 F.min("order_month").alias("first_month"),
                 F.max("order_month").alias("last_month"),
                 F.sum(F.col("restaurant_total").cast(AMOUNT)).alias("__sum"),
                 F.count("restaurant_total").alias("__n"))
    return agg.select(
        "transactions", "first_month", "last_month", "customers",
        F.round(F.try_divide(F.col("transactions"), F.col("customers").cast("double")), 4)
         .alias("orders_per_customer"),
        F.bround(F.try_divide(F.col("__sum"), F.col("__n")), 2).cast("double").alias("avg_order_value"))


# -- A5 -----------------------------------------------------------------------
def schema_profile(df: DataFrame, n_sample: int = 3, order_by: list[str] | None = None) -> DataFrame:
    """One row per column: position, name, Spark type, the table's row count and
    the values of the first ``n_sample`` rows as text (a top-n by ``order_by``,
    the first column unless given; NULL shows as NA)."""
    spark = df.sparkSession
    meta = spark.createDataFrame(
        [(i + 1, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)],
        "position int, column_name string, data_type string")
    keys = [F.col(k).asc_nulls_last() for k in (order_by or [df.columns[0]])]
    first = df.orderBy(*keys).limit(n_sample)
    text = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("NA")) for c in df.columns]
    rows = first.select(F.struct(*keys_plain(order_by or [df.columns[0]]), F.array(*text).alias("__cells")).alias("r"))
    cells = rows.agg(F.array_sort(F.collect_list("r")).alias("rows")).select(F.col("rows.__cells").alias("c")).scalar()
    sample = F.array_join(F.transform("__cells", lambda row: F.get(row, F.col("position") - 1)), " ")
    return (meta.withColumn("n_rows", df.agg(F.count(F.lit(1))).scalar()).withColumn("__cells", cells)
                .withColumn("sample", sample).drop("__cells"))


def keys_plain(names: list[str]) -> list[Column]:
    return [F.col(n).alias(f"__k{i}") for i, n in enumerate(names)]


# -- A6 -----------------------------------------------------------------------
def head_n(df: DataFrame, n: int = 6, order_by: list[str] | None = None) -> DataFrame:
    """First ``n`` rows under an explicit order (a top-n, not a sample)."""
    keys = order_by or [df.columns[0]]
    return df.orderBy(*[F.col(k).asc_nulls_last() for k in keys]).limit(n)
