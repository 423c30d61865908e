"""File sources and sinks (CSV in, Parquet for the corrected table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentio.schema import CORRECTED_SCHEMA, ORDERS_SCHEMA, ZIP_SCHEMA


def _read_named(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool) -> DataFrame:
    """CSV columns by the names in the header, in any order, others ignored.

    The header fixes the layout (files of one folder must agree on it, else
    the read fails); every cell is read as text and cast, and a cell that is
    not of its type becomes NULL.  Numbers for integer columns may be written
    with a point or an exponent, as 1.33e+10.
    """
    options = dict(header=True, nullValue="NA", escape='"', multiLine=multi_line, mode="PERMISSIVE")
    names = spark.read.options(**options).csv(path).columns
    missing = [f.name for f in schema.fields if f.name not in names]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)} in the header ({', '.join(names)})")
    layout = T.StructType([T.StructField(n, T.StringType()) for n in names])
    text = spark.read.schema(layout).options(**options, enforceSchema=False).csv(path)

    def typed(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            return c.alias(f.name)
        if isinstance(f.dataType, (T.LongType, T.IntegerType)):
            kind = f.dataType.simpleString()
            return F.coalesce(c.try_cast(kind), c.try_cast("double").try_cast(kind)).alias(f.name)
        return c.try_cast(f.dataType.simpleString()).alias(f.name)

    return text.select(*[typed(f) for f in schema.fields])


def read_orders(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Orders CSV with a header row, columns taken by name.

    The literal text ``NA`` is read as NULL (the reference's CSV reader does
    the same); blank text cells come back NULL too, and the cleaning stage
    treats NULL and ``''`` alike.  ``multi_line`` lets quoted cells hold line
    breaks (a file is then read by one task).
    """
    return _read_named(spark, path, ORDERS_SCHEMA, multi_line)


def read_zip_lookup(spark: SparkSession, path: str) -> DataFrame:
    """Zip-code CSV, keeping the postal code and its state (by name)."""
    return _read_named(spark, path, ZIP_SCHEMA, False)


def write_orders_csv(df: DataFrame, path: str) -> None:
    """Write an orders-shaped table as headed CSV (``NA`` for NULL)."""
    (df.write.mode("overwrite")
       .options(header=True, nullValue="NA", escape='"')
       .csv(path))


def write_corrected(df: DataFrame, path: str) -> None:
    """Persist the cleaned table as Parquet, partitioned by ``order_month``.

    Partitioning by month lets the cohort stage prune whole months when it
    reads a date range back.  The ``rebalance`` hint shuffles rows by month
    into partitions that AQE sizes to the advisory size - splitting a heavy
    month, merging light ones - so each month gets a few full-size files
    instead of one small file per input task (or one giant task per month).
    """
    (df.hint("rebalance", "order_month")
       .write.mode("overwrite").partitionBy("order_month").parquet(path))


def read_corrected(spark: SparkSession, path: str) -> DataFrame:
    """Read the corrected table back, typed; ``order_month`` comes from the folder names."""
    return spark.read.schema(CORRECTED_SCHEMA).parquet(path)


#: Input bytes for each bucket.
BUCKET_BYTES = 256 * 1024 * 1024


def bucket_count(df: DataFrame) -> int:
    """Buckets for a table of this size: one per ``BUCKET_BYTES`` of the files
    behind it, at least one per core of the cluster."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size()))
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-size // BUCKET_BYTES))


def save_corrected_table(df: DataFrame, table: str, path: str, buckets: int | None = None) -> None:
    """Save the cleaned table as a catalog table bucketed by
    (customer, date_purchased) and partitioned by ``order_month``.

    The cohort stage's largest shuffle is the join back to the first-order
    rows, keyed on exactly (customer, date_purchased).  Read from this table,
    that join finds the orders already hashed into ``buckets`` buckets, so
    only the small per-customer side moves.  The instant is part of the
    bucket key so that one customer with very many orders still spreads over
    many buckets.  ``path`` (in the shared folder) holds the data; the
    catalog holds the bucket spec that the planner reads.
    """
    buckets = buckets or bucket_count(df)
    (df.repartition(buckets, "customer", "date_purchased")
       .write.mode("overwrite")
       .partitionBy("order_month")
       .bucketBy(buckets, "customer", "date_purchased")
       .option("path", path)
       .saveAsTable(table))
