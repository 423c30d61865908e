"""Late and corrected orders into a saved table, month by month.

The table holds the cleaned columns plus ``version`` (a whole number that
grows with every load) and is partitioned by ``order_month``.  Of several
versions of an order id the newest wins, wherever the others lie: a corrected
date may move an order to another month.  Only months that an order enters,
leaves or changes in are rewritten, by dynamic partition overwrite; the files
of all others stay.

The late rows are evaluated once.  The new content of those months is written
to the shared scratch folder first, so the overwrite reads nothing it replaces, a lost executor costs a
retry, and a load that broke off can simply be run again: replaying a load,
or an older one, leaves the table as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentio.schema import CORRECTED_SCHEMA
from retentio.session import scratch_path

VERSIONED_SCHEMA = T.StructType([*CORRECTED_SCHEMA.fields[:-1], T.StructField("version", T.LongType()), CORRECTED_SCHEMA.fields[-1]])
_COLUMNS = [f.name for f in VERSIONED_SCHEMA.fields]


def read_versioned(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VERSIONED_SCHEMA).parquet(path)


def write_versioned(df: DataFrame, path: str) -> None:
    """The first load: every row of ``df`` (cleaned columns and version)."""
    df.select(*_COLUMNS).hint("rebalance", "order_month").write.mode("overwrite").partitionBy("order_month").parquet(path)


def _own(columns: list[str]):
    """Tells rows without an order id apart, by their whole content."""
    return F.when(F.col("order_id").isNull(), F.xxhash64(*[F.col(c) for c in columns]))


def changes(contested: DataFrame, late: DataFrame) -> DataFrame:
    """What a load changes: order_id, own, the row that holds from now on and
    the months that held the order so far.

    Of all rows of an order id, held and late, the highest version wins, of
    equal versions the row that is largest column by column (so reruns agree).
    Rows without an order id are told apart by their whole content.  An order
    whose only row in the table is the winner is left out.
    """
    columns = [c for c in late.columns if c != "version"]
    rows = contested.withColumn("__held", F.lit(1)).unionByName(late.withColumn("__held", F.lit(0)))
    held = F.col("__held") == 1
    each = rows.withColumn("own", _own(late.columns)).groupBy("order_id", "own").agg(
        F.max(F.struct("version", *columns, "__held")).alias("row"), F.count_if(held).alias("n"),
        F.collect_set(F.when(held, F.struct("order_month"))).alias("months"))
    return each.filter((F.col("n") != 1) | (F.col("row.__held") == 0)).drop("n")


def _written(df: DataFrame, name: str) -> DataFrame:
    """Written once to the shared scratch folder and read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _months(df: DataFrame) -> list:
    """The distinct months of ``df`` (one value a month reaches the driver)."""
    return [r[0] for r in df.select("order_month").distinct().collect()]


def _in_months(df: DataFrame, months: list) -> DataFrame:
    """Rows of those months, pruned to their folders; NULL is a month of its own."""
    known = [m for m in months if m is not None]
    cond = F.col("order_month").isin(known) if known else F.lit(False)
    return df.filter(cond | F.col("order_month").isNull() if None in months else cond)


def merged_months(table: DataFrame, late: DataFrame) -> tuple[DataFrame, list]:
    """The rows that the touched months hold after the load, and those months:
    the ones that an order leaves, enters or changes in.

    Order ids of the late rows are looked up in the whole table (two columns
    of it are read); everything else reads only the months those orders lie
    in.  ``late`` is written down once, and so are the orders that change.
    """
    spark = table.sparkSession
    late = _written(late.select(*_COLUMNS), "upsert-late")
    ids = late.select(F.col("order_id").alias("__id")).distinct()
    same = F.col("order_id").eqNullSafe(F.col("__id"))
    lying = _months(table.select("order_id", "order_month").join(ids, same, "left_semi"))
    contested = _in_months(table, lying).join(ids, same, "left_semi")
    changed = _written(changes(contested, late), "upsert-changes")
    entered = _months(changed.select("row.order_month"))
    left = _months(changed.select(F.inline("months")))
    months = sorted({*entered, *left}, key=lambda m: (m is not None, m))
    if not months:
        return spark.createDataFrame([], VERSIONED_SCHEMA), months
    keys = changed.select(F.col("order_id").alias("__id"), F.col("own").alias("__own"))
    untouched = _in_months(table, months).join(keys, same & _own(_COLUMNS).eqNullSafe(F.col("__own")), "left_anti")
    return untouched.unionByName(changed.select(*[F.col(f"row.{c}") for c in _COLUMNS])), months


def upsert_corrected(spark: SparkSession, path: str, late: DataFrame) -> list:
    """Bring ``late`` (cleaned columns and version) into the table at ``path``;
    returns the months rewritten.

    A late row with an older version than the table's changes nothing, nor
    does one that the table holds already: months without a change keep their
    files.  A month that loses its last order loses its folder.
    """
    merged, months = merged_months(read_versioned(spark, path), late)
    if not months:
        return []
    staged = _written(merged, "upsert")
    (staged.hint("rebalance", "order_month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
           .partitionBy("order_month").parquet(path))
    _drop_months(spark, path, sorted({*months} - {*_months(staged)}, key=str))
    return months


def _drop_months(spark: SparkSession, path: str, months: list) -> None:
    """Remove the folders of months that no row is left in."""
    for m in months:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/order_month={'__HIVE_DEFAULT_PARTITION__' if m is None else m.isoformat()}")
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
