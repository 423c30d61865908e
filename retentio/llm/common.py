"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retentio.session import scratch_path

#: ASCII white space of the word and line rules: space, tab, LF, VT, FF, CR.
ASCII_SPACE = b" \t\n\x0b\x0c\r"
#: Stands for a null id inside the operators; smaller than every real id.
NULL_ID = -(2 ** 63)


def with_library(spark: SparkSession) -> None:
    """Lets Python workers import this library from where the driver has it
    (for executors that see that path; elsewhere it must be installed)."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    with_library(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back: cuts
    the lineage, survives lost executors and freezes minted row ids."""
    with_library(df.sparkSession)
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match; the keys come from ``left``.  (The
    right keys are renamed, so frames of one origin can be joined.)"""
    names = [f"__right{k}" for k in range(len(keys))]
    other = right.select(*[F.col(k).alias(n) for k, n in zip(keys, names)],
                         *[F.col(c) for c in right.columns if c not in keys])
    cond = F.lit(True)
    for k, n in zip(keys, names):
        cond = cond & F.col(k).eqNullSafe(F.col(n))
    return left.join(other, cond, how).drop(*names)


def rank_in(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` plus ``rank``: the gapless 0-based place of each row in its group.

    A group may hold most rows, so no window runs over it: the rows are range
    partitioned by (keys, order), sorted and written once with a running
    number; the rank is that number less the first one of the group in the
    partition, plus the group's rows in earlier partitions (a small table of
    one row per group and partition).  Rows with equal keys and order get
    different ranks.
    """
    cols = [*keys, *order]
    rows = materialise(
        df.repartitionByRange(*cols).sortWithinPartitions(*cols)
          .withColumn("__run", F.monotonically_increasing_id()), name)
    rows = rows.withColumn("__part", F.shiftright("__run", 33))
    runs = rows.groupBy(*keys, "__part").agg(F.min("__run").alias("__first"), F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    return join_on(rows, runs, [*keys, "__part"]).select(
        *df.columns, (F.col("__run") - F.col("__first") + F.col("__before")).alias("rank"))


def with_row_key(docs: DataFrame) -> DataFrame:
    """Adds ``__id`` (doc_id, null as the smallest) and ``__th`` (64-bit text
    hash): rows that agree on both are repeats of one document."""
    return (docs.withColumn("__id", F.coalesce(F.col("doc_id"), F.lit(NULL_ID).cast("bigint")))
                .withColumn("__th", F.xxhash64(F.col("text"))))
