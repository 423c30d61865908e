"""Exact quantiles without gathering a column into one task.

Spark's exact ``percentile`` merges a value -> count map of the whole column
in one final task, which does not hold for a high-cardinality column of a
100 TB table.  Here the wanted order statistics of all columns are looked up
in one distributed sort:

1. the numeric columns become long rows and are reduced to (column, value,
   count) with a partial step per task, so a value that a third of all rows
   hold is one row;
2. these are range partitioned by (column, value) and written once to the
   shared scratch folder, together with the number of their partition;
3. counts per partition give every partition's first rank (a small table of
   one row per column and partition), and a running sum inside a partition
   gives every value its range of ranks;
4. the wanted ranks pick their values.

The number of jobs is fixed, whatever the rows; no value reaches the driver
but the wanted ones.  Values are compared, never subtracted, so infinities and
the largest doubles are ordinary.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retentio.session import scratch_path

PROBS = (0.25, 0.5, 0.75)


def _long(df: DataFrame, cols: list[str]) -> DataFrame:
    pairs = [F.struct(F.lit(c).alias("k"), F.col(f"`{c}`").cast("double").alias("x")) for c in cols]
    return (df.select(F.inline(F.array(*pairs)))
              .filter(F.col("x").isNotNull() & ~F.isnan("x")))


def sorted_counts(values: DataFrame) -> DataFrame:
    """``(k, x, below, n)``: each distinct value of column ``k``, how many rows
    are smaller and how many hold it."""
    spark = values.sparkSession
    counts = (values.groupBy("k", "x").agg(F.count(F.lit(1)).alias("n"))
                    .repartitionByRange("k", "x").withColumn("part", F.spark_partition_id()))
    path = scratch_path(spark, "values")
    counts.write.parquet(path)
    counts = spark.read.schema(counts.schema).parquet(path)
    whole = counts.groupBy("k", "part").agg(F.sum("n").alias("total"))
    earlier = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = whole.select(F.col("k").alias("__k"), F.col("part").alias("__p"),
                         F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("first"))
    inside = Window.partitionBy("k", "part").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    run = counts.withColumn("run", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return (run.join(first, (F.col("k") == F.col("__k")) & (F.col("part") == F.col("__p")))
               .select("k", "x", (F.col("first") + F.col("run")).alias("below"), "n"))


def order_statistics(values: DataFrame, wanted: dict[str, list[int]]) -> dict[tuple[str, int], float]:
    """Exact r-th smallest value (0-based) of column ``k`` of the long table
    ``values(k, x)`` for every ``r`` in ``wanted[k]``."""
    pairs = [(k, int(r)) for k, ranks in wanted.items() for r in ranks]
    if not pairs:
        return {}
    want = values.sparkSession.createDataFrame(pairs, "wk string, r long")
    hit = sorted_counts(values).join(F.broadcast(want), (F.col("k") == F.col("wk")) & (F.col("below") <= F.col("r"))
                                     & (F.col("r") < F.col("below") + F.col("n")))  # a row per wanted rank
    return {(h["k"], h["r"]): h["x"] for h in hit.select("k", "r", "x").collect()}


def _type7(n: int, p: float) -> tuple[int, int, float]:
    h = (n - 1) * p
    j = math.floor(h)
    return j, min(j + 1, n - 1), h - j


def _between(x0: float, x1: float, g: float) -> float:
    """Linear interpolation that cannot overflow and keeps equal ends."""
    return x0 if x0 == x1 or g == 0 else x0 * (1 - g) + x1 * g


def numeric_summary(df: DataFrame, cols: list[str] | None = None, approx: bool = False,
                    accuracy: int = 10000) -> DataFrame:
    """Per column: min, quartiles, mean, max and missing count for numeric
    columns; every other column (text, dates, booleans, ...) has a row with
    ``length`` (row count) and its ``kind``.

    Values are doubles, as in the reference: integers beyond 2^53 are rounded.
    Quartiles interpolate linearly between order statistics (the usual
    "type 7" definition).  ``approx=True`` uses ``percentile_approx`` (one
    pass, bounded memory, rank error about 1/accuracy) instead of the sort.
    """
    spark = df.sparkSession
    numeric = ("int", "bigint", "smallint", "tinyint", "double", "float")
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    is_num = {c: t in numeric or t.startswith("decimal") for c, t in kinds.items()}
    others = [] if cols else [c for c, v in is_num.items() if not v]
    cols = cols or [c for c, v in is_num.items() if v]
    n_rows = df.agg(F.count(F.lit(1))).scalar()
    empty = spark.createDataFrame([], "column_name string, kind string, length long, min double, q1 double, median double, "
                                      "mean double, q3 double, max double, n_missing long")
    summary = empty
    if cols:
        long = _long(df, cols)
        if not approx:  # the passes below read the numeric columns only, not the plan behind them
            path = scratch_path(spark, "numeric")
            long.write.parquet(path)
            long = spark.read.schema(long.schema).parquet(path)
        base = long.groupBy("k").agg(
            F.count(F.lit(1)).alias("n"), F.min("x").alias("mn"), F.max("x").alias("mx"), F.avg("x").alias("mean"),
            *([F.percentile_approx("x", list(PROBS), accuracy).alias("qa")] if approx else []))
        missing = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in cols])
        miss = missing.unpivot([], [F.col(f"`{c}`") for c in cols], "k", "n_missing")
        if approx:
            out = base.select("k", "mn", F.col("qa")[0].alias("q1"), F.col("qa")[1].alias("median"),
                              "mean", F.col("qa")[2].alias("q3"), "mx")
        else:
            sizes = {r["k"]: r["n"] for r in base.select("k", "n").collect()}  # a row per column
            found = order_statistics(long, {k: sorted({i for p in PROBS for i in _type7(n, p)[:2]}) for k, n in sizes.items()})
            rows = [(k, *[_between(found[(k, j0)], found[(k, j1)], g) for j0, j1, g in (_type7(n, p) for p in PROBS)])
                    for k, n in sizes.items()]
            qdf = spark.createDataFrame(rows, "k string, q1 double, median double, q3 double")
            out = base.join(qdf, "k").select("k", "mn", "q1", "median", "mean", "q3", "mx")
        summary = (out.join(miss, "k", "right")
                      .select(F.col("k").alias("column_name"), F.lit("numeric").alias("kind"),
                              n_rows.alias("length"), F.col("mn").alias("min"), "q1", "median",
                              "mean", "q3", F.col("mx").alias("max"),
                              F.col("n_missing").cast("bigint")))
    if others:
        named = [(c, "character" if kinds[c] == "string" else kinds[c]) for c in others]
        text = spark.createDataFrame(named, "column_name string, kind string").select(
            "column_name", "kind", n_rows.alias("length"),
            *[F.lit(None).cast("double").alias(c) for c in ("min", "q1", "median", "mean", "q3", "max")],
            F.lit(None).cast("bigint").alias("n_missing"))
        summary = summary.unionByName(text)
    return summary
