"""Values that hold more than a share 1/k of a column, found exactly.

Every task keeps 2 k counters a column (Misra and Gries): batches are counted
and merged into them, and what does not fit is paid off against all alike, so
a counter is below the true count by at most rows / (2 k + 1).  The counters
of all tasks are added by value in a shuffle of at most tasks x columns x 2 k
rows.  A value with more than n / k of n rows then has more than n / (2 k + 1)
left, which at most 2 k values can have; a second pass counts these exactly.
Memory and traffic do not depend on the number of different values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SCHEMA = "column_name string, value string, counter long, rows long"


class Counters:
    """At most ``size`` values with lower bounds of their counts."""

    def __init__(self, size: int):
        self.size, self.rows = size, 0
        self.held: dict[str, int] = {}

    def add(self, values: list[str], counts: list[int]) -> None:
        self.rows += sum(counts)
        for v, n in zip(values, counts):
            self.held[v] = self.held.get(v, 0) + n
        if len(self.held) > self.size:
            n = np.fromiter(self.held.values(), np.int64, len(self.held))
            paid = int(np.partition(n, len(n) - self.size - 1)[len(n) - self.size - 1])  # the largest that has no place
            self.held = {v: c - paid for v, c in self.held.items() if c > paid}


def _count(columns: list[str], size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = {c: Counters(size) for c in columns}
        for batch in batches:
            for k, c in enumerate(columns):
                found = pc.value_counts(batch.column(k).drop_null())
                counters[c].add(found.field("values").to_pylist(), found.field("counts").to_pylist())
        rows = [(c, v, n, 0) for c, m in counters.items() for v, n in m.held.items()] + [(c, None, 0, m.rows) for c, m in counters.items()]
        names, values, n, total = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.string()), pa.array(n, pa.int64()), pa.array(total, pa.int64())],
                                         ["column_name", "value", "counter", "rows"])
    return run


def candidates(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """column_name, value, of_rows: at most 2 k values a column, all that can hold more than 1/k."""
    if k < 1:
        raise ValueError("k must be at least 1")
    cells = df.select(*[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(columns)])
    counters = cells.mapInArrow(_count(list(columns), 2 * k), _SCHEMA)
    per = counters.groupBy("column_name", "value").agg(F.sum("counter").alias("counter"), F.sum("rows").alias("rows"))
    total = per.filter(F.col("value").isNull()).select(F.col("column_name").alias("__c"), F.col("rows").alias("of_rows"))
    return per.filter(F.col("value").isNotNull()).join(total, F.col("column_name") == F.col("__c")) \
              .filter(F.col("counter") * (2 * k + 1) >= F.col("of_rows")).select("column_name", "value", "of_rows")


def heavy_hitters(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """column_name, value, n and share of every value that holds more than 1/k
    of the column's values.  Values are compared as text; NULL is none."""
    cells = F.array(*[F.struct(F.lit(c).alias("__c"), F.col(f"`{c}`").cast("string").alias("__v")) for c in columns])
    found = F.broadcast(candidates(df, columns, k))  # at most 2 k rows a column
    rows = df.select(F.inline(cells)).join(found, (F.col("__c") == F.col("column_name")) & (F.col("__v") == F.col("value")))
    return rows.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"), F.max("of_rows").alias("__rows")) \
               .filter(F.col("n") * k > F.col("__rows")).select("column_name", "value", "n", (F.col("n") / F.col("__rows")).alias("share"))
