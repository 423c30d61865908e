"""Missing-value semantics of the reference, as Spark Columns.

The reference treats a value as missing when it is NA, NaN or an empty
string, and its ``sum`` / ``min`` return NA as soon as one input is NA.
Spark's defaults differ (only NULL is missing; aggregates skip NULL), so the
operators use these helpers wherever that difference can show.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_missing(col: str | Column, dtype: T.DataType | None = None) -> Column:
    """NULL, NaN (floating columns) or the empty string (text columns)."""
    c = F.col(col) if isinstance(col, str) else col
    cond = c.isNull()
    # NULL | x is never NULL here, and "= ''" (unlike a length test) reaches the scan
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        cond = cond | F.isnan(c)
    elif isinstance(dtype, T.StringType):
        cond = cond | (c == "")
    return cond


def missing_in(df: DataFrame, col: str) -> Column:
    """``is_missing`` using the column's type in ``df``."""
    return is_missing(col, df.schema[col].dataType)


def na_sum(col: str | Column) -> Column:
    """Sum that is NULL if any input is NULL (R ``sum`` without ``na.rm``)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def na_min(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.when(F.count(c) == F.count(F.lit(1)), F.min(c))


def na_max(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.when(F.count(c) == F.count(F.lit(1)), F.max(c))

