"""Text labels for retention cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent_label(rate: str | Column, na_label: str | None = None) -> Column:
    """Whole-percent label such as ``'38%'``.

    Rounds half to even like C ``printf('%.0f')`` (12.5 -> ``'12%'``), which
    Spark's ``format_string`` (half up) would not.  ``na_label`` replaces the
    label of a NULL rate.
    """
    r = F.col(rate) if isinstance(rate, str) else rate
    label = F.concat(F.bround(r * 100, 0).cast("bigint").cast("string"), F.lit("%"))
    if na_label is not None:
        label = F.coalesce(label, F.lit(na_label))
    return label
