"""Row filters, paging and linked key-set filters of an interactive table,
as DataFrame operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


# -- H1 -----------------------------------------------------------------------
def filter_range(df: DataFrame, col: str, lo=None, hi=None, full_range_off: bool = True,
                 full_range: tuple | None = None) -> DataFrame:
    """``lo <= col <= hi`` inclusive; NULL and NaN never pass.  A missing bound
    is open.  A filter whose bounds cover the column's whole [min, max] is
    off, as a range slider left at its ends is: every row stays, missing
    values included.

    Give ``full_range``, the slider's ends, where they are known: the result
    is then a plain range over one scan.  Otherwise the column's ends are a
    scalar subquery of the returned plan (no job runs before it does): rows
    in range come from a scan with the bounds pushed down, and rows with a
    missing value, which alone can be in question, from one of their own.
    """
    if lo is None and hi is None:
        return df
    c = F.col(col)
    missing = c.isNull()
    if isinstance(df.schema[col].dataType, (T.FloatType, T.DoubleType)):
        missing = missing | F.isnan(c)
    bounds = [c >= F.lit(lo)] * (lo is not None) + [c <= F.lit(hi)] * (hi is not None)
    inside = df.filter(reduce(lambda a, b: a & b, bounds, ~missing))
    if not full_range_off:
        return inside
    if full_range is not None:
        covers = (lo is None or lo <= full_range[0]) and (hi is None or hi >= full_range[1])
        return df if covers else inside
    ends = [F.min(c) >= F.lit(lo)] * (lo is not None) + [F.max(c) <= F.lit(hi)] * (hi is not None)
    off = df.filter(~missing).agg(reduce(lambda a, b: a & b, ends).alias("off")).scalar()
    return inside.unionAll(df.filter(missing & F.coalesce(off, F.lit(False))))


# -- H2 -----------------------------------------------------------------------
def filter_set(df: DataFrame, col: str, values) -> DataFrame:
    """Rows whose value is among ``values``; an empty choice keeps every row."""
    values = list(values or [])
    if not values:
        return df
    return df.filter(F.col(col).isin(values))


# -- H3 -----------------------------------------------------------------------
def filter_logical(df: DataFrame, col: str, choices) -> DataFrame:
    """Rows whose boolean is among the chosen of ``{'true', 'false', 'na'}``."""
    choices = [str(c).lower() for c in (choices or [])]
    if not choices:
        return df
    txt = F.coalesce(F.lower(F.col(col).cast("string")), F.lit("na"))
    return df.filter(txt.isin(choices))


# -- H4 -----------------------------------------------------------------------
def search_text(df: DataFrame, col: str, query: str, regex: bool = False,
                case_insensitive: bool = True) -> DataFrame:
    """Column search.  ``regex=True``: the query is a regular expression.
    Otherwise "smart" search: every whitespace-separated word of the query
    must occur in the value.  Case-insensitive by default."""
    c = F.col(col).cast("string")
    if regex:
        pat = ("(?i)" if case_insensitive else "") + query
        return df.filter(c.rlike(pat))
    words = [w for w in query.split() if w]
    if not words:
        return df
    hay = F.lower(c) if case_insensitive else c
    conds = [F.contains(hay, F.lit(w.lower() if case_insensitive else w)) for w in words]
    return df.filter(reduce(lambda a, b: a & b, conds))


# -- H5 -----------------------------------------------------------------------
def page(df: DataFrame, keys: list[str], k: int, n: int) -> DataFrame:
    """Page ``k`` (0-based) of length ``n`` under the order of ``keys``.

    Planned as a top-(k+1)n per partition, so only those rows are ever moved.
    """
    return (df.orderBy(*[F.col(c).asc_nulls_last() for c in keys])
              .offset(k * n).limit(n))


def page_after(df: DataFrame, keys: list[str], last: tuple | None, n: int) -> DataFrame:
    """The ``n`` rows behind the key ``last`` (None: the first page).

    For deep pages: the keys of the last row seen take the place of an offset,
    so a page costs a filtered top-n however far behind it lies.  The keys
    must identify a row; NULL keys sort last, as in ``page``.
    """
    if last is not None:
        behind = F.lit(False)
        for k, value in reversed(list(zip(keys, last))):
            c = F.col(k)
            if value is None:  # nothing sorts behind NULL
                behind = c.isNull() & behind
            else:
                behind = c.isNull() | (c > F.lit(value)) | ((c == F.lit(value)) & behind)
        df = df.filter(behind)
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in keys]).limit(n)


# -- H6 -----------------------------------------------------------------------
def keys_by_group(df: DataFrame, group: str, key: str, chosen) -> DataFrame | None:
    """Union of the row keys of the chosen groups; None (an inactive filter)
    for an empty choice."""
    if not list(chosen):
        return None
    return df.filter(F.col(group).isin(list(chosen))).select(key).distinct()


# -- H7 -----------------------------------------------------------------------
def linked_filter(df: DataFrame, key: str, key_sets) -> DataFrame:
    """Rows whose key is in every active key set.

    ``key_sets`` holds one-column DataFrames of keys, or ``None`` for an
    inactive filter (removes nothing).  An active empty set removes every
    row.  The key sets are intersected among themselves first (each made
    distinct, tagged, and grouped by key: a key survives when all k sets hold
    it), so the large table takes a single left-semi join - broadcast when
    the surviving keys are few, a shuffle join otherwise - instead of k.
    """
    active = [ks for ks in key_sets if ks is not None]
    if not active:
        return df
    tagged = [ks.select(F.col(ks.columns[0]).alias("__key")).distinct() for ks in active]
    if len(tagged) == 1:
        keys = tagged[0]
    else:
        keys = (reduce(lambda a, b: a.unionByName(b), tagged)
                .groupBy("__key").agg(F.count(F.lit(1)).alias("__n"))
                .filter(F.col("__n") == len(tagged)).select("__key"))
    return df.join(keys, F.col(key) == F.col("__key"), "left_semi")


# -- H8 -----------------------------------------------------------------------
def columns_to_rows(df: DataFrame, cols: list[str], keep: list[str] | None = None) -> DataFrame:
    """Column-major arrays -> one row per position.  Arrays of one row must
    have equal lengths; unequal lengths fail the query."""
    keep = list(keep or [])
    sizes = [F.size(c) for c in cols]
    same = reduce(lambda a, b: a & b, [s == sizes[0] for s in sizes[1:]], F.lit(True))
    zipped = F.arrays_zip(*[F.col(c) for c in cols])
    guarded = F.when(same, zipped).otherwise(F.raise_error(F.lit("columns_to_rows: unequal lengths")))
    return df.select(*keep, F.inline(guarded)).select(*keep, *cols)


# -- H9 -----------------------------------------------------------------------
def keyset_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys added and removed between two versions of a key set:
    rows ``(key, change)`` with ``change`` in {'added', 'removed'}.

    One full outer join of the two distinct key sets (one shuffle per side)
    gives both directions at once; a NULL key never matches, so it shows up
    on its own side, as an anti join would report it.
    """
    o = old.select(F.col(key).alias("__ko")).distinct().withColumn("__in_old", F.lit(True))
    n = new.select(F.col(key).alias("__kn")).distinct().withColumn("__in_new", F.lit(True))
    j = o.join(n, F.col("__ko") == F.col("__kn"), "full_outer")
    changed = j.filter(F.col("__in_old").isNull() | F.col("__in_new").isNull())
    return changed.select(
        F.coalesce(F.col("__kn"), F.col("__ko")).alias(key),
        F.when(F.col("__in_old").isNull(), F.lit("added")).otherwise(F.lit("removed")).alias("change"))
