"""Key sets as bitmaps: linked filters whose sets are stored, united and
intersected a bucket at a time.

A key (a whole number) belongs to one bucket of 32,768 neighbouring keys and
has one bit in it, so a set is a table (bucket, bits) with at most 4 KB for
that many keys.  Unions and intersections are aggregates per bucket with a
partial step; a large table is joined by bucket number and tests one bit a
row, so what moves is buckets, not keys.  Sets per group are a table that can
be written once and serve every later choice of groups.

A NULL key is in no set.  The join is left to the planner: a set under its
broadcast threshold is sent to the rows, a larger one is shuffled by bucket.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORDS = 512  # words of 64 bits in a bucket


def group_bitmaps(df: DataFrame, group: str | list[str] | None, key: str) -> DataFrame:
    """(group columns, bucket, bits) of the keys of every group."""
    groups = [group] if isinstance(group, str) else list(group or [])
    k = F.col(key).cast("bigint")
    return (df.filter(k.isNotNull())
              .groupBy(*groups, F.bitmap_bucket_number(k).alias("bucket"))
              .agg(F.bitmap_construct_agg(F.bitmap_bit_position(k)).alias("bits")))


def key_bitmap(keys: DataFrame, key: str | None = None) -> DataFrame:
    """(bucket, bits) of a one-column table of keys."""
    return group_bitmaps(keys, None, key or keys.columns[0])


def union_of(bitmaps: DataFrame, group: str, chosen) -> DataFrame | None:
    """The keys of any chosen group; None (an inactive filter) for an empty choice."""
    chosen = list(chosen)
    if not chosen:
        return None
    return bitmaps.filter(F.col(group).isin(chosen)).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def intersection_of(sets: list[DataFrame | None]) -> DataFrame | None:
    """The keys that every active set holds; None where no set is active.  A
    bucket that one set lacks is empty in the result and has no row."""
    active = [s.select("bucket", "bits") for s in sets if s is not None]
    if not active:
        return None
    if len(active) == 1:
        return active[0]
    both = reduce(lambda a, b: a.unionByName(b), active).groupBy("bucket") \
        .agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("__n"))
    return both.filter((F.col("__n") == len(active)) & (F.bitmap_count("bits") > 0)).select("bucket", "bits")


def key_count(bitmaps: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Distinct keys per group (or in all), from the bitmaps alone."""
    return bitmaps.groupBy(*(by or [])).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).cast("bigint").alias("keys"))


def _has_bit(bits: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (position % 8).cast("int")) == 1


def linked_filter_bitmaps(df: DataFrame, key: str, sets: list[DataFrame | None]) -> DataFrame:
    """Rows whose key is in every active set (None: an inactive filter, which
    removes nothing; an active empty set removes every row)."""
    held = intersection_of(sets)
    if held is None:
        return df
    k = F.col(key).cast("bigint")
    held = held.select(F.col("bucket").alias("__bucket"), F.col("bits").alias("__bits"))
    joined = df.join(held, F.bitmap_bucket_number(k) == F.col("__bucket"))
    return joined.filter(_has_bit(F.col("__bits"), F.bitmap_bit_position(k))).select(*[F.col(f"`{c}`") for c in df.columns])


# -- back to keys ---------------------------------------------------------------
def _words(bits: Column) -> Column:
    """The bucket's bits as 512 whole numbers (first byte highest)."""
    return F.transform(F.sequence(F.lit(0), F.lit(_WORDS - 1)), lambda i: F.conv(F.hex(F.substring(bits, 8 * i + 1, F.lit(8))), 16, -10).cast("bigint"))


def _key(bucket: Column, position: Column) -> Column:
    """The key of a bit: buckets from 1 hold positive keys, the others the rest."""
    return F.when(bucket > 0, (bucket - 1) * 32768 + position + 1).otherwise(bucket * 32768 - position)


def _exploded(rows: DataFrame, words: Column, keep: list[str], key: str) -> DataFrame:
    """A row for every set bit of ``words``; words without one leave no row."""
    held = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda s: s["w"] != 0)
    each = rows.select("bucket", *keep, F.explode(held).alias("__word"))
    # byte j of a word holds bits 8 j to 8 j + 7 and stands 7 - j bytes from its low end
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda p: F.getbit(F.col("__word.w"), (F.lit(7) - F.floor(p / 8).cast("int")) * 8 + p % 8) == 1)
    return each.select(*keep, "bucket", F.explode(F.transform(bits, lambda p: F.col("__word.i") * 64 + p)).alias("__position")) \
               .select(_key(F.col("bucket"), F.col("__position")).cast("bigint").alias(key), *keep)


def keys_of(bitmaps: DataFrame, key: str, by: list[str] | None = None) -> DataFrame:
    """One row for each key of a set (or of every group's set)."""
    return _exploded(bitmaps.withColumn("__words", _words(F.col("bits"))), F.col("__words"), list(by or []), key)


def keyset_diff_bitmaps(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys added and removed between two versions of a set, as (key, change):
    only buckets whose bits differ are unpacked."""
    pair = old.select("bucket", F.col("bits").alias("__old")).join(new.select(F.col("bucket").alias("__b"), F.col("bits").alias("__new")),
                                                                   F.col("bucket") == F.col("__b"), "full_outer")
    changed = pair.filter(~F.col("__old").eqNullSafe(F.col("__new"))).withColumn("bucket", F.coalesce("bucket", "__b"))
    none = F.array_repeat(F.lit(0).cast("bigint"), _WORDS)
    sides = changed.select("bucket", *[F.when(F.col(c).isNull(), none).otherwise(_words(F.col(c))).alias(n) for c, n in (("__old", "__o"), ("__new", "__n"))])
    each = F.array(*[F.struct(F.lit(name).alias("change"), F.zip_with(a, b, lambda x, y: x.bitwiseAND(F.bitwise_not(y))).alias("words"))
                     for name, a, b in (("added", "__n", "__o"), ("removed", "__o", "__n"))])
    return _exploded(sides.select("bucket", F.inline(each)), F.col("words"), ["change"], key).select(key, "change")
