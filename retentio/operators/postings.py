"""Text search by a written index: three letters -> value -> row key.

A value that holds a word holds each three letters of it in a row, so a
search reads the postings of the query's trigrams only, keeps the values that
have all of them, looks up their keys and verifies the words on those rows.

A value is taken apart once, however many rows hold it: the postings are
(gram, value) pairs of the distinct values, and a second table lists the keys
of each value.  So a column of few values costs one flat row for each of its
rows, not one for each trigram of each row.  A value goes by a hash; values of
one hash share their keys, which the verification tells apart.  Neither table
holds a list: what all rows have is many rows.  Files are split by a hash and
sorted, so folders and row groups without the wanted entries are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio.operators.table_ops import search_text
from retentio.session import scratch_path

#: Folders of the index.
FOLDERS = 64


def _folder(entry):
    return F.pmod(F.xxhash64(entry), F.lit(FOLDERS)).cast("int")


def _write_sorted(rows: DataFrame, by: str, path: str) -> None:
    """Folders by a hash of ``by``; the hint lets a heavy entry take several files."""
    (rows.withColumn("folder", _folder(F.col(by))).hint("rebalance", "folder").sortWithinPartitions("folder", by)
         .write.mode("overwrite").partitionBy("folder").parquet(path))


def write_postings(df: DataFrame, key: str, col: str, path: str) -> None:
    """The index of a text column: ``grams``, the distinct (gram, value) of all
    lower-cased values, and ``keys``, the (value, key) of all rows.  Values
    under three characters have no gram and are left out."""
    text = F.lower(F.col(col).cast("string"))
    rows = df.select(F.col(key).alias("key"), text.alias("text")).filter(F.length("text") >= 3)
    staged = scratch_path(df.sparkSession, "values")
    rows.withColumn("value", F.xxhash64("text")).write.parquet(staged)
    rows = df.sparkSession.read.parquet(staged)
    _write_sorted(rows.select("value", "key"), "value", f"{path}/keys")
    chars = rows.select("value", "text").distinct().select("value", F.split("text", "").alias("c"))
    each = F.transform(F.sequence(F.lit(0), F.size("c") - 3), lambda i: F.concat(F.get("c", i), F.get("c", i + 1), F.get("c", i + 2)))
    _write_sorted(chars.select("value", F.explode(F.array_distinct(each)).alias("gram")), "gram", f"{path}/grams")


def grams_of(query: str) -> list[str]:
    """The trigrams of the query's words, in lower case."""
    return sorted({w[i:i + 3] for w in query.lower().split() for i in range(len(w) - 2)})


def matching_keys(spark: SparkSession, path: str, query: str) -> DataFrame | None:
    """Keys that have every trigram of the query; None if it has none (all
    words under three characters), when the index cannot narrow the search."""
    grams = grams_of(query)
    if not grams:
        return None
    where = spark.createDataFrame([(g,) for g in grams], "gram string").select(_folder(F.col("gram"))).distinct().collect()
    postings = spark.read.parquet(f"{path}/grams")
    hits = postings.filter(F.col("folder").isin([r[0] for r in where]) & F.col("gram").isin(grams))
    values = hits.groupBy("value").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(grams)).select("value")
    keys = spark.read.parquet(f"{path}/keys")
    return values.withColumn("folder", _folder(F.col("value"))).join(keys, ["folder", "value"]).select("key").distinct()


def search_postings(df: DataFrame, key: str, col: str, query: str, path: str) -> DataFrame:
    """The rows of ``search_text(df, col, query)``, found through the index of
    the column.  A query without a word of three characters scans the column."""
    keys = matching_keys(df.sparkSession, path, query)
    if keys is not None:
        keys = keys.select(F.col("key").alias("__key"))
        df = df.join(keys, F.col(key).eqNullSafe(F.col("__key")), "left_semi")
    return search_text(df, col, query)
