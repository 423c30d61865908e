"""Heavy values against full counts; indexed search against the scan."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from retentio.operators import heavy as hv
from retentio.operators import postings as po
from retentio.operators import table_ops as tb
from retentio.session import scratch_path


@pytest.mark.parametrize("k", [1, 2, 10, 50])
def test_every_heavy_value_of_a_million_is_found(spark, k):
    df = spark.range(1_000_000, numPartitions=8).select(
        F.when(F.col("id") % 9 == 0, "hot").when(F.col("id") % 40 == 1, "warm").when(F.col("id") % 1000 < 3, None).otherwise(F.col("id").cast("string")).alias("a"),
        F.when(F.col("id") < 30_000, "early").otherwise(F.xxhash64("id").cast("string")).alias("b"))
    assert df.select("a").distinct().count() > 800_000
    got = {(r.column_name, r.value): r.n for r in hv.heavy_hitters(df, ["a", "b"], k).collect()}
    want = {}
    for c in ("a", "b"):
        n = df.filter(F.col(c).isNotNull()).count()
        want |= {(c, r[c]): r.n for r in df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n")).filter(F.col("n") * k > n).collect()}
    assert got == want
    assert hv.candidates(df, ["a", "b"], k).groupBy("column_name").count().agg(F.max("count")).head()[0] in {None, *range(2 * k + 1)}


def test_counters_are_lower_bounds():
    rnd = random.Random(1)
    c, true = hv.Counters(6), {}
    for _ in range(200):
        some = {f"v{int(rnd.expovariate(0.2))}": rnd.randint(1, 9) for _ in range(rnd.randint(1, 12))}
        c.add(list(some), list(some.values()))
        for v, n in some.items():
            true[v] = true.get(v, 0) + n
    assert len(c.held) <= 6 and c.rows == sum(true.values())
    assert all(c.held.get(v, 0) <= n <= c.held.get(v, 0) + c.rows / 7 for v, n in true.items())


def test_nothing_heavy_and_empty_tables(spark):
    df = spark.createDataFrame([(str(k), None) for k in range(50)], "a string, b string")
    assert hv.heavy_hitters(df, ["a", "b"], 10).collect() == []
    assert hv.heavy_hitters(df.limit(0), ["a"], 10).collect() == []
    with pytest.raises(ValueError):
        hv.candidates(df, ["a"], 0)


WORDS = ["credit", "Card", "CASH", "ÉTÉ", "İstanbul", "straße", "🙂🙂🙂", "aaaa", "ab", "x", "pay-pal", "aa"]


def test_search_equals_the_scan(spark):
    rnd = random.Random(7)
    rows = [(k if k % 17 else None, None if k % 23 == 0 else " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, 5)))) for k in range(400)]
    df = spark.createDataFrame(rows, "id long, t string")
    path = scratch_path(spark, "postings")
    po.write_postings(df, "id", "t", path)
    for query in ["credit", "CRED card", "aaa aaaa", "été", "straße cash", "🙂🙂🙂", "x", "", "ab x", "nothing", "istan", "pay-pal x", "d c", "ash aa"]:
        got, want = ([(r.id or -1, r.t or "") for r in t.collect()] for t in (po.search_postings(df, "id", "t", query, path), tb.search_text(df, "t", query)))
        assert sorted(got) == sorted(want), query


def test_only_matching_postings_are_read(spark):
    df = spark.range(2000).select("id", F.concat(F.lit("value "), F.col("id")).alias("t"))
    path = scratch_path(spark, "postings")
    po.write_postings(df, "id", "t", path)
    keys = po.matching_keys(spark, path, "199")
    plan = keys._jdf.queryExecution().executedPlan().toString()
    assert "folder" in plan.split("PartitionFilters")[1][:120] and "gram" in plan.split("PushedFilters")[1][:120]
    assert {r[0] for r in keys.collect()} == {199, 1199, *range(1990, 2000)}
    assert po.matching_keys(spark, path, "a b") is None


def test_a_value_is_taken_apart_once(spark):
    df = spark.range(3000).select((F.col("id") % 2900).alias("id"), F.concat(F.lit("Value "), F.col("id") % 3).alias("t"))
    path = scratch_path(spark, "postings")
    po.write_postings(df, "id", "t", path)
    grams = spark.read.parquet(f"{path}/grams")
    assert grams.count() == 3 * 5 and grams.filter("gram = 'val'").count() == 3
    keys = [r[0] for r in po.matching_keys(spark, path, "VALUE").collect()]
    assert sorted(keys) == list(range(2900))  # a key once, however many of its rows match
    got = sorted(r.id for r in po.search_postings(df, "id", "t", "lue 1", path).collect())
    assert got == sorted(k % 2900 for k in range(1, 3000, 3))


def test_values_of_one_hash_lose_no_row(spark, monkeypatch):
    df = spark.createDataFrame([(1, "abcd"), (2, "abce"), (3, "xyz"), (4, "xbcd")], "id long, t string")
    path = scratch_path(spark, "postings")
    real = po.F.xxhash64
    monkeypatch.setattr(po.F, "xxhash64", lambda c: real(F.substring(c, 1, 1)) if isinstance(c, str) else real(c))
    po.write_postings(df, "id", "t", path)
    monkeypatch.undo()
    for query in ("abc", "bcd", "abce", "abcd bce", "xyz", "yzx", "bc"):
        got, want = (sorted(r.id for r in t.collect()) for t in (po.search_postings(df, "id", "t", query, path), tb.search_text(df, "t", query)))
        assert got == want, query
