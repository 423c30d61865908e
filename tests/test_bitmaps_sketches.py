"""Bitmap key sets against row-wise key sets; sketches against exact figures."""

from __future__ import annotations

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from retentio.operators import bitmaps as bm
from retentio.operators import sketches as sk
from retentio.operators import table_ops as tb
from retentio.operators.clean import with_dates

EDGES = [0, 1, -1, 2, -5, 32767, 32768, 32769, -32767, -32768, -32769, 65536, 10 ** 12, -(10 ** 12)]
KEYS = st.sets(st.one_of(st.sampled_from(EDGES), st.integers(-200, 200), st.integers(-(2 ** 40), 2 ** 40)), max_size=40)


def _set(spark, keys):
    return spark.createDataFrame([(k,) for k in keys], "k long")


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(KEYS, KEYS)
def test_any_two_sets(spark, a, b):
    x, y = bm.key_bitmap(_set(spark, [*a, *a])), bm.key_bitmap(_set(spark, b))
    assert sorted(r.k for r in bm.keys_of(x, "k").collect()) == sorted(a)
    assert bm.key_count(x).head()[0] == len(a)
    assert sorted(r.k for r in bm.keys_of(bm.intersection_of([x, None, y]), "k").collect()) == sorted(a & b)
    got = {(r.k, r.change) for r in bm.keyset_diff_bitmaps(x, y, "k").collect()}
    assert got == {(k, "removed") for k in a - b} | {(k, "added") for k in b - a}
    rows = spark.createDataFrame([(k, str(k)) for k in [*sorted(a | b), *EDGES, None]], "k long, __old string")
    kept = sorted((r.k, r["__old"]) for r in bm.linked_filter_bitmaps(rows, "k", [x, None, y]).collect())
    assert kept == sorted((r.k, r["__old"]) for r in tb.linked_filter(rows, "k", [_set(spark, a), None, _set(spark, b)]).collect())


def test_groups_and_inactive_filters(spark):
    df = spark.createDataFrame([("a", 1), ("a", 40000), ("b", 1), ("b", 2), (None, 9), ("a", None)], "g string, k long")
    stored = bm.group_bitmaps(df, "g", "k")
    assert {r.g: r["keys"] for r in bm.key_count(stored, ["g"]).collect()} == {"a": 2, "b": 2, None: 1}
    assert sorted(r.k for r in bm.keys_of(bm.union_of(stored, "g", ["a", "b"]), "k").collect()) == [1, 2, 40000]
    assert bm.union_of(stored, "g", []) is None
    assert bm.linked_filter_bitmaps(df, "k", [None, None]) is df
    assert bm.linked_filter_bitmaps(df, "k", [bm.union_of(stored, "g", ["none"])]).count() == 0
    assert bm.keys_of(stored.limit(0), "k").collect() == []


def test_the_large_table_meets_buckets(spark):
    rows = spark.range(1000).withColumnRenamed("id", "k")
    plan = bm.linked_filter_bitmaps(rows, "k", [bm.key_bitmap(rows)])._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in plan.splitlines() if "Join" in line)
    assert "__bucket" in join and "Python" not in plan


@pytest.fixture(scope="module")
def orders(spark):
    rnd = random.Random(4)
    data = [(k, rnd.randint(1, 6000) if k % 3 else 1, f"2020-{rnd.randint(1, 12):02d}-05T00:00:00.000Z", rnd.gauss(50, 20) if k % 50 else None) for k in range(30000)]
    return with_dates(spark.createDataFrame(data, "order_id long, customer long, date_purchased string, total double")).cache()


def test_distinct_estimates_are_within_their_error(spark, orders):
    lg_k = 9
    sketches = sk.activity_sketches(orders, lg_k).cache()
    half = {(r.customer) for r in orders.filter("order_month <= '2020-06-01'").select("customer").collect()}
    rest = {(r.customer) for r in orders.filter("order_month > '2020-06-01'").select("customer").collect()}
    got = sk.active_between(sketches, "2020-01-01", "2020-06-01", lg_k=lg_k).head()[0]
    assert 0 < abs(got - len(half)) <= 5 * sk.relative_error(lg_k) * len(half)  # an estimate, not a count
    both = sk.active_in_both(sketches, ("2020-01-01", "2020-06-01"), ("2020-07-01", "2020-12-01"), lg_k=lg_k).head()
    for value, exact in ((both["first"], half), (both.second, rest), (both.both, half & rest)):
        assert abs(value - len(exact)) <= 5 * sk.relative_error(lg_k) * len(half | rest)
    assert sk.active_in_both(sketches, ("2019-01-01", "2019-06-01"), ("2020-07-01", "2020-12-01"), lg_k=lg_k).head().both == 0


def test_small_sets_are_counted_exactly(spark, orders):
    few = orders.filter("customer < 300")
    sketches = sk.activity_sketches(few)
    for r in sk.active_between(sketches, "2020-01-01", "2020-12-01", by=["cohort_id"]).collect():
        first = few.groupBy("customer").agg(F.min("order_month").alias("c")).filter(F.col("c") == r.cohort_id).count()
        assert r.customers == first


def test_merging_in_any_order_gives_the_same(spark, orders):
    parts = [sk.activity_sketches(orders.filter(F.col("customer") % 3 == k), 8) for k in range(3)]
    one = sk.merge_activity(*parts, lg_k=8)
    two = sk.merge_activity(parts[2], sk.merge_activity(parts[1], parts[0], lg_k=8), lg_k=8)
    values = [{(r.cohort_id, r.order_month): r.e for r in t.select("cohort_id", "order_month", F.theta_sketch_estimate("customers").alias("e")).collect()} for t in (one, two)]
    assert values[0] == values[1]
    assert sk.merge_activity(*parts, *parts, lg_k=8).count() == one.count()


def test_quantiles_merged_from_months(spark, orders):
    stored = sk.quantile_sketches(orders, ["total"])
    values = sorted(r.total for r in orders.select("total").collect() if r.total is not None)
    for r in sk.merged_quantiles(stored, [0.05, 0.5, 0.95]).collect():
        assert r.n == len(values)
        rank = sum(v <= r.value for v in values) / len(values)
        assert abs(rank - r.probability) <= 0.03
    spring = stored.filter("order_month between '2020-03-01' and '2020-05-01'")
    got = sk.rank_range(orders.filter("order_month between '2020-03-01' and '2020-05-01'"), sk.merged_quantiles(spring, [0.5]), ["total"], [])
    assert abs(got.head().up_to - 0.5) <= 0.03


def test_empty_tables(spark, orders):
    none = orders.limit(0)
    assert sk.activity_sketches(none).collect() == [] and sk.quantile_sketches(none, ["total"]).collect() == []
