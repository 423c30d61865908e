"""Queries that used to run a job while their plan was built."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from retentio.operators import eda
from retentio.operators import retention as rt
from retentio.operators import table_ops as tb
from tests.conftest import SF_SMALL


def _jobs(spark, group, build):
    spark.sparkContext.setJobGroup(group, group)
    try:
        df = build()
        return df, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setJobGroup("", "")


@pytest.mark.parametrize("name", ["retention_matrix", "filter_range", "filter_range_unknown_ends", "order_buckets_cumulative", "churn"])
def test_no_job_before_the_result_is_asked_for(spark, name):
    entry.queries()["clean_orders"](spark, SF_SMALL)  # file listing jobs belong to the reader
    df, n = _jobs(spark, f"plan-{name}", lambda: entry.queries()[name](spark, SF_SMALL))
    base, m = _jobs(spark, f"base-{name}", lambda: entry.queries()["clean_orders"](spark, SF_SMALL))
    assert n == m  # what reading the tables takes
    assert df.columns and base.columns


def test_periods_between_known_months():
    assert rt.periods_between("1995-01-01", "2001-08-01") == list(range(1, 80))
    assert rt.periods_between("2020-03-01", "2020-03-15") == [1]
    assert rt.periods_between("2020-03-01", "2020-03-01") == []


@pytest.mark.parametrize("lo,hi,kept", [(1.0, 5.0, 5), (0.0, None, 5), (None, 5.0, 5), (1.5, 5.0, 1), (None, 4.9, 2), (6.0, None, 0)])
def test_unknown_ends_decide_in_the_plan(spark, lo, hi, kept):
    df = spark.createDataFrame([(1.0,), (2.0 - 0.5,), (5.0,), (float("nan"),), (None,)], "x double").filter("x is null or x <> 1.5 or isnan(x)") \
              .unionAll(spark.createDataFrame([(1.2,)], "x double"))
    assert tb.filter_range(df, "x", lo, hi).count() == kept


def test_a_column_of_missing_values_only(spark):
    df = spark.createDataFrame([(None,), (None,)], "x int")
    assert tb.filter_range(df, "x", 1, 5).count() == 0


def test_buckets_with_a_null_customer(spark):
    df = spark.createDataFrame([(1, 7), (2, 7), (3, 8), (4, None)], "order_id long, customer long")
    got = {r.num_orders: tuple(r) for r in eda.order_buckets_cumulative(df).collect()}
    assert got == {1: (1, 2, 1.0, 2, 1.0, 0.0), 2: (2, 1, 0.5, 3, 1.5, -0.5)}
    plan = eda.order_buckets_cumulative(df)._jdf.queryExecution().executedPlan().toString()
    assert "Subquery" not in plan and plan.count("Window") >= 1
