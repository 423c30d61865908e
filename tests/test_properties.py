"""Invariants of the cohort tables on the sf0.01 test data."""
import pytest
from pyspark.sql import functions as F

from retentio.operators import cohort as co
from retentio.operators import retention as rt
from retentio.plans.common import cleaned
from tests.conftest import SF_MID


@pytest.fixture(scope="module")
def tables(spark):
    df = cleaned(spark, SF_MID).cache()
    cohort = co.customer_cohort(df).cache()
    act = co.cohort_activity(df, cohort=cohort).cache()
    counts = co.cohort_counts(cohort).cache()
    yield df, cohort, act, counts
    for t in (df, cohort, act, counts):
        t.unpersist()


def test_stage_row_counts(spark, tables):
    from retentio.operators import clean as cl
    from retentio.plans.common import after_missing, raw_orders
    assert raw_orders(spark, SF_MID).count() == 15000
    assert after_missing(spark, SF_MID).count() == 14977
    df = tables[0]
    assert df.count() == 14965
    assert tables[1].count() == 1501
    assert co.customer_activity(df, cohort=tables[1]).count() == 14046
    assert cl.missing_columns(df.drop("shops_id", "payment_method")).count() == 0


@pytest.mark.parametrize("by", [[], ["has_promo_value"], ["promo_value"], ["source"]])
def test_period_one_is_full_and_rates_in_range(tables, by):
    _, _, act, counts = tables
    ret = rt.retention(act, counts, by)
    assert ret.filter("cohort_period = 1 AND retention_rate != 1.0").count() == 0
    assert ret.filter("retention_rate <= 0 OR retention_rate > 1 OR retention_rate IS NULL").count() == 0
    assert ret.filter("cohort_period < 1").count() == 0


def test_slices_sum_to_total(tables):
    _, cohort, act, counts = tables
    total = rt.cohort_active(act).select("order_month", "cohort_id", "active_customers")
    for by in (["has_promo_value"], ["promo_value"], ["source"]):
        s = (rt.cohort_active(act, by).groupBy("order_month", "cohort_id")
             .agg(F.sum("active_customers").alias("s")))
        assert total.join(s, ["order_month", "cohort_id"]).filter("s != active_customers").count() == 0
    assert counts.agg(F.sum("cohort_count")).first()[0] == cohort.count()


def test_newest_band_is_month_total(tables):
    _, _, act, _ = tables
    by_month = rt.activity_by(act, None)
    bands = rt.stacked_bands(by_month)
    top = bands.groupBy("order_month").agg(F.max("band_upper").alias("top"))
    tot = by_month.groupBy("order_month").agg(F.sum("active_customers").alias("tot"))
    assert top.join(tot, "order_month").filter("top != tot").count() == 0


def test_first_ties_counts_equal_distinct_customers(tables):
    df = tables[0]
    cohort = co.customer_cohort(df, ties="first")
    n = df.select("customer").distinct().count()
    assert co.cohort_counts(cohort).agg(F.sum("cohort_count")).first()[0] == n


def test_matrix_round_trip(tables):
    _, _, act, counts = tables
    ret = rt.retention(act, counts)
    periods = rt.matrix_periods(tables[0])
    m = rt.retention_matrix(ret, periods)
    back = rt.matrix_to_long(m, periods)
    a = ret.select("cohort_id", "cohort_period", "retention_rate")
    b = back.select("cohort_id", "cohort_period", "retention_rate")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
