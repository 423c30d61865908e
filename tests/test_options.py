"""Option paths of the public operators."""
import pytest
from pyspark.sql import functions as F

from retentio.operators import cohort as co
from retentio.operators import eda
from retentio.operators import retention as rt
from retentio.operators.quantiles import numeric_summary
from retentio.plans.common import cleaned, cleaned_events
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def df(spark):
    return cleaned(spark, SF_SMALL).cache()


def test_approx_distinct_close(df):
    exact = eda.n_customers(df).first().n_customers
    approx = eda.n_customers(df, approx=True).first().n_customers
    assert abs(approx - exact) <= 0.05 * exact


def test_numeric_summary_approx_close(df):
    ex = {r.column_name: r for r in numeric_summary(df, ["restaurant_total", "customer"]).collect()}
    ap = {r.column_name: r for r in numeric_summary(df, ["restaurant_total", "customer"], approx=True).collect()}
    for c in ex:
        assert ex[c].min == ap[c].min and ex[c].max == ap[c].max
        span = ex[c].max - ex[c].min
        for q in ("q1", "median", "q3"):
            assert abs(getattr(ex[c], q) - getattr(ap[c], q)) <= 0.01 * span


def test_sliced_matrix(df):
    act, counts = co.cohort_tables(df)
    ret = rt.retention(act, counts, ["has_promo_value"])
    m = rt.retention_matrix(ret, list(range(1, 80)), ["has_promo_value"])
    assert m.columns[:2] == ["cohort_id", "has_promo_value"] and len(m.columns) == 81
    assert m.filter(F.col("p1") != 1.0).count() == 0
    back = rt.matrix_to_long(m, list(range(1, 80)), ["has_promo_value"])
    assert back.count() == ret.count()


def test_first_ties_in_cohort_tables(df):
    act_all, counts_all = co.cohort_tables(df)
    act_first, counts_first = co.cohort_tables(df, ties="first")
    total_first = counts_first.agg(F.sum("cohort_count")).first()[0]
    assert total_first == df.select("customer").distinct().count()
    assert counts_all.agg(F.sum("cohort_count")).first()[0] >= total_first
    assert act_first.agg(F.sum("active_customers")).first()[0] == \
        df.select("customer", "order_month").distinct().count()


def test_retention_by_hour_on_events(spark):
    ev = cleaned_events(spark, SF_SMALL).withColumn(
        "hour", F.substring("date_purchased", 12, 2).try_cast("int"))
    ret = rt.retention_by(ev, "hour")
    hours = {r.hour for r in ret.select("hour").distinct().collect()}
    assert hours <= set(range(24)) and len(hours) > 1
    assert ret.filter("cohort_period = 1 AND retention_rate != 1.0").count() == 0


def test_acquisition_growth_running_total(df):
    _, counts = co.cohort_tables(df)
    g = rt.acquisition_growth(counts).orderBy("cohort_id").collect()
    assert g[0].prev_count is None and g[0].growth_rate is None
    assert g[-1].customers_to_date == sum(r.cohort_count for r in g)


def test_retention_report_equals_single_slices(df):
    from tests.helpers import rows
    report = rt.retention_report(df, [[], ["has_promo_value"], ["promo_value"]])
    try:
        act, counts = co.cohort_tables(df)
        for by in ([], ["has_promo_value"], ["promo_value"]):
            assert rows(report[by]) == rows(rt.retention(act, counts, by))
    finally:
        report.unpersist()
