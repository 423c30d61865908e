"""Fixes of the second round: names in CSV files, large values, NULLs, plans, lifecycle."""
import datetime
import math

import pytest
from pyspark.sql import functions as F

from retentio.functions.dates import order_date
from retentio.operators import clean as cl
from retentio.operators import cohort as co
from retentio.operators import eda
from retentio.operators import retention as rt
from retentio.operators import stats as st
from retentio.operators import table_ops as tb
from retentio.plans.common import cleaned, lookup, raw_orders
from retentio.session import scratch_path
from retentio.sources import read_corrected, read_orders, read_zip_lookup, write_corrected
from retentio.sources.tables import TEST_CUTOFF
from retentio.streaming import CohortState
from tests.conftest import SF_SMALL
from tests.helpers import rows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# -- sources ------------------------------------------------------------------
def test_zip_lookup_by_name(spark, tmp_path):
    p = tmp_path / "zips.csv"
    p.write_text("zip,lat,lng,city,state_id\n00601,18.18,-66.75,Adjuntas,PR\n2139,42.36,-71.10,Cambridge,MA\n")
    assert rows(read_zip_lookup(spark, str(p))) == rows(spark.createDataFrame([(601, "PR"), (2139, "MA")], "zip int, state_id string"))


def test_orders_by_name_quotes_and_exponents(spark, tmp_path):
    p = tmp_path / "orders.csv"
    p.write_text('customer,note,order_id,source,date_purchased,shipping_type,payment_method,promo_value,restaurant_total,shops_id,state,postal_code\n'
                 '1.33e+10,x,1,"a ""b"" c",2019-03-13T08:02:07.000Z,Delivery,/,0,15.5,2,MD,21162\n'
                 '9007199254740993,x,2,NA,,Delivery,cash,bad,,2,,NA\n')
    got = {r.order_id: r for r in read_orders(spark, str(p)).collect()}
    assert got[1].customer == 13_300_000_000 and got[1].source == 'a "b" c' and got[1].restaurant_total == 15.5
    assert got[2].customer == 9007199254740993 and got[2].source is None and got[2].promo_value is None
    p2 = tmp_path / "short.csv"
    p2.write_text("order_id,source\n1,a\n")
    with pytest.raises(ValueError, match="no column"):
        read_orders(spark, str(p2))


def test_empty_corrected_table(spark):
    path = scratch_path(spark, "empty")
    write_corrected(cleaned(spark, SF_SMALL).limit(0), path)
    assert read_corrected(spark, path).count() == 0


# -- semantics ----------------------------------------------------------------
def test_partial_dates_are_null(spark):
    texts = ["2019", "2019-03", "2019-03-05", "2019-3-5", "2019-3-5T08:00", "2019-03-05T23:59:59.000Z", "bad", "", None, "2019-13-01"]
    d = datetime.date(2019, 3, 5)
    got = [r.d for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
           .select("k", order_date("t").alias("d")).orderBy("k").collect()]
    assert got == [None, None, d, d, d, d, None, None, None, None]


def test_date_range_propagates_missing(spark):
    df = spark.sql("select date'2020-01-02' d union all select date'2020-01-05'")
    assert tuple(cl.date_range(df, "d").head()) == (datetime.date(2020, 1, 2), datetime.date(2020, 1, 5))
    assert tuple(cl.date_range(df.unionAll(spark.sql("select cast(null as date)")), "d").head()) == (None, None)


def test_empty_choice_filters_nothing(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "g string, k long")
    assert tb.keys_by_group(df, "g", "k", []) is None
    assert tb.linked_filter(df, "k", [tb.keys_by_group(df, "g", "k", [])]).count() == 2


def test_revenue_is_not_cut(spark):
    df = spark.createDataFrame([(1, 0.004)] * 1000 + [(2, 2e10)], "shops_id long, restaurant_total double")
    assert {r.shops_id: r.rest_revenue for r in eda.revenue_by_shop(df).collect()} == {1: 4.0, 2: 2e10}


def test_every_period_is_in_the_matrix(spark):
    month = lambda k: datetime.date(2000 + (k - 1) // 12, (k - 1) % 12 + 1, 1)
    ret = spark.createDataFrame([(month(1), month(p), p, p / 200) for p in (1, 80, 120)],
                                "cohort_id date, order_month date, cohort_period long, retention_rate double")
    periods = rt.matrix_periods(ret)
    assert periods == list(range(1, 121))
    back = rt.matrix_to_long(rt.retention_matrix(ret, periods), periods)
    assert sorted((r.cohort_period, r.retention_rate) for r in back.collect()) == [(1, 0.005), (80, 0.4), (120, 0.6)]
    with pytest.raises(Exception, match="period not in the list"):
        rt.retention_matrix(ret, periods[:100]).collect()
    assert rt.matrix_periods(ret.limit(0)) == []


def test_profile_samples(spark):
    df = spark.createDataFrame([(3, "c"), (1, None), (2, "b")], "k long, t string")
    assert [r.sample for r in eda.schema_profile(df, 2).orderBy("position").collect()] == ["1 2", "NA b"]


def test_segments(spark):
    m = lambda y, k: datetime.date(y, k, 1)
    df = spark.createDataFrame([(1, m(2020, 1)), (1, m(2020, 1)), (1, m(2020, 4)), (2, m(2020, 2)), (2, None)], "customer long, order_month date")
    got = {r.customer: (r.active_months, r.last_period, r.segment) for r in rt.audience_segments(df).collect()}
    assert got == {1: (2, 4, "active"), 2: (1, 1, "lapsed")}


# -- linear fit ---------------------------------------------------------------
@pytest.mark.parametrize("shift", [0, 1_600_000_000])
def test_linear_fit_large_x_and_bigint(spark, shift):
    df = spark.range(100).selectExpr(f"id + {shift} as x", "cast(2.0002 * id + (id % 7) * 0.001 + 3 as double) as y")
    ref = {r.term: r for r in st.linear_fit(spark.range(100).selectExpr("id as x", "cast(2.0002 * id + (id % 7) * 0.001 + 3 as double) as y"), "x", "y").collect()}
    got = {r.term: r for r in st.linear_fit(df, "x", "y").collect()}
    assert got["x"].estimate == pytest.approx(ref["x"].estimate, rel=1e-9)
    assert got["x"].std_error == pytest.approx(ref["x"].std_error, rel=1e-4)


def test_linear_fit_edges(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, None), (None, 5.0), (3.0, 4.0), (float("nan"), 1.0), (4.0, 5.0), (6.0, 6.0)], "x double, y double")
    full = df.filter("x is not null and y is not null and not isnan(x)")
    assert rows(st.linear_fit(df, "x", "y")) == rows(st.linear_fit(full, "x", "y"))
    two = {r.term: r for r in st.linear_fit(spark.createDataFrame([(0.0, 1.0), (2.0, 5.0)], "x double, y double"), "x", "y").collect()}
    assert two["x"].estimate == 2.0 and two["x"].std_error is None and two["x"].p_value is None
    flat = st.linear_fit(spark.createDataFrame([(1.0, 1.0), (1.0, 5.0), (1.0, 2.0)], "x double, y double"), "x", "y").collect()
    assert all(r.estimate is None for r in flat)
    assert len(st.linear_fit(df.limit(0), "x", "y").collect()) == 2


def test_p_values(spark):
    cases = [(0.5, 1.0), (2.0, 1.0), (2.0, 10.0), (9.464, 48.0), (0.0, 5.0), (1.96, 1e6)]
    got = spark.createDataFrame(cases, "t double, d double").select(st.two_sided_p(F.col("t"), F.col("d")).alias("p")).collect()
    exact = [1 - 2 / math.pi * math.atan(0.5), 1 - 2 / math.pi * math.atan(2), 0.07338803477074, 1.4898e-12, 1.0, 0.0499958]
    for g, e in zip(got, exact):
        assert g.p == pytest.approx(e, rel=2e-5)


def test_ggplot_bins(spark):
    df = spark.createDataFrame([(float(k),) for k in range(0, 30)], "x double")
    got = st.histogram(df, "x", 30, "ggplot").orderBy("bin").collect()
    assert [r.n for r in got] == [1] * 30 and got[0].bin_lower == -0.5 and got[-1].bin_upper == 29.5


# -- plans --------------------------------------------------------------------
def test_cleaning_filters_reach_the_scan(spark):
    path = scratch_path(spark, "raw")
    raw_orders(spark, SF_SMALL).write.parquet(path)
    p = plan(cl.drop_missing(spark.read.parquet(path), "date_purchased", "customer"))
    assert "IsNotNull(date_purchased)" in p and "Not(EqualTo(date_purchased,))" in p and "IsNotNull(customer)" in p


def test_range_filter_reaches_the_scan(spark):
    path = scratch_path(spark, "raw")
    raw_orders(spark, SF_SMALL).write.parquet(path)
    df = spark.read.parquet(path)
    p = plan(tb.filter_range(df, "restaurant_total", 1e5, 2e5))
    pushed = p[p.index("PushedFilters"):]
    assert "GreaterThanOrEqual(restaurant_total," in pushed and "LessThanOrEqual(rest" in pushed
    assert tb.filter_range(df, "restaurant_total", 0.0, 1e12).count() == df.count()
    assert tb.filter_range(df, "restaurant_total", 0.0, 1e12, full_range=(5.0, 10.0)).count() == df.count()


def test_first_ties_read_the_orders_once(spark):
    path = scratch_path(spark, "clean")
    write_corrected(cleaned(spark, SF_SMALL), path)
    p = plan(co.customer_cohort(read_corrected(spark, path), ties="first"))
    assert p.count("FileScan parquet") == 1 and "Join" not in p


def test_levels_are_found_in_one_pass(spark):
    df = spark.createDataFrame([("b", 10, "x"), ("a", 9, None), (None, 100, "y"), ("b", 9, "x")], "s string, n int, t string")
    got = sorted(((r.s, r.n, r.t, r.s_code, r.n_code, r.t_code) for r in cl.encode_levels(df, ["s", "n", "t"]).collect()), key=str)
    assert got == sorted([("b", 10, "x", 2, 2, 1), ("a", 9, None, 1, 1, None), (None, 100, "y", None, 3, 2), ("b", 9, "x", 2, 1, 1)], key=str)


def test_page_after_equals_page(spark):
    df = spark.createDataFrame([(k % 7 if k % 5 else None, k) for k in range(60)], "a long, b long")
    last = None
    for k in range(8):
        want = [tuple(r) for r in tb.page(df, ["a", "b"], k, 8).collect()]
        got = [tuple(r) for r in tb.page_after(df, ["a", "b"], last, 8).collect()]
        assert got == want
        last = got[-1]


# -- lifecycle ----------------------------------------------------------------
def _break(spark, path):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    for f in fs.listStatus(where):
        if f.getPath().getName().startswith("part-"):
            out = fs.create(f.getPath(), True)
            out.writeBytes("broken")
            out.close()


def test_unreadable_delta_fails_and_uncommitted_is_ignored(spark):
    raw = raw_orders(spark, SF_SMALL)
    state = CohortState(spark, lookup(spark, SF_SMALL), TEST_CUTOFF)
    state.merge_batch(raw.filter("order_id < 3000"), 0)
    state.merge_batch(raw.filter("order_id >= 3000"), 1)
    root = state.root
    assert CohortState(spark, lookup(spark, SF_SMALL), TEST_CUTOFF, root=root).versions == [0, 1]
    _break(spark, f"{root}/v000000000/keys")
    again = CohortState(spark, lookup(spark, SF_SMALL), TEST_CUTOFF, root=root)
    assert again.versions == [0, 1]
    with pytest.raises(Exception):
        again.cohort_tables()[0].collect()
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/v000000001/keys/_SUCCESS")
    done.getFileSystem(spark._jsc.hadoopConfiguration()).delete(done, False)
    assert CohortState(spark, lookup(spark, SF_SMALL), TEST_CUTOFF, root=root).versions == [0]


def test_state_compacts_by_itself(spark):
    raw = raw_orders(spark, SF_SMALL)
    state = CohortState(spark, lookup(spark, SF_SMALL), TEST_CUTOFF, compact_every=2)
    for k, cond in enumerate(["order_id < 2000", "order_id between 2000 and 4000", "order_id > 4000"]):
        state.merge_batch(raw.filter(cond), k)
    assert state.base == 1 and state.version == 2
    act, counts = state.cohort_tables()
    act_b, counts_b = co.cohort_tables(cleaned(spark, SF_SMALL))
    assert rows(act) == rows(act_b) and rows(counts) == rows(counts_b)


def test_scratch_is_removed(spark):
    from retentio import session
    path = scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    mine = [x for x in session._scratch if x[1] == path]
    others = [x for x in session._scratch if x[1] != path]
    session._scratch[:] = mine
    session.drop_scratch()
    session._scratch[:] = others
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
