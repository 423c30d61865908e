"""Inline fixtures for the places where the reference's semantics differ from
Spark defaults (missing values, ties, NULL slice keys, Sunday weeks,
half-even rounding, bad date text, seed rows)."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from retentio.functions.dates import cohort_period, order_date, order_week
from retentio.functions.labels import percent_label
from retentio.functions.nulls import is_missing, na_sum
from retentio.operators import clean as cl
from retentio.operators import cohort as co
from retentio.operators import eda
from retentio.operators import retention as rt
from retentio.schema import ORDERS_SCHEMA
from tests.helpers import rows

D = dt.date


def orders(spark, data):
    """Rows as dicts over the orders schema (missing keys -> NULL)."""
    names = [f.name for f in ORDERS_SCHEMA.fields]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in data], ORDERS_SCHEMA)


def order(i, cust, ts, source="app", promo=0, total=10.0, shop=1, state="MD", postal=1, pay="credit"):
    return dict(order_id=i, source=source, date_purchased=ts, shipping_type="Delivery",
                payment_method=pay, promo_value=promo, restaurant_total=total, customer=cust,
                shops_id=shop, state=state, postal_code=postal)


def test_missing_mix(spark):
    df = spark.createDataFrame(
        [(None, None, None), ("", float("nan"), 1), ("NA", 1.0, 2), ("ok", 2.0, None)],
        "s string, d double, i int")
    got = df.select(is_missing("s", df.schema["s"].dataType).alias("s"),
                    is_missing("d", df.schema["d"].dataType).alias("d"),
                    is_missing("i", df.schema["i"].dataType).alias("i")).collect()
    assert [tuple(r) for r in got] == [(True, True, True), (True, True, False),
                                       (False, False, False), (False, False, True)]
    mc = {r.column_name: r.n_missing for r in cl.missing_columns(df).collect()}
    assert mc == {"s": 2, "d": 2, "i": 2}


def test_zip_edge_match_nomatch_duplicate(spark):
    df = orders(spark, [order(1, 10, "2019-03-13T08:00:00.000Z", state="", postal=100),
                        order(2, 10, "2019-03-14T08:00:00.000Z", state=None, postal=200),
                        order(3, 10, "2019-03-15T08:00:00.000Z", state=None, postal=300),
                        order(4, 10, "2019-03-16T08:00:00.000Z", state="NY", postal=300)])
    lk = spark.createDataFrame([(100, "MD"), (300, "VA"), (300, "WV")], "zip int, state_id string")
    got = sorted((r.order_id, r.state) for r in
                 cl.impute_missing(df, lk, "postal_code", "zip", "state", "state_id").collect())
    # unmatched 2 dropped; duplicate key fans out for the missing row only
    assert got == [(1, "MD"), (3, "VA"), (3, "WV"), (4, "NY")]
    split = cl.append(cl.drop_missing(df, "state"),
                      cl.impute_by_lookup(cl.missing_rows(df, "state"), lk, "postal_code", "zip",
                                          "state", "state_id"))
    assert sorted((r.order_id, r.state) for r in split.collect()) == got


def test_iso_dates_keep_text_date_and_bad_text_is_null(spark):
    df = spark.createDataFrame([("2019-03-13T23:59:59.000Z",), ("2019-03-13T02:02:07.000Z",),
                                ("bad",), ("",)], "t string")
    got = [r.d for r in df.select(order_date("t").alias("d")).collect()]
    assert got == [D(2019, 3, 13), D(2019, 3, 13), None, None]


def test_weeks_start_sunday(spark):
    days = [D(2019, 3, 16), D(2019, 3, 17), D(2019, 3, 18), D(2019, 12, 31), D(2020, 1, 1)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    sun = [r.w for r in df.select(order_week("d").alias("w")).collect()]
    mon = [r.w for r in df.select(order_week("d", "monday").alias("w")).collect()]
    assert sun == [D(2019, 3, 10), D(2019, 3, 17), D(2019, 3, 17), D(2019, 12, 29), D(2019, 12, 29)]
    assert mon == [D(2019, 3, 11), D(2019, 3, 11), D(2019, 3, 18), D(2019, 12, 30), D(2019, 12, 30)]


def test_cohort_period(spark):
    df = spark.createDataFrame([(D(2019, 3, 1), D(2019, 3, 1)), (D(2019, 3, 1), D(2020, 2, 1)),
                                (D(2019, 3, 1), D(2019, 2, 1))], "c date, m date")
    assert [r.p for r in df.select(cohort_period("c", "m").alias("p")).collect()] == [1, 12, 0]


def test_half_rates_round_half_even(spark):
    df = spark.createDataFrame([(1 / 8,), (3 / 8,), (None,), (1.0,)], "r double")
    got = [r.l for r in df.select(percent_label("r", "0").alias("l")).collect()]
    assert got == ["12%", "38%", "0", "100%"]


def test_half_revenue_sum_propagates_null_and_rounds_even(spark):
    df = orders(spark, [order(1, 1, "2019-03-01T00:00:00.000Z", total=2.50, shop=1),
                        order(2, 1, "2019-03-01T00:00:00.000Z", total=3.50, shop=2),
                        order(3, 1, "2019-03-01T00:00:00.000Z", total=-3.50, shop=3),
                        order(4, 1, "2019-03-01T00:00:00.000Z", total=None, shop=4),
                        order(5, 1, "2019-03-01T00:00:00.000Z", total=1.0, shop=4)])
    got = {r.shops_id: r.rest_revenue for r in eda.revenue_by_shop(df).collect()}
    assert got == {1: 2.0, 2: 4.0, 3: -4.0, 4: None}
    s = spark.createDataFrame([(1,), (None,), (2,)], "x int").agg(na_sum("x").alias("s"))
    assert s.first().s is None


def _clean(spark, data):
    lk = spark.createDataFrame([(1, "MD")], "zip int, state_id string")
    return cl.clean_orders(orders(spark, data), lk, None)


def test_ties_all_and_first(spark):
    data = [order(1, 7, "2019-03-05T10:00:00.000Z", source="web", promo=0),
            order(2, 7, "2019-03-05T10:00:00.000Z", source="ios", promo=2),
            order(3, 7, "2019-04-01T10:00:00.000Z"),
            order(4, 8, "2019-04-02T10:00:00.000Z", source="web")]
    df = _clean(spark, data)
    assert co.customer_first_order(df).count() == 3          # both tied rows of 7
    assert co.customer_first_order(df, ties="first").count() == 2
    act = co.customer_activity(df)
    assert act.count() == 2 * 2 + 1                          # ties fan out over months
    ca = co.cohort_activity(df)
    assert ca.agg(F.sum("active_customers")).first()[0] == act.count()
    first = co.cohort_counts(co.customer_cohort(df, ties="first"))
    assert first.agg(F.sum("cohort_count")).first()[0] == 2
    kept = co.customer_first_order(df, ties="first").filter("customer = 7").first()
    assert kept.order_id == 1


def test_null_promo_slices_join_null_safe(spark):
    data = [order(1, 1, "2019-03-05T10:00:00.000Z", promo=None),
            order(2, 1, "2019-04-05T10:00:00.000Z", promo=1),
            order(3, 2, "2019-03-06T10:00:00.000Z", promo=0)]
    df = _clean(spark, data)
    cohort = co.customer_cohort(df)
    ret = rt.retention(co.cohort_activity(df, cohort=cohort), co.cohort_counts(cohort),
                       ["has_promo_value"])
    got = rows(ret, ["order_month", "has_promo_value", "retention_rate"])
    assert got == sorted([("2019-03-01", False, 1.0), ("2019-04-01", None, 1.0),
                          ("2019-03-01", None, 1.0)], key=lambda t: tuple((x is None, str(x)) for x in t))
    assert ret.filter(F.col("cohort_count").isNull()).count() == 0


def test_sentinel_payment(spark):
    data = [order(1, 1, "2019-03-05T10:00:00.000Z", pay="/"),
            order(2, 1, "2019-03-06T10:00:00.000Z", pay="cash"),
            order(3, 1, "2019-03-07T10:00:00.000Z", pay=None)]
    df = orders(spark, data)
    assert cl.filter_equals(df, "payment_method", "/").count() == 1     # NULL never matches
    got = sorted((r.order_id, r.payment_method) for r in cl.null_if(df, "payment_method", "/").collect())
    assert got == [(1, None), (2, "cash"), (3, None)]


def test_sparse_cohort_seed_rows_and_bands(spark):
    data = [order(1, 1, "2019-01-05T10:00:00.000Z"), order(2, 1, "2019-03-05T10:00:00.000Z"),
            order(3, 2, "2019-02-05T10:00:00.000Z"), order(4, 2, "2019-03-07T10:00:00.000Z")]
    df = _clean(spark, data)
    act = co.cohort_activity(df)
    seeded = rt.with_seed_rows(act)
    seeds = seeded.filter("cohort_period = 0").collect()
    assert sorted((r.order_month, r.cohort_id, r.active_customers) for r in seeds) == [
        (D(2018, 12, 1), D(2019, 1, 1), 0), (D(2019, 1, 1), D(2019, 2, 1), 0)]
    area = {(r.cohort_id, r.order_month): r.active_customers for r in rt.area_series(act).collect()}
    assert (D(2019, 1, 1), D(2019, 2, 1)) not in area                  # inactive month stays absent
    bands = rt.stacked_bands(rt.activity_by(act, None)).filter("order_month = '2019-03-01'")
    b = sorted((r.cohort_id, r.band_lower, r.band_upper) for r in bands.collect())
    assert b == [(D(2019, 1, 1), 0, 1), (D(2019, 2, 1), 1, 2)]


def test_key_sets_linked_filter_and_diff(spark):
    from retentio.operators import table_ops as tb
    df = spark.createDataFrame([(i, i % 3) for i in range(10)], "k long, g long")
    a = df.filter("k < 6").select("k")
    b = df.filter("k > 2").select("k")
    empty = df.filter("k < 0").select("k")
    assert sorted(r.k for r in tb.linked_filter(df, "k", [a, None, b]).collect()) == [3, 4, 5]
    assert tb.linked_filter(df, "k", [a, empty]).count() == 0
    assert tb.linked_filter(df, "k", [None]).count() == 10
    diff = sorted((r.k, r.change) for r in tb.keyset_diff(a, b, "k").collect())
    assert diff == [(0, "removed"), (1, "removed"), (2, "removed"), (6, "added"), (7, "added"),
                    (8, "added"), (9, "added")]
    with_null = spark.createDataFrame([(None,), (1,)], "k long")
    got = sorted((r.k is None, r.change) for r in tb.keyset_diff(with_null, b, "k").collect())
    assert (True, "removed") in got and (False, "removed") in got


def test_table_filters(spark):
    from retentio.operators import table_ops as tb
    df = spark.createDataFrame([(1.0, True, "Credit card"), (float("nan"), None, "cash"),
                                (5.0, False, "CREDIT"), (None, True, None)],
                               "x double, b boolean, t string")
    assert tb.filter_range(df, "x", 1.0, 5.0).count() == 4          # full range: off
    assert tb.filter_range(df, "x", 1.0, 5.0, full_range_off=False).count() == 2
    assert tb.filter_range(df, "x", 1.5, 5.0).count() == 1
    assert tb.filter_range(df, "x", None, 4.0).count() == 1
    assert tb.filter_range(df, "x", None, None).count() == 4
    assert tb.filter_set(df, "t", []).count() == 4
    assert tb.filter_logical(df, "b", ["na", "false"]).count() == 2
    assert tb.search_text(df, "t", "card credit").count() == 1
    assert tb.search_text(df, "t", "^cred", regex=True).count() == 2
    paged = tb.page(spark.range(30).withColumnRenamed("id", "k"), ["k"], 1, 8)
    assert [r.k for r in paged.collect()] == list(range(8, 16))


def test_columns_to_rows_checks_lengths(spark):
    from retentio.operators import table_ops as tb
    ok = spark.createDataFrame([([1, 2], ["a", "b"])], "x array<int>, y array<string>")
    assert [tuple(r) for r in tb.columns_to_rows(ok, ["x", "y"]).collect()] == [(1, "a"), (2, "b")]
    bad = spark.createDataFrame([([1, 2], ["a"])], "x array<int>, y array<string>")
    with pytest.raises(Exception):
        tb.columns_to_rows(bad, ["x", "y"]).collect()


def test_encode_levels(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "s string")
    got = sorted(((r.s, r.s_code) for r in cl.encode_levels(df, "s").collect()),
                 key=lambda t: (t[0] is None, str(t[0])))
    assert got == [("a", 1), ("b", 2), ("b", 2), (None, None)]


def test_n_distinct_counts_null_as_value(spark):
    df = spark.createDataFrame([(1,), (1,), (None,), (2,)], "order_id long")
    assert eda.n_distinct(df, "order_id", "n").first().n == 3
    assert eda.n_distinct(df, "order_id", "n", na_rm=True).first().n == 2


def test_csv_reader_na_and_blank(spark, tmp_path):
    from retentio.sources import read_orders
    p = tmp_path / "orders.csv"
    p.write_text(
        "order_id,source,date_purchased,shipping_type,payment_method,promo_value,"
        "restaurant_total,customer,shops_id,state,postal_code\n"
        '1,iosapp,2019-03-13T08:02:07.000Z,Delivery,credit,0,15.5,13300000000,24597,MD,21162\n'
        '2,NA,"",Delivery,/,,-3.0,NA,261,"",8007\n')
    got = {r.order_id: r for r in read_orders(spark, str(p)).collect()}
    assert got[1].customer == 13300000000 and got[1].postal_code == 21162
    assert got[2].source is None and got[2].customer is None and got[2].promo_value is None
    assert got[2].date_purchased == "" and got[2].state == ""
    assert got[2].restaurant_total == -3.0 and got[2].postal_code == 8007


def test_month_partitions_pruned_on_saved_table(spark):
    from retentio.plans.common import cleaned
    from retentio.session import scratch_path
    from retentio.sources import read_corrected, write_corrected
    from tests.conftest import SF_SMALL
    path = scratch_path(spark, "prune")
    write_corrected(cleaned(spark, SF_SMALL), path)
    df = cl.trim_before(read_corrected(spark, path), "order_date", "2000-01-01", month_col="order_month")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(order_month" in plan and "<= 2000-01-01" in plan, plan
    assert df.filter("order_date >= '2000-01-01'").count() == 0
    assert df.count() == cleaned(spark, SF_SMALL).filter("order_date < '2000-01-01'").count()


def test_csv_unquoted_blank_text_is_missing_either_way(spark, tmp_path):
    """An unquoted blank text cell reads as NULL (the reference's reader keeps
    ''); both are missing, so the cleaning stage treats the row the same."""
    from retentio.sources import read_orders
    header = ("order_id,source,date_purchased,shipping_type,payment_method,promo_value,"
              "restaurant_total,customer,shops_id,state,postal_code\n")
    p1, p2 = tmp_path / "blank.csv", tmp_path / "quoted.csv"
    p1.write_text(header + "1,web,2019-03-13T08:02:07.000Z,Delivery,cash,0,1.0,5,2,,1\n")
    p2.write_text(header + '1,web,2019-03-13T08:02:07.000Z,Delivery,cash,0,1.0,5,2,"",1\n')
    lk = spark.createDataFrame([(1, "MD")], "zip int, state_id string")
    a = read_orders(spark, str(p1))
    b = read_orders(spark, str(p2))
    assert a.first().state is None and b.first().state == ""
    ca = cl.clean_orders(a, lk, None).select("order_id", "state").collect()
    cb = cl.clean_orders(b, lk, None).select("order_id", "state").collect()
    assert ca == cb == [(1, "MD")]
