"""Grouping sets, ranked slices, association."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from retentio.operators import cohort as co
from retentio.operators import retention as rt
from retentio.operators import slices as sl
from retentio.operators.clean import with_dates, with_has_promo
from tests.helpers import rows

SLICES = [[], ["has_promo_value"], ["promo_value"], ["source"], ["source", "promo_value"]]


@pytest.fixture(scope="module")
def orders(spark):
    rnd = random.Random(11)
    data = []
    for k in range(600):
        customer = rnd.randint(1, 90) if rnd.random() < 0.7 else 7
        data.append((k, customer, rnd.choice(["a", "b", None]), rnd.choice([0, 1, None]),
                     f"2020-{rnd.randint(1, 12):02d}-{rnd.randint(1, 28):02d}T00:00:00.000Z", rnd.randint(1, 6), rnd.choice(["x", None])))
    df = spark.createDataFrame(data, "order_id long, customer long, source string, promo_value int, date_purchased string, shops_id long, state string")
    return with_has_promo(with_dates(df)).cache()


def test_every_slice_equals_its_own_aggregation(spark, orders):
    act, counts = co.cohort_tables(orders)
    got = {"counts": sl.slice_counts(counts, SLICES), "activity": sl.slice_activity(act, SLICES), "retention": sl.slice_retention(act, counts, SLICES)}
    single = {"counts": lambda by: rt.cohort_size(counts, by), "activity": lambda by: rt.cohort_active(act, by),
              "retention": lambda by: rt.retention(act, counts, by, with_cohort_text=False)}
    for what, table in got.items():
        table = table.cache()
        for by in SLICES:
            want = single[what](by)
            own = table.filter(F.col("slice") == sl.slice_name(by)).select(*want.columns)
            assert rows(own) == rows(want), (what, by)
        assert {r.slice for r in table.select("slice").distinct().collect()} == {sl.slice_name(s) for s in SLICES}
        table.unpersist()


def test_a_null_level_is_not_the_total(spark):
    counts = spark.createDataFrame([(1, None, 5), (1, "a", 2)], "cohort_id int, source string, cohort_count long")
    got = {(r.slice, r.source): r.cohort_count for r in sl.slice_counts(counts, [[], ["source"], ["source"]]).collect()}
    assert got == {("all", None): 7, ("source", None): 5, ("source", "a"): 2}


def test_cohort_tables_are_aggregated_once_for_all_slices(spark, orders):
    act, counts = co.cohort_tables(orders)
    plan = sl.slice_retention(act, counts, SLICES)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Expand") == 2


def test_wilson_bounds(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (5, 10), (90, 100)], "x long, n long")
    lo, hi = sl.wilson(F.col("x"), F.col("n"))
    for r in df.select("x", "n", lo.alias("lo"), hi.alias("hi")).collect():
        if r.n == 0:
            assert r.lo is None and r.hi is None
            continue
        z = sl.Z95  # the bounds are the shares at which the observed one is z deviations off
        for b in (r.lo, r.hi):
            assert (r.x / r.n - b) ** 2 == pytest.approx(z * z * b * (1 - b) / r.n, abs=1e-12)


@pytest.mark.parametrize("period", [1, 3])
def test_rates_and_ranks(spark, orders, period):
    act, counts = co.cohort_tables(orders, ["shops_id", "state"])
    rates = sl.slice_rates(act, counts, ["shops_id", "state"], period)
    cohort = [r.asDict() for r in co.customer_cohort(orders, ["shops_id", "state"]).collect()]
    months = {(r.customer, r.order_month) for r in co.active_months(orders).collect()}
    last = max(m for _, m in months)
    want: dict = {}
    for c in cohort:
        n = c["cohort_id"].month + period - 1
        if n <= last.month:
            x = want.setdefault((c["shops_id"], c["state"]), [0, 0])
            x[0] += 1
            x[1] += (c["customer"], c["cohort_id"].replace(month=n)) in months
    got = {(r.shops_id, r.state): [r.customers, r.retained] for r in rates.collect()}
    assert got == want
    full = sorted(rates.collect(), key=lambda r: (-r.lower, -r.upper, r.shops_id, r.state is None, r.state or ""))
    top = sl.best_slices(rates, ["shops_id", "state"], 4).orderBy("rank").collect()
    assert [(r.shops_id, r.state, r["rank"]) for r in top] == [(r.shops_id, r.state, k + 1) for k, r in enumerate(full[:4])]
    inside = sl.best_slices(rates, ["shops_id", "state"], 2, ["state"])
    for state in ("x", None):
        own = [(r.shops_id, r["rank"]) for r in inside.orderBy("rank").collect() if r.state == state]
        assert own == [(r.shops_id, k + 1) for k, r in enumerate([r for r in full if r.state == state][:2])]
    plan = inside._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    with pytest.raises(ValueError):
        sl.slice_rates(act, counts, ["shops_id"], 0)


def test_a_single_customer_is_not_the_best_shop(spark):
    rates = spark.createDataFrame([("one", 1, 1), ("many", 90, 100)], "s string, retained long, customers long")
    lo, hi = sl.wilson(F.col("retained"), F.col("customers"))
    top = sl.best_slices(rates.withColumn("lower", lo).withColumn("upper", hi), ["s"], 1).head()
    assert top.s == "many"


def test_ties_are_broken_by_value(spark):
    rates = spark.createDataFrame([(v, 0.5, 0.7) for v in ("b", None, "a", "c")], "s string, lower double, upper double")
    assert [r.s for r in sl.best_slices(rates, ["s"], 4).orderBy("rank").collect()] == ["a", "b", "c", None]


def _chi(table):
    n, cols = sum(map(sum, table)), [sum(c) for c in zip(*table)]
    return sum((x - sum(r) * c / n) ** 2 / (sum(r) * c / n) for r in table for x, c in zip(r, cols))


def test_association(spark):
    data = [("u", "k", 1, True)] * 30 + [("u", "k", 2, False)] * 10 + [("v", "k", 1, True)] * 5 + [("v", "k", 2, False)] * 25 + [(None, "k", 1, False)] * 7
    df = spark.createDataFrame(data, "a string, const string, b int, back boolean")
    got = {r.attribute: r for r in sl.association(sl.contingency(df, "back", ["a", "const", "b"])).collect()}
    x = _chi([[30, 10], [5, 25], [0, 7]])
    assert (got["a"].levels, got["a"].n, got["a"].df) == (3, 77, 2)
    assert got["a"].chi_squared == pytest.approx(x) and got["a"].p_value == pytest.approx(math.exp(-x / 2))
    assert got["a"].cramers_v == pytest.approx(math.sqrt(x / 77))
    assert (got["const"].df, got["const"].chi_squared, got["const"].p_value, got["const"].cramers_v) == (0, None, None, None)
    y = _chi([[35, 7], [0, 35]])
    assert got["b"].p_value == pytest.approx(math.erfc(math.sqrt(y / 2)))
    same = sl.association(sl.contingency(df.withColumn("back", F.lit(True)), "back", ["a"])).head()
    assert same.chi_squared is None and same.df == 0
    assert sl.association(sl.contingency(df.limit(0), "back", ["a"])).collect() == []


def test_outcome_leaves_out_customers_whose_months_are_not_over(spark, orders):
    got = {r.customer: r.returned for r in sl.customer_outcome(orders, ["source"], 3).collect()}
    months: dict = {}
    for r in co.active_months(orders).collect():
        months.setdefault(r.customer, set()).add(r.order_month.month)
    last = max(max(m) for m in months.values())
    want = {c: any(min(m) < x <= min(m) + 3 for x in m) for c, m in months.items() if min(m) + 3 <= last}
    assert got == want
