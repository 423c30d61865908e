"""Survival: spells, life tables and the log-rank test by hand and by simulation."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from retentio.functions.distributions import chi_square_tail, erfc
from retentio.operators import survival as sv
from retentio.operators.clean import with_dates


def _orders(spark, months, source=None):
    """months: customer -> list of (year, month)."""
    rows, k = [], 0
    for customer, when in months.items():
        for y, m in when:
            k += 1
            rows.append((k, customer, (source or {}).get(customer, "a"), f"{y}-{m:02d}-03T00:00:00.000Z"))
    return with_dates(spark.createDataFrame(rows, "order_id long, customer long, source string, date_purchased string"))


HAND = {1: [(2020, 1), (2020, 2), (2020, 9)],      # away six months: first spell of 2 periods ended, second is open
        2: [(2020, 1), (2020, 3)],                 # silent for seven months: ended after 3 periods
        3: [(2020, 8)],                            # silent for two months: censored at 1
        4: [(2020, 10)],                           # the last month: censored at 1
        5: [(2019, 12), (2020, 2), (2020, 4), (2020, 6), (2020, 8), (2020, 10)]}  # never away for three months


def test_spells_by_hand(spark):
    got = {(r.customer, r.spell): (r.duration, r.ended) for r in sv.customer_spells(_orders(spark, HAND), lapse=3).collect()}
    assert got == {(1, 1): (2, True), (1, 2): (1, False), (2, 1): (3, True), (3, 1): (1, False), (4, 1): (1, False), (5, 1): (11, False)}


def test_lapse_decides_what_ends(spark):
    ended = {lapse: {r.customer for r in sv.customer_spells(_orders(spark, HAND), lapse).collect() if r.ended} for lapse in (1, 3, 7, 8)}
    assert ended == {1: {1, 2, 3, 5}, 3: {1, 2}, 7: {2}, 8: set()}
    with pytest.raises(ValueError):
        sv.customer_spells(_orders(spark, HAND), 0)


def test_an_earlier_end_of_the_data_censors(spark):
    df = _orders(spark, {2: [(2020, 1), (2020, 3)]})
    for end, ended in (("2020-05-01", False), ("2020-06-01", True)):
        assert [r.ended for r in sv.customer_spells(df, 3, F.lit(end).cast("date")).collect()] == [ended]


def test_life_table_by_hand(spark):
    table = sv.life_table(sv.spell_counts(sv.first_lifetimes(_orders(spark, HAND), lapse=3))).orderBy("period").collect()
    assert [(r.period, r.at_risk, r.events, r.censored) for r in table[:4]] == [(1, 5, 0, 2), (2, 3, 1, 0), (3, 2, 1, 0), (4, 1, 0, 0)]
    assert [r.period for r in table] == list(range(1, 12))
    assert [round(r.survival, 12) for r in table[:4]] == [1.0, round(2 / 3, 12), round(1 / 3, 12), round(1 / 3, 12)]
    assert table[2].std_err == pytest.approx((1 / 3) * math.sqrt(1 / (3 * 2) + 1 / (2 * 1)))
    s = sv.lifetime_summary(sv.life_table(sv.spell_counts(sv.first_lifetimes(_orders(spark, HAND), lapse=3))), horizon=5).head()
    assert (s.customers, s.events, s.median_lifetime) == (5, 2, 3)
    assert s.mean_lifetime == pytest.approx(1 + 1 + 2 / 3 + 1 / 3 + 1 / 3)


def test_everyone_lost_and_nobody_lost(spark):
    lost = spark.createDataFrame([("x", 2, True)] * 3 + [("y", 4, False)] * 2, "s string, duration long, ended boolean")
    rows = {(r.s, r.period): r for r in sv.life_table(sv.spell_counts(lost, ["s"]), ["s"]).collect()}
    assert rows[("x", 2)].survival == 0 and rows[("x", 2)].std_err is None and rows[("x", 1)].std_err == 0
    assert rows[("y", 4)].survival == 1 and rows[("y", 4)].std_err == 0
    summary = {r.s: r for r in sv.lifetime_summary(sv.life_table(sv.spell_counts(lost, ["s"]), ["s"]), ["s"], 24).collect()}
    assert summary["x"].median_lifetime == 2 and summary["x"].mean_lifetime == 2
    assert summary["y"].median_lifetime is None and summary["y"].mean_lifetime == 24


def _random_lives(seed):
    rnd = random.Random(seed)
    return [(rnd.choice(["a", "b", None]), rnd.randint(1, 12) if rnd.random() < 0.7 else rnd.randint(1, 4), rnd.random() < 0.6) for _ in range(200)]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_lives_equal_a_plain_version(spark, seed):
    lives = _random_lives(seed)
    df = spark.createDataFrame(lives, "s string, duration long, ended boolean")
    table = sv.life_table(sv.spell_counts(df, ["s"]), ["s"])
    seen = {(r.s, r.period): (r.at_risk, r.events, round(r.survival, 9)) for r in table.collect()}
    want = {}
    for s in ("a", "b", None):
        alive, own = 1.0, [x for x in lives if x[0] == s]
        for t in range(1, max(x[1] for x in own) + 1):
            n, d = sum(x[1] >= t for x in own), sum(x[1] == t and x[2] for x in own)
            alive *= 1 - d / n
            want[(s, t)] = (n, d, round(alive, 9))
    assert seen == want
    for r in sv.log_rank(table, ["s"]).collect():
        o = e = v = 0.0
        for t in range(1, 13):
            n, d = sum(x[1] >= t for x in lives), sum(x[1] == t and x[2] for x in lives)
            n1, d1 = sum(x[1] >= t and x[0] == r.s for x in lives), sum(x[1] == t and x[2] and x[0] == r.s for x in lives)
            if n:
                o, e = o + d1, e + d * n1 / n
            if n > 1:
                v += d * n1 * (n - n1) * (n - d) / (n * n * (n - 1))
        assert (r.observed, r.expected, r.variance) == (o, pytest.approx(e), pytest.approx(v))
        assert r.p_value == pytest.approx(math.erfc(math.sqrt((o - e) ** 2 / v / 2)), rel=1e-9)


def test_one_slice_has_no_test(spark):
    df = spark.createDataFrame([("a", 2, True), ("a", 3, False)], "s string, duration long, ended boolean")
    r = sv.log_rank(sv.life_table(sv.spell_counts(df, ["s"]), ["s"]), ["s"]).head()
    assert r.chi_squared is None and r.p_value is None


def test_tails(spark):
    xs = [0.0, 1e-6, 0.3, 1.0, 4.4, 8.9, 9.1, 30.0, 200.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", erfc(F.col("x")).alias("e")).collect()
    assert all(r.e == pytest.approx(math.erfc(r.x), rel=1e-9, abs=1e-300) for r in got)
    rows = spark.createDataFrame([(x, d) for x in xs for d in (1, 2, 3, 4, 7, 50)], "x double, d int")
    for r in rows.select("x", "d", chi_square_tail(F.col("x"), F.col("d")).alias("p")).collect():
        h = r.x / 2
        if r.d % 2 == 0:
            want = math.exp(-h) * sum(h ** k / math.factorial(k) for k in range(r.d // 2))
        else:
            want = math.erfc(math.sqrt(h)) + sum(math.exp(-h) * h ** (k - 0.5) / math.gamma(k + 0.5) for k in range(1, (r.d - 1) // 2 + 1))
        assert r.p == pytest.approx(want, rel=1e-8, abs=1e-300)
    assert spark.range(1).select(chi_square_tail(F.lit(2.0), F.lit(0)).alias("p")).head().p is None


def test_one_customer_with_most_orders_is_reduced_first(spark):
    """The window meets customer-months, not orders."""
    plan = sv.customer_spells(_orders(spark, HAND), 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Window") < plan.index("HashAggregate(keys=[customer") or "partial_min" in plan
    assert "Python" not in plan and "CartesianProduct" not in plan
