"""Late orders into the saved table; growth towards a target."""

from __future__ import annotations

import datetime as dt
import math
import os

import pytest
from pyspark.sql import functions as F

from retentio.operators import forecast as fc
from retentio.operators.clean import with_dates, with_has_promo
from retentio.session import scratch_path
from retentio.sources import upsert as up


def _load(spark, rows, version):
    """rows: (order_id, date or None, payment)."""
    data = [(i, "s", None if d is None else f"{d}T00:00:00.000Z", "D", pay, 0, 1.0, 7, 1, "NY", 1) for i, d, pay in rows]
    df = spark.createDataFrame(data, "order_id long, source string, date_purchased string, shipping_type string, payment_method string, promo_value int,"
                                     " restaurant_total double, customer long, shops_id long, state string, postal_code int")
    return with_has_promo(with_dates(df)).withColumn("version", F.lit(version).cast("bigint"))


def _table(spark, path):
    return sorted((r.order_id is not None, r.order_id, str(r.order_date), r.payment_method, r.version, str(r.order_month)) for r in up.read_versioned(spark, path).collect())


def _files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path.removeprefix("file:")) for f in fs if f.endswith(".parquet")}


FIRST = [(1, "2020-01-05", "a"), (2, "2020-01-06", "a"), (3, "2020-02-01", "a"), (4, "2020-03-01", "a"), (5, "2020-04-01", "a"), (4, "2020-03-01", "a")]
LATE = [(6, "2020-01-09", "b"), (3, "2020-01-20", "b"), (7, "2020-05-01", "b"), (4, "2020-03-02", "b"), (4, "2020-03-02", "b")]


@pytest.fixture
def path(spark):
    p = scratch_path(spark, "upsert-test")
    up.write_versioned(_load(spark, FIRST, 1), p)
    return p


def test_newest_version_wins_and_other_months_keep_their_files(spark, path):
    before = _files(path)
    months = up.upsert_corrected(spark, path, _load(spark, LATE, 2))
    assert [str(m) for m in months] == ["2020-01-01", "2020-02-01", "2020-03-01", "2020-05-01"]
    got = {(r.order_id, str(r.order_date), r.payment_method, r.version) for r in up.read_versioned(spark, path).collect()}
    assert got == {(1, "2020-01-05", "a", 1), (2, "2020-01-06", "a", 1), (3, "2020-01-20", "b", 2), (4, "2020-03-02", "b", 2),
                   (5, "2020-04-01", "a", 1), (6, "2020-01-09", "b", 2), (7, "2020-05-01", "b", 2)}
    april = {f: t for f, t in before.items() if "2020-04-01" in f}
    assert april and april.items() <= _files(path).items()
    assert not any("2020-02-01" in f for f in _files(path))  # its only order moved away


def test_replays_change_nothing(spark, path):
    up.upsert_corrected(spark, path, _load(spark, LATE, 2))
    after = _table(spark, path)
    for rows, version in ((LATE, 2), (FIRST, 1), (LATE, 2)):
        up.upsert_corrected(spark, path, _load(spark, rows, version))
        assert _table(spark, path) == after


def test_loads_in_any_order_end_alike(spark, path):
    third = [(3, "2020-06-01", "c"), (6, "2020-01-09", "c")]
    one = path
    two = scratch_path(spark, "upsert-test")
    up.write_versioned(_load(spark, FIRST, 1), two)
    up.upsert_corrected(spark, one, _load(spark, LATE, 2)), up.upsert_corrected(spark, one, _load(spark, third, 3))
    up.upsert_corrected(spark, two, _load(spark, third, 3)), up.upsert_corrected(spark, two, _load(spark, LATE, 2))
    assert _table(spark, one) == _table(spark, two)


def test_nothing_late_and_rows_without_id_or_month(spark, path):
    before = _files(path)
    assert up.upsert_corrected(spark, path, _load(spark, [], 2)) == []
    assert _files(path) == before
    odd = [(None, "2020-01-07", "x"), (None, "2020-01-07", "y"), (9, None, "z")]
    for _ in range(2):
        up.upsert_corrected(spark, path, _load(spark, odd, 2))
    got = [(r.order_id, r.payment_method, str(r.order_month)) for r in up.read_versioned(spark, path).collect() if r.version == 2]
    assert sorted(got, key=str) == sorted([(None, "x", "2020-01-01"), (None, "y", "2020-01-01"), (9, "z", "None")], key=str)


def test_replays_and_older_loads_rewrite_no_month(spark, path):
    up.upsert_corrected(spark, path, _load(spark, LATE, 2))
    up.upsert_corrected(spark, path, _load(spark, [(None, "2020-04-02", "x"), (8, None, "x")], 2))
    before = _files(path)
    for rows, version in ((LATE, 2), (FIRST, 1), ([(None, "2020-04-02", "x"), (8, None, "x")], 2)):
        assert up.upsert_corrected(spark, path, _load(spark, rows, version)) == []
    assert _files(path) == before


def test_rows_held_twice_become_one_by_a_replay(spark, path):
    assert [str(m) for m in up.upsert_corrected(spark, path, _load(spark, FIRST, 1))] == ["2020-03-01"]
    assert [r[1] for r in _table(spark, path)] == [1, 2, 3, 4, 5]
    moved = _load(spark, [(3, "2020-01-20", "b"), (1, "2020-06-01", "b")], 1)  # of one version, the larger row
    assert [str(m) for m in up.upsert_corrected(spark, path, moved)] == ["2020-01-01", "2020-06-01"]
    assert [r[1:4] for r in _table(spark, path)][0] == (1, "2020-06-01", "b")


def test_late_rows_are_evaluated_once(spark, path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        seen.add(1)
        return x
    late = _load(spark, LATE, 2).withColumn("payment_method", counted("payment_method"))
    up.upsert_corrected(spark, path, late)
    assert seen.value == len(LATE)


# -- growth -----------------------------------------------------------------------
def _plain(values, target, alpha, beta, horizon):
    level, trend, sse = values[0], (values[1] - values[0] if len(values) > 1 else 0.0), 0.0
    for k, x in enumerate(values[1:], 1):
        ahead = level + trend
        sse += (x - ahead) ** 2 if k >= 2 else 0
        new = alpha * x + (1 - alpha) * ahead
        level, trend = new, beta * (new - level) + (1 - beta) * trend
    error = math.sqrt(sse / (len(values) - 2)) if len(values) > 2 else None

    def months(shift):
        total = sum(values)
        if total >= target:
            return 0
        for h in range(1, horizon + 1):
            total += max(0.0, level + h * trend + shift)
            if total >= target:
                return h
        return None
    return level, trend, error, months(0.0), months(error or 0.0), months(-(error or 0.0))


@pytest.mark.parametrize("alpha,beta", [(0.5, 0.3), (1.0, 1.0), (0.1, 0.9)])
def test_forecast_equals_the_sequential_version(spark, alpha, beta):
    lists = {"up": [3.0, 5.0, 4.0, 9.0, 12.0], "gap": [10.0, 0.0, 0.0, 6.0], "one": [4.0], "two": [4.0, 2.0], "down": [50.0, 30.0, 20.0, 5.0], "done": [900.0, 200.0, 1.0]}
    rows = [(s, dt.date(2020 + (10 + k) // 12, (10 + k) % 12 + 1, 1), v) for s, vs in lists.items() for k, v in enumerate(vs) if v or s != "gap"]
    series = fc.monthly_series(spark.createDataFrame(rows, "s string, m date, v double"), "m", "v", ["s"])
    assert {r.s: r["values"] for r in series.collect()} == lists
    for r in fc.growth_forecast(series, 200, alpha, beta, 40).collect():
        want = _plain(lists[r.s], 200, alpha, beta, 40)
        got = (r.level, r.trend, r.error, r.months_to_target, r.months_at_best, r.months_at_worst)
        assert got[:2] == pytest.approx(want[:2]) and got[3:] == want[3:]
        assert got[2] == (None if want[2] is None else pytest.approx(want[2]))


def test_no_series_no_forecast(spark):
    none = spark.createDataFrame([], "m date, v double")
    assert fc.growth_forecast(fc.monthly_series(none, "m", "v"), 10).collect() == []
    with pytest.raises(ValueError):
        fc.smoothed(F.array(F.lit(1.0)), alpha=0)
