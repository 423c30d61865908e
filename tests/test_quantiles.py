"""Exact distributed order statistics against numpy, including a value that
holds a third of all rows and forced multi-pass narrowing."""
import numpy as np
import pytest

from retentio.operators.quantiles import numeric_summary, order_statistics


@pytest.mark.parametrize("seed", [1, 2])
def test_numeric_summary_matches_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    n = 3000
    x = np.concatenate([np.full(n // 3, 7.0), rng.normal(0, 1e6, n - n // 3)])
    y = rng.integers(0, 50, n).astype(float)
    pdf = [(float(a), float(b)) for a, b in zip(x, y)]
    df = spark.createDataFrame(pdf, "x double, y double")
    got = {r.column_name: r for r in numeric_summary(df).collect()}
    for c, v in (("x", x), ("y", y)):
        q = np.quantile(v, [0.25, 0.5, 0.75])
        assert got[c].q1 == pytest.approx(q[0], rel=1e-12, abs=1e-9)
        assert got[c].median == pytest.approx(q[1], rel=1e-12, abs=1e-9)
        assert got[c].q3 == pytest.approx(q[2], rel=1e-12, abs=1e-9)
        assert got[c].min == v.min() and got[c].max == v.max()


def test_order_statistics(spark):
    rng = np.random.default_rng(5)
    v = np.concatenate([np.full(500, 3.0), rng.exponential(10.0, 1500)])
    df = spark.createDataFrame([("a", float(t)) for t in v], "k string, x double")
    ranks = [0, 1, 499, 500, 1000, 1999]
    got = order_statistics(df, {"a": ranks})
    s = np.sort(v)
    assert [got[("a", r)] for r in ranks] == [s[r] for r in ranks]


def test_extreme_values_and_many_rows(spark):
    """More rows than any driver-side limit; ends whose difference overflows."""
    n = 150_000
    df = spark.range(n).selectExpr(
        "case when id = 0 then double('-Infinity') when id = 1 then -1.7e308 when id = 2 then 1.7e308"
        " when id = 3 then double('Infinity') when id % 3 = 0 then 5.0 else double(id) end as x")
    got = numeric_summary(df).collect()[0]
    v = np.array([-np.inf, -1.7e308, 1.7e308, np.inf] + [5.0 if k % 3 == 0 else float(k) for k in range(4, n)])
    s = np.sort(v)
    assert got.min == -np.inf and got.max == np.inf and got.median == s[[n // 2 - 1, n // 2]].mean()
    assert got.q1 == pytest.approx(s[(n - 1) // 4] * 0.25 + s[(n - 1) // 4 + 1] * 0.75)


def test_jobs_do_not_depend_on_the_rows(spark):
    sc = spark.sparkContext

    def jobs(n):
        sc.setJobGroup(f"q{n}", "count jobs")
        numeric_summary(spark.range(n).selectExpr("cast(id * id as double) as x", "id % 7 as y"))
        return len(sc.statusTracker().getJobIdsForGroup(f"q{n}"))

    assert abs(jobs(300) - jobs(200_000)) <= 2


def test_mean_is_not_cut_and_other_columns_are_listed(spark):
    df = spark.createDataFrame([(1e-8, True, "a"), (3e-8, False, "b"), (None, None, None)], "x double, flag boolean, t string") \
              .selectExpr("*", "date'2020-01-01' as d", "1e33 as big")
    got = {r.column_name: r for r in numeric_summary(df).collect()}
    assert got["x"].mean == pytest.approx(2e-8) and got["x"].n_missing == 1 and got["big"].mean == 1e33
    assert got["flag"].kind == "boolean" and got["d"].kind == "date" and got["t"].kind == "character" and got["d"].length == 3
