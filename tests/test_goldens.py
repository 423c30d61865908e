"""Goldens printed in the reference's rendered slides, replayed on inline
fixtures: a pattern match, a first-rows table, a column-major table payload
paged by 8, and a least-squares coefficient table."""
import pytest
from pyspark.sql import functions as F

from retentio.operators import eda, stats, table_ops as tb

# The word list and its expected match.
WORDS = ["地爆天星", "天照", "加具土命", "神威", "須佐能乎", "無限月読"]
WORDS_WITH_TIAN = ["地爆天星", "天照"]

# The column-major payload of the first ten flower rows.
FLOWER_PAYLOAD = {
    "row": ["1", "2", "3", "4", "5", "6", "7", "8", "9", "10"],
    "sepal_length": [5.1, 4.9, 4.7, 4.6, 5.0, 5.4, 4.6, 5.0, 4.4, 4.9],
    "sepal_width": [3.5, 3.0, 3.2, 3.1, 3.6, 3.9, 3.4, 3.4, 2.9, 3.1],
    "petal_length": [1.4, 1.4, 1.3, 1.5, 1.4, 1.7, 1.4, 1.5, 1.4, 1.5],
    "petal_width": [0.2, 0.2, 0.2, 0.2, 0.2, 0.4, 0.3, 0.2, 0.2, 0.1],
    "species": ["setosa"] * 10,
}
# The first-six-rows table.
FLOWER_HEAD6 = [(5.1, 3.5, 1.4, 0.2, "setosa"), (4.9, 3.0, 1.4, 0.2, "setosa"),
                (4.7, 3.2, 1.3, 0.2, "setosa"), (4.6, 3.1, 1.5, 0.2, "setosa"),
                (5.0, 3.6, 1.4, 0.2, "setosa"), (5.4, 3.9, 1.7, 0.4, "setosa")]

# Stopping distance (ft) by speed (mph), the 50-row public cars data.
CARS_SPEED = [4, 4, 7, 7, 8, 9, 10, 10, 10, 11, 11, 12, 12, 12, 12, 13, 13, 13, 13, 14, 14, 14, 14,
              15, 15, 15, 16, 16, 17, 17, 17, 18, 18, 18, 18, 19, 19, 19, 20, 20, 20, 20, 20, 22,
              23, 24, 24, 24, 24, 25]
CARS_DIST = [2, 10, 4, 22, 16, 10, 18, 26, 34, 17, 28, 14, 20, 24, 28, 26, 34, 34, 46, 26, 36, 60,
             80, 20, 26, 54, 32, 40, 32, 40, 50, 42, 56, 76, 84, 36, 46, 68, 32, 48, 52, 56, 64, 66,
             54, 70, 92, 93, 120, 85]
# The printed coefficient table (estimate, std. error, t, p).
CARS_FIT = {"(Intercept)": (-17.579095, 6.7584402, -2.601058, 1.231882e-02),
            "speed": (3.932409, 0.4155128, 9.463990, 1.489836e-12)}


def test_grep_golden(spark):
    df = spark.createDataFrame([(w,) for w in WORDS], "w string")
    assert [r.w for r in stats.grep_values(df, "w", "天").collect()] == WORDS_WITH_TIAN


@pytest.fixture(scope="module")
def flowers(spark):
    cols = list(FLOWER_PAYLOAD)
    payload = spark.createDataFrame(
        [tuple(FLOWER_PAYLOAD[c] for c in cols)],
        "row array<string>, sepal_length array<double>, sepal_width array<double>, "
        "petal_length array<double>, petal_width array<double>, species array<string>")
    return tb.columns_to_rows(payload, cols).withColumn("row", F.col("row").cast("int"))


def test_columns_to_rows_golden(flowers):
    assert flowers.count() == 10
    assert [r.sepal_length for r in flowers.orderBy("row").collect()] == FLOWER_PAYLOAD["sepal_length"]


def test_head_golden(flowers):
    got = [(r.sepal_length, r.sepal_width, r.petal_length, r.petal_width, r.species)
           for r in eda.head_n(flowers, 6, ["row"]).collect()]
    assert got == FLOWER_HEAD6


def test_page_of_eight_golden(flowers):
    assert [r.row for r in tb.page(flowers, ["row"], 0, 8).collect()] == list(range(1, 9))
    assert [r.row for r in tb.page(flowers, ["row"], 1, 8).collect()] == [9, 10]


def test_linear_fit_golden(spark):
    cars = spark.createDataFrame(list(zip(CARS_SPEED, CARS_DIST)), "speed long, dist long")
    got = {r.term: r for r in stats.linear_fit(cars, "speed", "dist").collect()}
    pv = {r.term: r for r in stats.linear_fit_pvalues(cars, "speed", "dist").collect()}
    for term, (est, se, t, p) in CARS_FIT.items():
        assert got[term].estimate == pytest.approx(est, rel=1e-6)
        assert got[term].std_error == pytest.approx(se, rel=1e-6)
        assert got[term].t_value == pytest.approx(t, rel=1e-6)
        assert pv[term].estimate == pytest.approx(est, rel=1e-6)
        assert pv[term].p_value == pytest.approx(p, rel=1e-5)
