"""Every registered query with oracle SQL equals DuckDB on the sf0.001 tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from retentio.plans.oracle import ORACLE
from retentio.plans.queries import QUERIES
from tests.conftest import SF_SMALL
from tools.oracle_check import canon

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert set(df.columns) >= {"cohort_id", "order_month", "retention_rate"}


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_duckdb(spark, con, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    res = con.execute(ORACLE[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    srows = [tuple(r) for r in sdf.collect()]
    assert len(srows) == len(drows)
    assert canon(sdf.columns, srows) == canon(dcols, drows)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", ["order_date", "order_week", "orders_by_week_monday",
                                  "cohort_retention_all", "retention_by_hour", "read_orders"])
def test_date_queries_ignore_session_zone(spark, con, name):
    """Dates are cut from text and the test timestamps carry no zone, so a
    session in another time zone gives the same rows."""
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        sdf = QUERIES[name](spark, SF_SMALL)
        srows = [tuple(r) for r in sdf.collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    res = con.execute(ORACLE[name])
    dcols = [d[0] for d in res.description]
    assert canon(sdf.columns, srows) == canon(dcols, res.fetchall())
