"""Physical-plan checks: no Python in any registered plan, filters reach the
scan, and the cohort path keeps its exchange budget."""
import pytest

from retentio.plans.queries import QUERIES
from tests.conftest import SF_SMALL

PY_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas",
            "FlatMapCoGroupsInPandas", "PythonUDF")
SIDE_EFFECT = {"read_orders", "read_zip_lookup", "write_corrected", "read_corrected",
               "read_corrected_bucketed",
               "numeric_summary", "linear_fit_pvalues"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SIDE_EFFECT))
def test_no_python_in_plan(spark, name):
    p = plan(QUERIES[name](spark, SF_SMALL))
    assert not any(n in p for n in PY_NODES), p


def test_exchange_budget_cohort_activity(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        from retentio.operators import cohort as co
        from retentio.sources.tables import _table
        df = _table(spark, SF_SMALL, "orders").selectExpr(
            "o_orderkey AS order_id", "o_custkey AS customer", "o_orderpriority AS source",
            "cast(o_orderdate as string) AS date_purchased", "trunc(o_orderdate, 'month') AS order_month",
            "false AS has_promo_value", "0 AS promo_value")
        act, counts = co.cohort_tables(df)
        p = plan(act.unionByName(counts, allowMissingColumns=True))
        # orders read twice: customer-month table (reused) and the first-order join
        assert p.count("FileScan parquet") == 2, p
        assert "ReusedExchange" in p, p
        assert "Window" not in p
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_filters_and_pruning_reach_scan(spark):
    from pyspark.sql import functions as F
    from retentio.operators import clean as cl
    from retentio.sources.tables import _table
    o = _table(spark, SF_SMALL, "orders")
    p = plan(cl.trim_before(o.withColumn("d", F.to_date("o_orderdate")), "o_orderdate", "2000-01-01")
             .select("o_orderkey"))
    assert "PushedFilters: [IsNotNull(o_orderdate), LessThan(o_orderdate" in p, p
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in p, p


def test_bucketed_table_join_back_without_shuffle(spark):
    import uuid
    from retentio.operators import cohort as co
    from retentio.plans.common import cleaned
    from retentio.session import scratch_path
    from retentio.sources import save_corrected_table
    table = f"t_{uuid.uuid4().hex[:10]}"
    save_corrected_table(cleaned(spark, SF_SMALL), table, scratch_path(spark, "bkt"), 4)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        import re
        act, _ = co.cohort_tables(spark.table(table))
        p = re.sub(r"#\d+L?", "", plan(act))
        # the first-order join keeps the table's bucket layout: only the keys side moves
        assert "hashpartitioning(__k, first_ts, 4)" in p, p
        assert "Exchange hashpartitioning(customer, date_purchased" not in p, p
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
