"""One customer holds a third of all orders, many of them copies of the first
order: the cohort tables stay exact (checked by brute force in pandas) and
the plan has no window or per-customer collection."""
import pandas as pd
from pyspark.sql import functions as F

from retentio.operators import cohort as co


def skewed(spark, n=30000):
    ids = spark.range(n)
    hot = (F.col("id") % 3 == 0)
    day = F.when(hot & (F.col("id") % 9 == 0), F.lit(0)).otherwise(F.col("id") % 400)
    ts = F.date_format(F.date_add(F.lit("2019-01-01").cast("date"), day.cast("int")),
                       "yyyy-MM-dd'T'00:00:00.000'Z'")
    return ids.select(
        F.col("id").alias("order_id"),
        F.when(hot, F.lit(1)).otherwise(F.col("id") % 997 + 2).alias("customer"),
        ts.alias("date_purchased"),
        (F.col("id") % 4).cast("string").alias("source"),
        (F.col("id") % 6).cast("int").alias("promo_value"),
    ).withColumns({
        "order_month": F.trunc(F.substring("date_purchased", 1, 10).cast("date"), "month"),
        "has_promo_value": F.col("promo_value") != 0,
    })


def brute(pdf):
    attrs = ["source", "has_promo_value", "promo_value"]
    first_ts = pdf.groupby("customer")["date_purchased"].transform("min")
    cohort_id = pdf.groupby("customer")["order_month"].transform("min")
    firsts = pdf[pdf["date_purchased"] == first_ts].assign(cohort_id=cohort_id)
    cohort = firsts[["customer", "cohort_id", *attrs]]
    months = pdf[["customer", "order_month"]].drop_duplicates()
    act = months.merge(cohort, on="customer")
    activity = act.groupby(["order_month", "cohort_id", *attrs]).size().rename("active_customers")
    counts = cohort.groupby(["cohort_id", *attrs]).size().rename("cohort_count")
    return activity.sort_index(), counts.sort_index()


def test_hot_customer_exact(spark):
    df = skewed(spark).cache()
    act, counts = co.cohort_tables(df)
    attrs = ["source", "has_promo_value", "promo_value"]
    got_a = (act.toPandas().set_index(["order_month", "cohort_id", *attrs])["active_customers"]
             .sort_index())
    got_c = counts.toPandas().set_index(["cohort_id", *attrs])["cohort_count"].sort_index()
    want_a, want_c = brute(df.toPandas())
    pd.testing.assert_series_equal(got_a.astype("int64"), want_a.astype("int64"), check_names=False)
    pd.testing.assert_series_equal(got_c.astype("int64"), want_c.astype("int64"), check_names=False)
    # the hot customer's first instant is copied ~3300 times: a weight, not a fan-out
    hot = counts.join(co.customer_cohort(df).filter("customer = 1")
                      .select("cohort_id").distinct(), "cohort_id")
    assert hot.agg(F.sum("cohort_count")).first()[0] >= 3000
    plan = act._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "collect_list" not in plan and "collect_set" not in plan
    df.unpersist()
