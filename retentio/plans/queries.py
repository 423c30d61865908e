"""The registered queries: one per operator id of the survey inventory.

Each takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the whole
test tables.  Column names equal those of the oracle SQL in ``oracle.py``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio import sources as src
from retentio.functions.dates import cohort_period, previous_month
from retentio.operators import bitmaps as bm
from retentio.operators import clean as cl
from retentio.operators import cohort as co
from retentio.operators import eda
from retentio.operators import forecast as fc
from retentio.operators import heavy as hv
from retentio.operators import postings as po
from retentio.operators import quantiles as qn
from retentio.operators import retention as rt
from retentio.operators import sketches as sk
from retentio.operators import slices as sl
from retentio.operators import smooth as sm
from retentio.operators import stats as st
from retentio.operators import survival as sv
from retentio.operators import table_ops as tb
from retentio.plans.common import (
    after_missing, cleaned, cleaned_events, dated_untrimmed, lookup, raw_orders,
)
from retentio.session import scratch_path
from retentio.sources import upsert as up
from retentio.sources.tables import TEST_CUTOFF

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def query(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        return fn
    return deco


# ---------------------------------------------------------------- cleaning --
@query("clean_orders")
def q_clean_orders(spark, sf):
    return cleaned(spark, sf)


# ------------------------------------------------------------------ cohort --
@query("customer_first_order")
def q_customer_first_order(spark, sf):
    return co.customer_first_order(cleaned(spark, sf))


@query("customer_cohort")
def q_customer_cohort(spark, sf):
    return co.customer_cohort(cleaned(spark, sf))


@query("customer_activity")
def q_customer_activity(spark, sf):
    return co.customer_activity(cleaned(spark, sf))


@query("cohort_activity")
def q_cohort_activity(spark, sf):
    return co.cohort_activity(cleaned(spark, sf))


@query("cohort_counts")
def q_cohort_counts(spark, sf):
    return co.cohort_counts(co.customer_cohort(cleaned(spark, sf)))


def _cohort_tables(spark, sf):
    return co.cohort_tables(cleaned(spark, sf))


# --------------------------------------------------------------- retention --
@query("cohort_counts_all")
def q_cohort_counts_all(spark, sf):
    return rt.cohort_size(_cohort_tables(spark, sf)[1])


@query("cohort_activity_all")
def q_cohort_activity_all(spark, sf):
    return rt.cohort_active(_cohort_tables(spark, sf)[0])


@query("cohort_retention_all")
def q_cohort_retention_all(spark, sf):
    act, counts = _cohort_tables(spark, sf)
    return rt.retention(act, counts)


# ============================================================ fixed values ==
# Parameters of the registered queries (the reference's own values where it
# has them: bins=30, page length 8, head 6).
HIST_BINS = 30
HEAD_N = 6
PAGE_K, PAGE_N = 2, 8
RANGE_COL, RANGE_LO, RANGE_HI = "restaurant_total", 100000.0, 200000.0
RANGE_ENDS = (0.0, 600000.0)  # the slider's own ends
TEST_FIRST_MONTH = "1995-01-01"  # the test orders begin here and are cut at TEST_CUTOFF
SET_COL, SET_VALUES = "source", ["1-URGENT", "2-HIGH"]
LOGICAL_COL, LOGICAL_CHOICES = "has_promo_value", ["true", "na"]
SEARCH_COL, SEARCH_WORDS = "payment_method", "auto MOBILE"
REGEX_COL, REGEX_QUERY = "source", "^[12]-"
GREP_COL, GREP_PATTERN = "state", "_1[0-9]$"
# Months of silence after which a customer counts as lost; periods of the mean lifetime.
LAPSE_MONTHS, LIFETIME_HORIZON = 6, 24
SLICES = [[], ["has_promo_value"], ["promo_value"], ["source"]]
# Period whose rate ranks the slices, slices shown; months in which a customer may return.
RANK_PERIOD, RANK_K, RANK_K_WITHIN, RETURN_WITHIN = 13, 10, 3, 6
ASSOCIATED = ["source", "promo_value", "shipping_type", "payment_method", "state", "shops_id", "hour"]
# Sketches of 2^10 keys (relative error 3.1 %), allowed errors, two ranges of months.
SKETCH_LG_K, SKETCH_ERRORS, RANK_ERROR = 10, 5, 0.03
RANGE_ONE, RANGE_TWO = ("1996-01-01", "1996-12-01"), ("1998-01-01", "1998-12-01")
QUANTILE_COLUMNS, QUANTILES = ["restaurant_total", "promo_value"], [0.25, 0.5, 0.75]
# Customers to reach.
TARGET_CUSTOMERS = 20_000
HEAVY_COLUMNS, HEAVY_K = ["source", "shipping_type", "payment_method", "state", "shops_id", "date_purchased"], 30
GROUP_COL, GROUP_KEY, GROUP_CHOSEN = "state", "customer", ["NATION_1", "NATION_2", "NATION_3"]
# ============================================================================



# ------------------------------------------------------- B: cleaning steps --
@query("missing_columns")
def q_missing_columns(spark, sf):
    return cl.missing_columns(raw_orders(spark, sf))


@query("missing_rows_date")
def q_missing_rows_date(spark, sf):
    return cl.missing_rows(raw_orders(spark, sf), "date_purchased")


@query("missing_rows_customer")
def q_missing_rows_customer(spark, sf):
    df = cl.drop_missing(raw_orders(spark, sf), "date_purchased")
    return cl.missing_rows(df, "customer")


@query("missing_rows_state")
def q_missing_rows_state(spark, sf):
    return cl.missing_rows(after_missing(spark, sf), "state")


@query("drop_missing")
def q_drop_missing(spark, sf):
    return after_missing(spark, sf)


@query("impute_state")
def q_impute_state(spark, sf):
    df = after_missing(spark, sf)
    return cl.impute_by_lookup(cl.missing_rows(df, "state"), lookup(spark, sf),
                               "postal_code", "zip", "state", "state_id")


@query("append_imputed")
def q_append_imputed(spark, sf):
    df = after_missing(spark, sf)
    imputed = cl.impute_by_lookup(cl.missing_rows(df, "state"), lookup(spark, sf),
                                  "postal_code", "zip", "state", "state_id")
    return cl.append(cl.drop_missing(df, "state"), imputed)


@query("has_promo")
def q_has_promo(spark, sf):
    return cleaned(spark, sf).select("order_id", "promo_value", "has_promo_value")


@query("sentinel_rows")
def q_sentinel_rows(spark, sf):
    return cl.filter_equals(cleaned(spark, sf, repair_sentinel=False), "payment_method", "/")


@query("sentinel_to_null")
def q_sentinel_to_null(spark, sf):
    df = cl.null_if(cleaned(spark, sf, repair_sentinel=False), "payment_method", "/")
    return df.select("order_id", "payment_method")


@query("encode_levels")
def q_encode_levels(spark, sf):
    df = cleaned(spark, sf).select("order_id", "source", "shipping_type", "payment_method")
    return cl.encode_levels(df, ["source", "shipping_type", "payment_method"])


@query("column_pick")
def q_column_pick(spark, sf):
    return cleaned(spark, sf).select("customer", "order_id").drop("order_id")


# ------------------------------------------------------------ C: dates -------
@query("order_date")
def q_order_date(spark, sf):
    return dated_untrimmed(spark, sf).select("order_id", "date_purchased", "order_date")


@query("order_month")
def q_order_month(spark, sf):
    return cleaned(spark, sf).select("order_id", "order_date", "order_month")


@query("order_week")
def q_order_week(spark, sf):
    return cleaned(spark, sf).select("order_id", "order_date", "order_week")


@query("date_range")
def q_date_range(spark, sf):
    return cl.date_range(dated_untrimmed(spark, sf), "order_date")


@query("trim_before")
def q_trim_before(spark, sf):
    return cl.trim_before(dated_untrimmed(spark, sf), "order_date", TEST_CUTOFF).select(
        "order_id", "order_date")


@query("cohort_period")
def q_cohort_period(spark, sf):
    act = co.customer_activity(cleaned(spark, sf))
    return act.select("customer", "order_month", "cohort_id",
                      cohort_period("cohort_id", "order_month").alias("cohort_period"))


@query("previous_month")
def q_previous_month(spark, sf):
    c = co.first_order_keys(cleaned(spark, sf)).select("cohort_id").distinct()
    return c.select("cohort_id", previous_month("cohort_id").alias("previous_month"))


# -------------------------------------------------------------- D: EDA -------
@query("n_orders")
def q_n_orders(spark, sf):
    return eda.n_orders(cleaned(spark, sf))


@query("n_customers")
def q_n_customers(spark, sf):
    return eda.n_customers(cleaned(spark, sf))


@query("avg_orders_per_customer")
def q_avg_orders(spark, sf):
    return eda.avg_orders_per_customer(cleaned(spark, sf))


@query("orders_per_customer")
def q_orders_per_customer(spark, sf):
    return eda.orders_per_customer(cleaned(spark, sf)).orderBy(F.desc("num_orders"), "customer")


@query("order_buckets")
def q_order_buckets(spark, sf):
    return eda.order_buckets(cleaned(spark, sf)).orderBy(F.desc("customer_count"))


@query("order_buckets_cumulative")
def q_order_buckets_cum(spark, sf):
    return eda.order_buckets_cumulative(cleaned(spark, sf)).orderBy("num_orders")


@query("orders_by_date")
def q_orders_by_date(spark, sf):
    return eda.count_by(cleaned(spark, sf), "order_date").orderBy("order_date")


@query("orders_by_week")
def q_orders_by_week(spark, sf):
    return eda.count_by(cleaned(spark, sf), "order_week").orderBy("order_week")


@query("promo_levels")
def q_promo_levels(spark, sf):
    return eda.levels(cleaned(spark, sf), "promo_value", na="drop")


@query("promo_share")
def q_promo_share(spark, sf):
    return eda.share_by(cleaned(spark, sf), "promo_value")


@query("revenue_by_shop")
def q_revenue_by_shop(spark, sf):
    return eda.revenue_by_shop(cleaned(spark, sf))


@query("shipping_levels")
def q_shipping_levels(spark, sf):
    return eda.levels(cleaned(spark, sf), "shipping_type")


@query("payment_levels_raw")
def q_payment_levels_raw(spark, sf):
    return eda.distinct_values(cleaned(spark, sf, repair_sentinel=False), "payment_method")


@query("payment_levels")
def q_payment_levels(spark, sf):
    return eda.levels(cleaned(spark, sf), "payment_method")


@query("source_levels")
def q_source_levels(spark, sf):
    return eda.levels(cleaned(spark, sf), "source")


@query("orders_by_shipping")
def q_orders_by_shipping(spark, sf):
    return eda.count_by(cleaned(spark, sf), "shipping_type").orderBy(F.desc("orders"))


@query("orders_by_payment")
def q_orders_by_payment(spark, sf):
    return eda.count_by(cleaned(spark, sf), "payment_method").orderBy(F.desc("orders"))


@query("orders_by_source")
def q_orders_by_source(spark, sf):
    return eda.count_by(cleaned(spark, sf), "source").orderBy(F.desc("orders"))


@query("orders_by_state")
def q_orders_by_state(spark, sf):
    return eda.share_by(cleaned(spark, sf), "state").orderBy(F.desc("orders"))


@query("kpi_summary")
def q_kpi_summary(spark, sf):
    return eda.kpi_summary(cleaned(spark, sf))


# ------------------------------------------------- F: sliced retention -------
def _sliced(spark, sf, by, what):
    act, counts = _cohort_tables(spark, sf)
    if what == "counts":
        return rt.cohort_size(counts, by)
    if what == "activity":
        return rt.cohort_active(act, by)
    return rt.retention(act, counts, by)


for _tag, _by in [("has_promo", ["has_promo_value"]), ("promo_value", ["promo_value"])]:
    for _what in ("counts", "activity", "retention"):
        query(f"cohort_{_what}_{_tag}")(
            lambda spark, sf, _b=_by, _w=_what: _sliced(spark, sf, _b, _w))


@query("retention_matrix")
def q_retention_matrix(spark, sf):
    return rt.retention_matrix(_sliced(spark, sf, [], "retention"), rt.periods_between(TEST_FIRST_MONTH, TEST_CUTOFF))


@query("retention_labels")
def q_retention_labels(spark, sf):
    ret = _sliced(spark, sf, ["promo_value"], "retention")
    return rt.retention_labels(ret, na_label="0").select(
        "cohort_id", "promo_value", "cohort_period", "retention_rate", "label")


for _facet in ("source", "has_promo_value", "promo_value"):
    _name = "activity_by_" + ("has_promo" if _facet == "has_promo_value" else _facet)
    query(_name)(lambda spark, sf, _f=_facet: rt.activity_by(_cohort_tables(spark, sf)[0], _f))


@query("stacked_bands")
def q_stacked_bands(spark, sf):
    return rt.stacked_bands(rt.activity_by(_cohort_tables(spark, sf)[0], "source"), "source")


@query("seed_rows")
def q_seed_rows(spark, sf):
    return rt.with_seed_rows(_cohort_tables(spark, sf)[0])


@query("area_series")
def q_area_series(spark, sf):
    return rt.area_series(_cohort_tables(spark, sf)[0]).orderBy("cohort_id", "order_month")


@query("churn")
def q_churn(spark, sf):
    return rt.churn(_sliced(spark, sf, [], "retention"))


# ------------------------------------------------ I: more slices -------------
@query("retention_by_state")
def q_retention_by_state(spark, sf):
    return rt.retention_by(cleaned(spark, sf), "state")


@query("retention_by_shop")
def q_retention_by_shop(spark, sf):
    return rt.retention_by(cleaned(spark, sf), "shops_id")


@query("retention_by_source")
def q_retention_by_source(spark, sf):
    return rt.retention_by(cleaned(spark, sf), "source")


@query("retention_by_hour")
def q_retention_by_hour(spark, sf):
    df = cleaned_events(spark, sf).withColumn(
        "hour", F.substring("date_purchased", 12, 2).try_cast("int"))
    return rt.retention_by(df, "hour")


@query("acquisition_growth")
def q_acquisition_growth(spark, sf):
    return rt.acquisition_growth(_cohort_tables(spark, sf)[1])


# ------------------------------------------------ G: chart statistics --------
@query("hist_orders_per_customer")
def q_hist_opc(spark, sf):
    return st.histogram(eda.orders_per_customer(cleaned(spark, sf)), "num_orders", HIST_BINS)


@query("hist_log_orders_per_customer")
def q_hist_log_opc(spark, sf):
    opc = eda.orders_per_customer(cleaned(spark, sf))
    return st.histogram(opc.withColumn("log_num_orders", F.ln("num_orders")), "log_num_orders",
                        HIST_BINS)


@query("hist_shop_revenue")
def q_hist_shop_revenue(spark, sf):
    return st.histogram(eda.revenue_by_shop(cleaned(spark, sf)), "rest_revenue", HIST_BINS)


def _daily(spark, sf):
    return (eda.count_by(cleaned(spark, sf), "order_date")
            .withColumn("day", F.unix_date("order_date").cast("bigint")))


@query("linear_fit")
def q_linear_fit(spark, sf):
    return st.linear_fit(_daily(spark, sf), "day", "orders")


@query("linear_fit_pvalues")
def q_linear_fit_pvalues(spark, sf):
    return st.linear_fit_pvalues(_daily(spark, sf), "day", "orders")


@query("grep_values")
def q_grep_values(spark, sf):
    return st.grep_values(cleaned(spark, sf), GREP_COL, GREP_PATTERN)


# ------------------------------------------------ H: table operators ---------
@query("filter_range")
def q_filter_range(spark, sf):
    return tb.filter_range(cleaned(spark, sf), RANGE_COL, RANGE_LO, RANGE_HI, full_range=RANGE_ENDS)


@query("filter_range_unknown_ends")
def q_filter_range_unknown_ends(spark, sf):
    """The same range where the slider's ends have to be found in the column."""
    return tb.filter_range(cleaned(spark, sf), RANGE_COL, RANGE_LO, RANGE_HI)


@query("filter_set")
def q_filter_set(spark, sf):
    return tb.filter_set(cleaned(spark, sf), SET_COL, SET_VALUES)


@query("filter_logical")
def q_filter_logical(spark, sf):
    return tb.filter_logical(cleaned(spark, sf), LOGICAL_COL, LOGICAL_CHOICES)


@query("search_text")
def q_search_text(spark, sf):
    return tb.search_text(cleaned(spark, sf), SEARCH_COL, SEARCH_WORDS)


@query("search_regex")
def q_search_regex(spark, sf):
    return tb.search_text(cleaned(spark, sf), REGEX_COL, REGEX_QUERY, regex=True)


@query("page")
def q_page(spark, sf):
    return tb.page(cleaned(spark, sf), ["order_id"], PAGE_K, PAGE_N)


@query("head_n")
def q_head_n(spark, sf):
    return eda.head_n(cleaned(spark, sf), HEAD_N, ["order_id"])


@query("keys_by_group")
def q_keys_by_group(spark, sf):
    return tb.keys_by_group(cleaned(spark, sf), GROUP_COL, GROUP_KEY, GROUP_CHOSEN)


def _key_sets(df):
    promo = df.filter(F.col("has_promo_value")).select("customer")
    region = tb.keys_by_group(df, GROUP_COL, GROUP_KEY, GROUP_CHOSEN)
    return promo, region


@query("linked_filter")
def q_linked_filter(spark, sf):
    df = cleaned(spark, sf)
    promo, region = _key_sets(df)
    return tb.linked_filter(df, "customer", [promo, None, region])


@query("columns_to_rows")
def q_columns_to_rows(spark, sf):
    ret = _sliced(spark, sf, [], "retention")
    # Column-major form: per cohort, arrays of periods and rates (bounded by the
    # number of months), then back to one row per position.
    packed = ret.groupBy("cohort_id").agg(
        F.array_sort(F.collect_list(F.struct("cohort_period", "retention_rate"))).alias("s"))
    packed = packed.select("cohort_id", F.col("s.cohort_period").alias("cohort_period"),
                           F.col("s.retention_rate").alias("retention_rate"))
    return tb.columns_to_rows(packed, ["cohort_period", "retention_rate"], keep=["cohort_id"])


@query("keyset_diff")
def q_keyset_diff(spark, sf):
    df = cleaned(spark, sf)
    promo, region = _key_sets(df)
    return tb.keyset_diff(promo, region, "customer")


# ------------------------------------------------ A: sources, sinks, preview --


@query("read_orders")
def q_read_orders(spark, sf):
    """Orders written as headed CSV to the shared folder, with the columns in
    another order and one more, read back by name and typed."""
    path = scratch_path(spark, "orders-csv")
    raw = raw_orders(spark, sf)
    src.write_orders_csv(raw.select(F.lit('a "quoted", note').alias("note"), *reversed(raw.columns)), path)
    return src.read_orders(spark, path)


@query("read_zip_lookup")
def q_read_zip_lookup(spark, sf):
    path = scratch_path(spark, "zips-csv")
    zips = lookup(spark, sf)
    zips.select("zip", F.lit(18.18).alias("lat"), F.lit(-66.75).alias("lng"), F.lit("Adjuntas").alias("city"), "state_id") \
        .write.mode("overwrite").options(header=True).csv(path)
    return src.read_zip_lookup(spark, path)


@query("write_corrected")
def q_write_corrected(spark, sf):
    """Cleaned table written as month-partitioned Parquet and read back."""
    path = scratch_path(spark, "corrected")
    src.write_corrected(cleaned(spark, sf), path)
    return src.read_corrected(spark, path)


@query("read_corrected")
def q_read_corrected(spark, sf):
    """The cohort stage on the saved table: load it, then overall retention."""
    path = scratch_path(spark, "corrected")
    src.write_corrected(cleaned(spark, sf), path)
    act, counts = co.cohort_tables(src.read_corrected(spark, path))
    return rt.retention(act, counts)


@query("schema_profile")
def q_schema_profile(spark, sf):
    return eda.schema_profile(cleaned(spark, sf))


@query("numeric_summary")
def q_numeric_summary(spark, sf):
    return qn.numeric_summary(raw_orders(spark, sf))


# ------------------------------------------------ G4 / G5: trends -------------


@query("trend_orders_by_date")
def q_trend_orders_by_date(spark, sf):
    s = eda.count_by(cleaned(spark, sf), "order_date").withColumn(
        "day", F.unix_date("order_date").cast("double"))
    return sm.loess_trend(s, "day", "orders").select("order_date", "orders", "trend")


@query("trend_orders_by_week")
def q_trend_orders_by_week(spark, sf):
    s = eda.count_by(cleaned(spark, sf), "order_week").withColumn(
        "day", F.unix_date("order_week").cast("double"))
    return sm.loess_trend(s, "day", "orders").select("order_week", "orders", "trend")


# ------------------------------------------------ options of E2 / F3 / C3 -----
@query("customer_cohort_first")
def q_customer_cohort_first(spark, sf):
    """E2 with ``ties='first'``: one first order per customer (lowest order_id)."""
    return co.customer_cohort(cleaned(spark, sf), ties="first")


@query("cohort_retention_all_first")
def q_cohort_retention_all_first(spark, sf):
    act, counts = co.cohort_tables(cleaned(spark, sf), ties="first")
    return rt.retention(act, counts)


@query("orders_by_week_monday")
def q_orders_by_week_monday(spark, sf):
    df = cl.with_dates(cleaned(spark, sf).drop("order_date", "order_month", "order_week"),
                       week_start="monday")
    return eda.count_by(df, "order_week").orderBy("order_week")


@query("read_corrected_bucketed")
def q_read_corrected_bucketed(spark, sf):
    """The cohort stage on the saved table bucketed by (customer, instant):
    the join back to the first-order rows reads the orders without a shuffle."""
    table = f"retentio_corrected_{uuid.uuid4().hex[:12]}"
    src.save_corrected_table(cleaned(spark, sf), table, scratch_path(spark, "bucketed"))
    act, counts = co.cohort_tables(spark.table(table))
    return rt.retention(act, counts)


# ------------------------------------------------ options of G1 / G3; segments --
@query("hist_orders_per_customer_ggplot")
def q_hist_orders_per_customer_ggplot(spark, sf):
    """G1 with the plotting library's default bins."""
    return st.histogram(eda.orders_per_customer(cleaned(spark, sf)), "num_orders", HIST_BINS, "ggplot")


@query("hist_shop_revenue_ggplot")
def q_hist_shop_revenue_ggplot(spark, sf):
    return st.histogram(eda.revenue_by_shop(cleaned(spark, sf)), "rest_revenue", HIST_BINS, "ggplot")


@query("audience_segments")
def q_audience_segments(spark, sf):
    """Customers by last active period, months active, active or lapsed."""
    return rt.audience_segments(cleaned(spark, sf))


@query("page_after")
def q_page_after(spark, sf):
    """H5 by key: the page behind the last row of page 1 (rows 16 to 23)."""
    df = cleaned(spark, sf)
    last = tb.page(df, ["order_id"], PAGE_K - 1, PAGE_N).agg(F.max("order_id")).head()[0]
    return tb.page_after(df, ["order_id"], (last,), PAGE_N)


# ------------------------------------------------ F18 / I4: survival ---------
def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 9) for c in cols})


def _life_table(spark, sf, by):
    return sv.life_table(sv.spell_counts(sv.first_lifetimes(cleaned(spark, sf), by, lapse=LAPSE_MONTHS), by), by)


@query("customer_spells")
def q_customer_spells(spark, sf):
    return sv.customer_spells(cleaned(spark, sf), lapse=LAPSE_MONTHS)


@query("survival_all")
def q_survival_all(spark, sf):
    return _rounded(_life_table(spark, sf, []), "survival", "std_err")


@query("survival_by_source")
def q_survival_by_source(spark, sf):
    return _rounded(_life_table(spark, sf, ["source"]), "survival", "std_err")


@query("lifetime_by_source")
def q_lifetime_by_source(spark, sf):
    table = _life_table(spark, sf, ["source"])
    return _rounded(sv.lifetime_summary(table, ["source"], LIFETIME_HORIZON), "mean_lifetime")


@query("lifetime_by_shop")
def q_lifetime_by_shop(spark, sf):
    table = _life_table(spark, sf, ["shops_id"])
    return _rounded(sv.lifetime_summary(table, ["shops_id"], LIFETIME_HORIZON), "mean_lifetime")


@query("logrank_by_source")
def q_logrank_by_source(spark, sf):
    return _rounded(sv.log_rank(_life_table(spark, sf, ["source"]), ["source"]), "expected", "variance", "chi_squared", "p_value")


# ------------------------------------------------ 2.10: all slices at once ---
@query("cohort_counts_slices")
def q_cohort_counts_slices(spark, sf):
    return sl.slice_counts(_cohort_tables(spark, sf)[1], SLICES)


@query("cohort_activity_slices")
def q_cohort_activity_slices(spark, sf):
    return sl.slice_activity(_cohort_tables(spark, sf)[0], SLICES)


@query("cohort_retention_slices")
def q_cohort_retention_slices(spark, sf):
    act, counts = _cohort_tables(spark, sf)
    return sl.slice_retention(act, counts, SLICES)


# ------------------------------------------------ I1 / I2: ranked slices -----
@query("ranked_shops")
def q_ranked_shops(spark, sf):
    act, counts = co.cohort_tables(cleaned(spark, sf), ["shops_id"])
    return _rounded(sl.best_slices(sl.slice_rates(act, counts, ["shops_id"], RANK_PERIOD), ["shops_id"], RANK_K), "rate", "lower", "upper")


@query("ranked_shops_by_state")
def q_ranked_shops_by_state(spark, sf):
    by = ["state", "shops_id"]
    act, counts = co.cohort_tables(cleaned(spark, sf), by)
    return _rounded(sl.best_slices(sl.slice_rates(act, counts, by, RANK_PERIOD), by, RANK_K_WITHIN, ["state"]), "rate", "lower", "upper")


# ------------------------------------------------ I3: association ------------
@query("association_with_return")
def q_association_with_return(spark, sf):
    df = cleaned(spark, sf).withColumn("hour", F.substring("date_purchased", 12, 2).try_cast("int"))
    rows = sl.customer_outcome(df, ASSOCIATED, RETURN_WITHIN)
    return _rounded(sl.association(sl.contingency(rows, "returned", ASSOCIATED)), "chi_squared", "p_value", "cramers_v")


# ------------------------------------------------ H6 / H7 / H9: bitmaps ------
def _stored(df, name):
    """Written to the shared folder and read back, as a stored table is."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bitmap_sets(df):
    promo = bm.key_bitmap(df.filter(F.col("has_promo_value")).select("customer"))
    return promo, bm.union_of(_stored(bm.group_bitmaps(df, GROUP_COL, GROUP_KEY), "group-bitmaps"), GROUP_COL, GROUP_CHOSEN)


@query("keys_by_group_bitmaps")
def q_keys_by_group_bitmaps(spark, sf):
    return bm.keys_of(_bitmap_sets(cleaned(spark, sf))[1], GROUP_KEY)


@query("key_counts_bitmaps")
def q_key_counts_bitmaps(spark, sf):
    """Distinct customers per state from the stored bitmaps."""
    return bm.key_count(_stored(bm.group_bitmaps(cleaned(spark, sf), GROUP_COL, GROUP_KEY), "group-bitmaps"), [GROUP_COL])


@query("linked_filter_bitmaps")
def q_linked_filter_bitmaps(spark, sf):
    df = cleaned(spark, sf)
    promo, region = _bitmap_sets(df)
    return bm.linked_filter_bitmaps(df, "customer", [promo, None, region])


@query("keyset_diff_bitmaps")
def q_keyset_diff_bitmaps(spark, sf):
    promo, region = _bitmap_sets(cleaned(spark, sf))
    return bm.keyset_diff_bitmaps(promo, region, "customer")


# ------------------------------------------------ D1 / D2 / A7: sketches -----
def _close(estimate, exact, scale, lg_k):
    return F.abs(estimate - exact) <= SKETCH_ERRORS * sk.relative_error(lg_k) * scale


@query("active_by_quarter_sketch")
def q_active_by_quarter_sketch(spark, sf):
    """Customers per quarter from stored sketches, beside the exact count."""
    df = cleaned(spark, sf)
    stored = _stored(sk.activity_sketches(df, SKETCH_LG_K), "activity-sketches")
    quarter = F.trunc("order_month", "quarter")
    exact = df.groupBy(quarter.alias("quarter")).agg(F.count_distinct("customer").alias("customers"))
    got = sk.active_in_each(stored, quarter, SKETCH_LG_K).select(F.col("bucket"), F.theta_sketch_estimate("customers").alias("estimate"))
    return exact.join(got, F.col("quarter") == F.col("bucket"), "left").select(
        "quarter", "customers", F.coalesce(_close(F.col("estimate"), F.col("customers"), F.col("customers"), SKETCH_LG_K), F.lit(False)).alias("estimate_ok"))


@query("active_in_both_sketch")
def q_active_in_both_sketch(spark, sf):
    """Customers active in two ranges of months, by intersection of stored sketches."""
    df = cleaned(spark, sf)
    est = sk.active_in_both(_stored(sk.activity_sketches(df, SKETCH_LG_K), "activity-sketches"), RANGE_ONE, RANGE_TWO, lg_k=SKETCH_LG_K)
    inside = [F.max(F.col("order_month").between(F.lit(a).cast("date"), F.lit(b).cast("date"))) for a, b in (RANGE_ONE, RANGE_TWO)]
    per = df.groupBy("customer").agg(inside[0].alias("one"), inside[1].alias("two"))
    exact = per.agg(F.count_if("one").alias("exact_first"), F.count_if("two").alias("exact_second"),
                    F.count_if(F.col("one") & F.col("two")).alias("exact_both"), F.count_if(F.col("one") | F.col("two")).alias("either"))
    ok = [_close(F.col(c), F.col(f"exact_{c}"), F.col("either"), SKETCH_LG_K) for c in ("first", "second", "both")]
    return exact.join(est, F.lit(True)).select("exact_first", "exact_second", "exact_both", (ok[0] & ok[1] & ok[2]).alias("estimate_ok"))


@query("quantiles_by_year_sketch")
def q_quantiles_by_year_sketch(spark, sf):
    """Quartiles of a year merged from monthly sketches, with their true rank checked."""
    df = cleaned(spark, sf).withColumn("year", F.year("order_month"))
    stored = _stored(sk.quantile_sketches(df, QUANTILE_COLUMNS), "quantile-sketches").withColumn("year", F.year("order_month"))
    got = sk.rank_range(df, sk.merged_quantiles(stored, QUANTILES, ["year"]), QUANTILE_COLUMNS, ["year"])
    ok = (F.col("below") - RANK_ERROR <= F.col("probability")) & (F.col("probability") <= F.col("up_to") + RANK_ERROR)
    return got.select("year", "column_name", "probability", "n", ok.alias("rank_ok"))


# ------------------------------------------------ A3 / B5: late orders -------
def two_loads(df):
    """All orders as two loads.  The first has every order that is not pending,
    open ones still a month early and without a payment method; the second
    brings the pending orders and the open ones as they are."""
    open_, pending = F.col("shipping_type") == "O", F.col("shipping_type") == "P"
    day = F.when(open_, F.add_months("order_date", -1)).otherwise(F.col("order_date"))
    first = df.filter(~pending).withColumns({
        "order_date": day, "order_month": F.trunc(day, "month"), "order_week": F.date_sub(day, F.dayofweek(day) - 1),
        "payment_method": F.when(~open_, F.col("payment_method")), "version": F.lit(1).cast("bigint")})
    return first, df.filter(pending | open_).withColumn("version", F.lit(2).cast("bigint"))


@query("upsert_corrected")
def q_upsert_corrected(spark, sf):
    """The saved table after a first load, a second one with late and corrected
    orders, and a replay of both: the newest version of every order."""
    first, second = two_loads(_stored(cleaned(spark, sf), "cleaned"))
    path = scratch_path(spark, "versioned")
    up.write_versioned(first, path)
    for load in (second, second, first):
        up.upsert_corrected(spark, path, load)
    return up.read_versioned(spark, path)


# ------------------------------------------------ I5: growth to a target -----
@query("growth_forecast")
def q_growth_forecast(spark, sf):
    size = rt.cohort_size(_cohort_tables(spark, sf)[1])
    out = fc.growth_forecast(fc.monthly_series(size, "cohort_id", "cohort_count"), TARGET_CUSTOMERS)
    return _rounded(out, "level", "trend", "error")


@query("growth_forecast_by_source")
def q_growth_forecast_by_source(spark, sf):
    size = rt.cohort_size(_cohort_tables(spark, sf)[1], ["source"])
    out = fc.growth_forecast(fc.monthly_series(size, "cohort_id", "cohort_count", ["source"]), TARGET_CUSTOMERS / 10)
    return _rounded(out, "level", "trend", "error")


# ------------------------------------------------ A5 / A7: heavy values ------
@query("heavy_hitters")
def q_heavy_hitters(spark, sf):
    return _rounded(hv.heavy_hitters(cleaned(spark, sf), HEAVY_COLUMNS, HEAVY_K), "share")


# ------------------------------------------------ H4: search by postings -----
def _searched_postings(spark, sf, col, query_text):
    df, path = cleaned(spark, sf), scratch_path(spark, "postings")
    po.write_postings(df, "order_id", col, path)
    return po.search_postings(df, "order_id", col, query_text, path)


@query("search_text_postings")
def q_search_text_postings(spark, sf):
    return _searched_postings(spark, sf, SEARCH_COL, SEARCH_WORDS)


@query("search_date_postings")
def q_search_date_postings(spark, sf):
    """Orders of the first day of any month in 1996, by two parts of the date's text."""
    return _searched_postings(spark, sf, "date_purchased", "1996- -01T0")
