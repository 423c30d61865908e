"""Views that give the driver's TPC-H style tables the shape of an orders table.

The test tables have no food-ordering data, so ``orders_view`` maps
``orders`` / ``customer`` / ``nation`` / ``lineitem`` onto the reference's
orders schema and mixes in the kinds of dirt the reference cleans (missing
dates and customers, missing states with and without a postal-code match,
the ``'/'`` payment sentinel, a few promo codes).  The dirt is a fixed
function of ``o_orderkey``; every row of every table is kept.

``zip_lookup_view`` is the postal-code lookup over ``nation``.
``events_orders_view`` maps the ``events`` table onto the same schema; its
timestamps carry real hours of the day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the adapter: which order keys carry which kind of dirt.
DIRT_MISSING_DATE_EVERY = 997
DIRT_SENTINEL_EVERY = 97
DIRT_PROMO_EVERY = 25
DIRT_MISSING_CUSTOMER_EVERY = 1999
DIRT_MISSING_STATE_EVERY = 701
DIRT_UNMATCHED_POSTAL_EVERY = 1402
PAYMENT_SENTINEL = "/"
# The test orders end on 2001-08-01, a partial month; the cleaning stage keeps
# dates before it, as the reference trims its partial last month.
TEST_CUTOFF = "2001-08-01"

ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"

# Schemas of the driver's tables, given explicitly so no read infers them.
TABLE_SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
              "value double, props string",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    if name in TABLE_SCHEMAS:
        return spark.read.schema(TABLE_SCHEMAS[name]).parquet(path)
    return spark.read.parquet(path)


def orders_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    c = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    # One shop per order: the lowest supplier among its line items.  Partial
    # aggregation collapses the line items map-side before the shuffle.
    shops = (_table(spark, sf_dir, "lineitem")
             .groupBy("l_orderkey").agg(F.min("l_suppkey").alias("shops_id")))
    joined = (o.join(c, o.o_custkey == c.c_custkey, "left")
               .join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
               .join(shops, F.col("o_orderkey") == F.col("l_orderkey"), "left"))
    # One projection of SQL expressions: the dirt is a fixed function of the key.
    return joined.selectExpr(
        "o_orderkey AS order_id",
        "o_orderpriority AS source",
        f"CASE WHEN o_orderkey % {DIRT_MISSING_DATE_EVERY} = 0 THEN '' "
        f"ELSE date_format(o_orderdate, \"{ISO_FORMAT}\") END AS date_purchased",
        "o_orderstatus AS shipping_type",
        f"CASE WHEN o_orderkey % {DIRT_SENTINEL_EVERY} = 0 THEN '{PAYMENT_SENTINEL}' "
        "ELSE c_mktsegment END AS payment_method",
        f"CAST(CASE WHEN o_orderkey % {DIRT_PROMO_EVERY} = 0 "
        f"THEN 1 + floor(o_orderkey / {DIRT_PROMO_EVERY}) % 5 ELSE 0 END AS INT) AS promo_value",
        "o_totalprice AS restaurant_total",
        f"CASE WHEN o_orderkey % {DIRT_MISSING_CUSTOMER_EVERY} = 0 THEN CAST(NULL AS BIGINT) "
        "ELSE o_custkey END AS customer",
        "CAST(shops_id AS BIGINT) AS shops_id",
        f"CASE WHEN o_orderkey % {DIRT_MISSING_STATE_EVERY} = 0 THEN '' ELSE n_name END AS state",
        f"CASE WHEN o_orderkey % {DIRT_UNMATCHED_POSTAL_EVERY} = 0 THEN -1 "
        "ELSE CAST(c_nationkey AS INT) END AS postal_code",
    )


def zip_lookup_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").cast("int").alias("zip"),
                    F.col("n_name").alias("state_id"))


def events_orders_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as orders: one event is one order by ``user_id``.

    ``event_type`` plays the acquisition channel, ``value`` the order total,
    and the timestamp text keeps its time of day.
    """
    e = _table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("order_id"),
        F.col("event_type").alias("source"),
        F.date_format("ts", ISO_FORMAT).alias("date_purchased"),
        F.lit("Delivery").alias("shipping_type"),
        F.lit("credit").alias("payment_method"),
        F.lit(0).cast("int").alias("promo_value"),
        F.col("value").alias("restaurant_total"),
        F.col("user_id").alias("customer"),
        F.lit(None).cast("bigint").alias("shops_id"),
        F.lit("NA_STATE").alias("state"),
        F.lit(0).cast("int").alias("postal_code"),
    )
