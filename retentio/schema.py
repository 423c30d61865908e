"""Explicit schemas; nothing here is ever inferred from the data."""

from pyspark.sql import types as T

ORDERS_SCHEMA = T.StructType([
    T.StructField("order_id", T.LongType()),
    T.StructField("source", T.StringType()),
    T.StructField("date_purchased", T.StringType()),
    T.StructField("shipping_type", T.StringType()),
    T.StructField("payment_method", T.StringType()),
    T.StructField("promo_value", T.IntegerType()),
    T.StructField("restaurant_total", T.DoubleType()),
    T.StructField("customer", T.LongType()),
    T.StructField("shops_id", T.LongType()),
    T.StructField("state", T.StringType()),
    T.StructField("postal_code", T.IntegerType()),
])

ZIP_SCHEMA = T.StructType([
    T.StructField("zip", T.IntegerType()),
    T.StructField("state_id", T.StringType()),
])

ORDER_COLUMNS = [f.name for f in ORDERS_SCHEMA.fields]
CORRECTED_SCHEMA = T.StructType([
    *ORDERS_SCHEMA.fields,
    T.StructField("order_date", T.DateType()),
    T.StructField("order_week", T.DateType()),
    T.StructField("has_promo_value", T.BooleanType()),
    T.StructField("order_month", T.DateType()),  # the partition column comes last
])

# Attributes of the first order that the cohort stage carries per customer.
FIRST_ORDER_ATTRS = ["source", "has_promo_value", "promo_value"]
