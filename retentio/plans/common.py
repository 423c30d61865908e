"""Inputs shared by the registered queries: the cleaned orders of a test scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from retentio.operators.clean import clean_orders
from retentio.sources.tables import (
    PAYMENT_SENTINEL, TEST_CUTOFF, events_orders_view, orders_view, zip_lookup_view,
)


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_view(spark, sf_dir)


def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zip_lookup_view(spark, sf_dir)


def cleaned(spark: SparkSession, sf_dir: str, repair_sentinel: bool = True) -> DataFrame:
    return clean_orders(raw_orders(spark, sf_dir), lookup(spark, sf_dir), TEST_CUTOFF,
                        sentinel=PAYMENT_SENTINEL, repair_sentinel=repair_sentinel)


def cleaned_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table run through the same cleaning stage (no trim)."""
    return clean_orders(events_orders_view(spark, sf_dir), lookup(spark, sf_dir), None,
                        sentinel=None)


def after_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows left after dropping missing dates and customers."""
    from retentio.operators.clean import drop_missing
    return drop_missing(raw_orders(spark, sf_dir), "date_purchased", "customer")


def dated_untrimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imputed rows with date columns, before the trim."""
    from retentio.operators.clean import impute_missing, with_dates
    df = impute_missing(after_missing(spark, sf_dir), lookup(spark, sf_dir),
                        "postal_code", "zip", "state", "state_id")
    return with_dates(df)
