"""Readers and writers for the orders table, its lookup and the corrected table."""

from retentio.sources.files import (  # noqa: F401
    read_corrected, read_orders, read_zip_lookup, save_corrected_table, write_corrected,
    write_orders_csv,
)
from retentio.sources.tables import events_orders_view, orders_view, zip_lookup_view  # noqa: F401
