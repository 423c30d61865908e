"""Training-data operators: sharding, chat formatting, filters, dedup, mixing,
search and packing.  Nothing else in the library imports this subpackage."""
