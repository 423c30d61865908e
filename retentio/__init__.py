"""retentio: customer cohort and retention analytics on Spark DataFrames.

Layout
------
``sources``    readers / writers for the orders table and its lookups
``functions``  Column-level helpers (missing values, dates, labels)
``operators``  DataFrame -> DataFrame operators (cleaning, EDA, cohorts,
               retention, statistics, table filters)
``plans``      the registered queries and their DuckDB oracle SQL
``streaming``  incremental refresh of the cohort tables
"""

__version__ = "0.1.0"
