"""Incremental cohort state with Structured Streaming.

The reference has no streaming part.  Cohort assignment depends on each
customer's first order over all time, so each micro-batch writes a small
per-customer delta (first purchase, cohort month, tied first-order
attributes, active months) and the cohort tables are folded from the deltas
(and compacted bases) instead of being recomputed from all history.
"""

from retentio.streaming.incremental import CohortState, start_cohort_stream  # noqa: F401
