"""Column-level helpers built only from ``pyspark.sql.functions``."""

from retentio.functions.dates import (  # noqa: F401
    cohort_period, order_date, order_month, order_week, previous_month,
)
from retentio.functions.nulls import (  # noqa: F401
    is_missing, na_max, na_min, na_sum,
)
from retentio.functions.labels import percent_label  # noqa: F401
