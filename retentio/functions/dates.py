"""Date bucketing used by the cleaning and cohort stages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def order_date(iso_text: str | Column) -> Column:
    """Calendar date of an ISO-8601 timestamp text, taken from the text itself.

    The date part is cut from the text and cast directly, so no session time
    zone can move it; unparsable text, and a year or month alone, gives NULL
    instead of an error.
    """
    text = F.substring(_c(iso_text), 1, 10)
    return F.when(text.like("____-_%-_%"), text.try_cast("date"))


def order_month(date: str | Column) -> Column:
    """First day of the month."""
    return F.trunc(_c(date), "month")


def order_week(date: str | Column, week_start: str = "sunday") -> Column:
    """First day of the week; weeks start on Sunday unless ``week_start='monday'``."""
    d = _c(date)
    if week_start == "monday":
        return F.trunc(d, "week")
    if week_start != "sunday":
        raise ValueError("week_start must be 'sunday' or 'monday'")
    return F.date_sub(d, F.dayofweek(d) - 1)


def cohort_period(cohort_id: str | Column, month: str | Column) -> Column:
    """Whole months from the cohort month to the order month, plus one.

    Both inputs are month starts, so the calendar difference is exact; the
    month before the cohort gives 0.
    """
    c, m = _c(cohort_id), _c(month)
    return ((F.year(m) - F.year(c)) * 12 + F.month(m) - F.month(c) + 1).cast("bigint")


def previous_month(date: str | Column) -> Column:
    return F.add_months(_c(date), -1)
