"""Date predicates written so that Parquet and partition filters can use them.

Bounds are computed in Python and compared with the bare column: wrapping the
column (``date_trunc(col) = ...``) would stop the predicate reaching the scan.
Date literals compare with both TIMESTAMP and TIMESTAMP_NTZ columns without a
cast on the column side.
"""

from __future__ import annotations

import calendar
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

START = "line_item_usage_start_date"


def shift_months(day: date, months: int) -> date:
    """Same day ``months`` later, clamped to the month's last day."""
    index = day.year * 12 + day.month - 1 + months
    year, month = divmod(index, 12)
    last = calendar.monthrange(year, month + 1)[1]
    return date(year, month + 1, min(day.day, last))


def month_start(day: date) -> date:
    return day.replace(day=1)


def parse_period(period: str) -> date:
    """``YYYY-MM`` -> first day of that month."""
    year, month = period.split("-")
    return date(int(year), int(month), 1)


def in_month(as_of: date, column: str | Column = START, offset: int = 0) -> Column:
    """Rows of the calendar month of ``as_of`` (shifted by ``offset`` months)."""
    first = shift_months(month_start(as_of), offset)
    return in_range(column, first, shift_months(first, 1))


def in_range(column: str | Column, start: date, stop: date) -> Column:
    """Half-open ``[start, stop)``."""
    c = F.col(column) if isinstance(column, str) else column
    return (c >= F.lit(start)) & (c < F.lit(stop))


def since_months(as_of: date, months: int, column: str | Column = START) -> Column:
    """Rows starting on or after ``as_of`` minus ``months``; no upper bound."""
    c = F.col(column) if isinstance(column, str) else column
    return c >= F.lit(shift_months(as_of, -months))


def since_days(as_of: date, days: int, column: str | Column = START) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return c >= F.lit(as_of - timedelta(days=days))


def month_of(column: str = START) -> Column:
    return F.trunc(F.col(column), "month")


def day_of(column: str = START) -> Column:
    return F.to_date(F.col(column))
