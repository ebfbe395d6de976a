"""Row limits of listings."""

from __future__ import annotations

from pyspark.sql import DataFrame


def in_order(df: DataFrame, ordered: bool, *columns) -> DataFrame:
    """Sorted for a reader; left as it is for a write, which a global sort only costs a pass."""
    return df.orderBy(*columns) if ordered else df


def first_rows(df: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` rows of an ordered listing; all of them for None.

    A limit belongs to the listing: totals, counts and forecasts take the frame without one.
    """
    return df if limit is None else df.limit(limit)
