"""Ratios that never raise under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _c(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def ratio(part: str | Column, whole: str | Column) -> Column:
    """``part / whole``; NULL when ``whole`` is 0 or NULL."""
    return F.try_divide(_c(part), _c(whole))


def cents(value: str | Column) -> Column:
    """Money to two places.

    Six places first: an amount such as 10.005 that carries summation noise in
    its last bits would otherwise round by the order in which rows arrived.
    """
    return F.round(F.round(_c(value), 6), 2)


def percent(part: str | Column, whole: str | Column, digits: int | None = 2) -> Column:
    value = ratio(part, whole) * 100
    return value if digits is None else F.round(value, digits)


def change_percent(now: str | Column, before: str | Column, digits: int | None = 2) -> Column:
    """Relative change in percent; NULL unless ``before`` is positive."""
    now, before = _c(now), _c(before)
    value = F.try_divide(now - before, before) * 100
    if digits is not None:
        value = F.round(value, digits)
    return F.when(before > 0, value)


def with_share(groups: DataFrame, value: str, name: str, digits: int | None = 2) -> DataFrame:
    """Add each group's percentage of the total of ``value``.

    For already aggregated frames whose row count the provider's catalogue
    bounds (regions, services): the total is a window over those few rows, so
    the facts are scanned once.  Frames that may grow with the data (accounts,
    resources) divide by a scalar subquery instead.
    """
    return groups.withColumn(name, percent(value, F.sum(value).over(Window.partitionBy()), digits))


def clean_floats(df: DataFrame) -> DataFrame:
    """Turn NaN and infinities of float columns into NULL."""
    def cleaned(field):
        c = F.col(f"`{field.name}`")
        if field.dataType.typeName() not in ("double", "float"):
            return c
        bad = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
        return F.when(~bad, c).alias(field.name)

    return df.select([cleaned(f) for f in df.schema.fields])
