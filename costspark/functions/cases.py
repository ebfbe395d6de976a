"""CASE columns from lists of branches."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(branches: Iterable[tuple[Column, object]], default: object = None) -> Column:
    """Value of the first true branch, else ``default``."""
    case: Column | None = None
    for condition, value in branches:
        case = F.when(condition, value) if case is None else case.when(condition, value)
    if case is None:
        return F.lit(default)
    return case if default is None else case.otherwise(default)
