"""Row predicates over billing line items."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from costspark.functions.dates import START, in_month, parse_period, since_months
from costspark.functions.tags import tag_value

COST = "line_item_unblended_cost"


def positive_cost() -> Column:
    return F.col(COST) > 0


def _all(conditions: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def base_filter(
    billing_period: str | None = None,
    payer_account_id: str | None = None,
    linked_account_id: str | None = None,
    service_codes: Sequence[str] | None = None,
    min_cost: float = 0.0,
) -> Column:
    """Cost above ``min_cost`` and every given restriction (``billing_period`` is YYYY-MM)."""
    parts = [F.col(COST) > min_cost]
    if billing_period:
        parts.append(in_month(parse_period(billing_period)))
    if payer_account_id:
        parts.append(F.col("bill_payer_account_id") == payer_account_id)
    if linked_account_id:
        parts.append(F.col("line_item_usage_account_id") == linked_account_id)
    if service_codes:
        parts.append(F.col("product_servicecode").isin(list(service_codes)))
    return _all(parts)


def date_filter(
    start: date | datetime | None = None,
    end: date | datetime | None = None,
    last_n_months: int | None = None,
    as_of: date | None = None,
) -> Column:
    """``last_n_months`` (relative to ``as_of``) wins over inclusive ``[start, end]``."""
    if last_n_months:
        if as_of is None:
            raise ValueError("last_n_months needs as_of")
        return since_months(as_of, last_n_months)
    parts = []
    if start is not None:
        parts.append(F.col(START) >= F.lit(start))
    if end is not None:
        parts.append(F.col(START) <= F.lit(end))
    return _all(parts)


def kpi_filter(
    billing_period: str | None = None,
    payer_account_id: str | None = None,
    linked_account_id: str | None = None,
    tags: Mapping[str, str] | None = None,
) -> Column:
    """KPI restrictions as predicates on the source columns, before aggregation."""
    parts = []
    if billing_period:
        parts.append(in_month(parse_period(billing_period), "bill_billing_period_start_date"))
    if payer_account_id:
        parts.append(F.col("bill_payer_account_id") == payer_account_id)
    if linked_account_id:
        parts.append(F.col("line_item_usage_account_id") == linked_account_id)
    for key, value in (tags or {}).items():
        parts.append(tag_value(key) == value)
    return _all(parts)
