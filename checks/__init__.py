"""Registered queries and the SQL that checks them."""

from checks import (  # noqa: F401
    price_checks,
    rollup_checks,
    saving_checks,
    source_checks,
    spend_checks,
    stream_checks,
    trend_checks,
)
from checks.base import ORACLE, QUERIES  # noqa: F401
