"""One set of column names for billing exports that arrive under several."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costspark.functions.tags import parse_tags

# Canonical name <- names it may arrive under.
ALIASES = {
    "bill_payer_account_id": ("payer_account_id",),
    "line_item_usage_account_id": ("linked_account_id",),
    "product_region": ("product_region_code", "product_location_code"),
    "product_region_code": ("product_region",),
    "line_item_unblended_cost": ("unblended_cost",),
    "line_item_usage_amount": ("usage_quantity",),
    "reservation_reservation_a_r_n": ("reservation_arn",),
    "bill_billing_period_start_date": ("billing_period_start_date",),
}
MAP_COLUMNS = ("product", "cost_category", "resource_tags")


def normalize_cur(df: DataFrame) -> DataFrame:
    """Canonical names, alias columns coalesced, map columns as maps.

    A column that arrives under both its canonical name and an alias takes the
    first non-null value.  A projection only: filters and pruning pass through.
    """
    present = set(df.columns)
    out = {}
    for name, aliases in ALIASES.items():
        sources = [c for c in (name, *aliases) if c in present]
        if sources == [name] or not sources:
            continue
        out[name] = F.coalesce(*map(F.col, sources)) if len(sources) > 1 else F.col(sources[0])
    for name in MAP_COLUMNS:
        if name in present and isinstance(df.schema[name].dataType, T.StringType):
            out[name] = parse_tags(F.col(name))
    return df.withColumns(out) if out else df
