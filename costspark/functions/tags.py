"""Resource tags kept as ``map<string,string>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TAGS = "resource_tags"

# A tag key may carry the provider's "user:" prefix.
KEY_PREFIXES = ("", "user:")


def tag_value(key: str, column: str = TAGS) -> Column:
    """Value of a tag, with or without the ``user:`` prefix; NULL when absent."""
    return F.coalesce(*[F.try_element_at(F.col(column), F.lit(p + key)) for p in KEY_PREFIXES])


def has_tag(key: str, column: str = TAGS) -> Column:
    found = F.lit(False)
    for p in KEY_PREFIXES:
        found = found | F.map_contains_key(F.col(column), p + key)
    return found


def parse_tags(column: Column) -> Column:
    """JSON text -> map; empty text and broken JSON give NULL."""
    return F.from_json(F.nullif(F.trim(column), F.lit("")), "map<string,string>")


def tagging_status(
    column: str = TAGS, required: tuple[str, str] = ("Environment", "Team")
) -> Column:
    """untagged / fully_tagged / partially_tagged / custom_tagged."""
    first, second = (has_tag(k, column) for k in required)
    empty = F.col(column).isNull() | (F.size(F.col(column)) == 0)
    return (
        F.when(empty, "untagged")
        .when(first & second, "fully_tagged")
        .when(first | second, "partially_tagged")
        .otherwise("custom_tagged")
    )
