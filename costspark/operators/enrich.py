"""Declared joins of billing rows with other tables, and account roll-ups."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costspark.functions.top import first_rows


@dataclass(frozen=True)
class Enrichment:
    """How a table joins a base table; the keys together name one row of it."""

    table_id: str
    name: str
    keys: tuple[tuple[str, str], ...]
    confidence: str
    category: str


# Joinable tables per base table.
ENRICHMENTS = {
    "CUR": (
        Enrichment(
            "invoice_summaries",
            "INVOICE_SUMMARIES",
            (("bill_invoice_id", "InvoiceId"), ("line_item_usage_account_id", "AccountId")),
            "high",
            "billing",
        ),
        Enrichment(
            "ec2_pricing",
            "EC2_PRICING",
            (
                ("product_instance_type", "InstanceType"),
                ("product_region", "Region"),
                ("product_operating_system", "OperatingSystem"),
                ("product_tenancy", "Tenancy"),
            ),
            "high",
            "pricing",
        ),
        Enrichment(
            "savings_plans",
            "SAVINGS_PLANS",
            (("line_item_usage_account_id", "AccountId"), ("product_region", "Region")),
            "medium",
            "pricing",
        ),
    ),
    "FOCUS": (
        Enrichment(
            "invoice_summaries",
            "INVOICE_SUMMARIES",
            (("InvoiceId", "InvoiceId"), ("BillingAccountId", "BillingAccountId")),
            "high",
            "billing",
        ),
    ),
}


def enrichment_catalog(spark: SparkSession) -> DataFrame:
    """One row per base table, joinable table and declared key."""
    rows = [
        (base, e.table_id, e.name, i, source, target, e.confidence, e.category)
        for base, tables in ENRICHMENTS.items()
        for e in tables
        for i, (source, target) in enumerate(e.keys, start=1)
    ]
    return spark.createDataFrame(
        rows,
        "base_table string, table_id string, name string, priority int, source_column string, "
        "target_column string, confidence string, category string",
    )


def enrich(
    facts: DataFrame,
    tables: Mapping[str, DataFrame],
    *table_ids: str,
    base: str = "CUR",
    full_key: bool = True,
) -> DataFrame:
    """Left-join the named tables; their columns arrive as ``<table_id>_<column>``.

    All declared keys are used; a table that is unique on them (``repeated_keys``
    tells) leaves the number of facts as it is.  ``full_key=False`` joins on the
    first key alone, as the original does: a table with several rows for it
    multiplies the facts.  Join strategy is left to table sizes and to adaptive
    skew handling; facts and tables saved by ``sinks.save_bucketed`` on the declared keys join
    without a shuffle.
    """
    known = {e.table_id: e for e in ENRICHMENTS[base.upper()]}
    unknown = [t for t in table_ids if t not in known]
    if unknown:
        raise ValueError(f"unknown tables {unknown}; available: {sorted(known)}")
    out = facts
    for table_id in table_ids:
        keys = known[table_id].keys if full_key else known[table_id].keys[:1]
        other = tables[table_id]
        other = other.select([F.col(c).alias(f"{table_id}_{c}") for c in other.columns])
        condition = F.lit(True)
        for source, target in keys:
            condition = condition & (F.col(source) == F.col(f"{table_id}_{target}"))
        out = out.join(other, condition, "left")
    return out


def repeated_keys(table: DataFrame, table_id: str, base: str = "CUR") -> DataFrame:
    """Keys of a joinable table that more than one of its rows has: none if it is unique."""
    (known,) = (e for e in ENRICHMENTS[base.upper()] if e.table_id == table_id)
    return table.groupBy([target for _, target in known.keys]).agg(F.count("*").alias("rows")).filter("rows > 1")


def account_rollup(
    accounts: DataFrame, summary: DataFrame, limit: int | None = 10
) -> DataFrame:
    """Accounts (account_id, account_name) with cost, lines and usage of a summary view.

    The summary is added up per account before it meets the accounts.  An
    account without rows shows one line and no cost, as COUNT(*) over the left
    join does.
    """
    sums = summary.groupBy(F.col("linked_account_id").alias("account_id")).agg(
        F.sum("unblended_cost").alias("total_cost"),
        F.count("*").alias("lines"),
        F.sum("usage_quantity").alias("total_usage"),
    )
    out = (
        accounts.join(sums, "account_id", "left")
        .select(
            "account_id",
            "account_name",
            "total_cost",
            F.coalesce("lines", F.lit(1)).alias("total_line_items"),
            "total_usage",
        )
        .orderBy(F.desc_nulls_last("total_cost"), "account_id")
    )
    return first_rows(out, limit)
