"""Reports over FOCUS exports (decimal amounts)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costspark.functions.dates import since_months
from costspark.functions.top import first_rows

PERIOD = "BillingPeriodStart"


def cost_by_service(focus: DataFrame, as_of: date, months: int = 1, limit: int | None = 20) -> DataFrame:
    return (
        focus.filter(since_months(as_of, months, PERIOD))
        .groupBy("ServiceCategory", "ServiceName")
        .agg(F.sum("EffectiveCost").alias("TotalCost"), F.count("*").alias("RecordCount"))
        .orderBy(F.desc("TotalCost"), "ServiceCategory", "ServiceName")
        .transform(first_rows, limit)
    )


def account_region_savings(focus: DataFrame, as_of: date, months: int = 3) -> DataFrame:
    """Effective and list cost per account and region, and the difference."""
    return (
        focus.filter(since_months(as_of, months, PERIOD))
        .groupBy("BillingAccountName", "RegionName")
        .agg(
            F.sum("EffectiveCost").alias("TotalCost"),
            F.sum("ListCost").alias("TotalListCost"),
            F.sum(F.col("ListCost") - F.col("EffectiveCost")).alias("TotalSavings"),
        )
        .orderBy(F.desc("TotalCost"), "BillingAccountName", "RegionName")
    )


def commitment_discounts(focus: DataFrame, as_of: date, months: int = 1) -> DataFrame:
    return (
        focus.filter(F.col("CommitmentDiscountId").isNotNull() & since_months(as_of, months, PERIOD))
        .groupBy("CommitmentDiscountType", "CommitmentDiscountCategory")
        .agg(
            F.countDistinct("CommitmentDiscountId").alias("DiscountCount"),
            F.sum("EffectiveCost").alias("TotalEffectiveCost"),
            F.sum("ListCost").alias("TotalListCost"),
            F.sum(F.col("ListCost") - F.col("EffectiveCost")).alias("CommitmentSavings"),
        )
        .orderBy(F.desc("CommitmentSavings"))
    )


def resource_use_by_type(
    focus: DataFrame, as_of: date, months: int = 1, limit: int | None = 15
) -> DataFrame:
    return (
        focus.filter(F.col("ResourceId").isNotNull() & since_months(as_of, months, PERIOD))
        .groupBy("ResourceType", "ConsumedUnit")
        .agg(
            F.countDistinct("ResourceId").alias("UniqueResources"),
            F.sum("ConsumedQuantity").alias("TotalQuantity"),
            F.sum("EffectiveCost").alias("TotalCost"),
            F.avg("EffectiveCost").alias("AvgCostPerResource"),
        )
        .orderBy(F.desc("TotalCost"), "ResourceType", "ConsumedUnit")
        .transform(first_rows, limit)
    )
