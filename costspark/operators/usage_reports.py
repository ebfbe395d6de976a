"""Daily, per-service and top-N usage reports over billing line items."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costspark.functions.cases import first_match
from costspark.functions.dates import START, day_of, month_of, since_days, since_months
from costspark.functions.filters import COST, positive_cost
from costspark.functions.needs import needs
from costspark.functions.ratios import cents, ratio
from costspark.functions.top import first_rows
from costspark.operators.spend import (
    ACCOUNT,
    PAYER,
    REGION,
    RESOURCE,
    SERVICE,
    USAGE,
    USAGE_TYPE,
    cost_sum,
    monthly_cost,
)

PRODUCT_CODE = "line_item_product_code"
LINE_TYPE = "line_item_line_item_type"

# Line-item types that carry usage.
USAGE_LINE_TYPES = ("DiscountedUsage", "Usage", "SavingsPlanCoveredUsage")

# Usage type contains -> category, first match wins.
USAGE_CATEGORIES = (
    ("BoxUsage", "EC2 Instance Usage"),
    ("EBS", "EBS Storage"),
    ("DataTransfer", "Data Transfer"),
    ("NatGateway", "NAT Gateway"),
)


def usage_category() -> Column:
    found = ((F.col(USAGE_TYPE).contains(text), label) for text, label in USAGE_CATEGORIES)
    return first_match(found, "Other")


@needs(COST, START, SERVICE, USAGE, RESOURCE)
def service_efficiency(cur: DataFrame, service: str, as_of: date, days: int = 30) -> DataFrame:
    """One service by day: cost per unit and per resource, and a 7-row moving average.

    The window runs over at most one row per day of the look-back.
    """
    daily = (
        cur.filter((F.col(SERVICE) == service) & since_days(as_of, days))
        .groupBy(day_of().alias("usage_date"))
        .agg(
            cost_sum("daily_cost"),
            F.sum(USAGE).alias("daily_usage"),
            F.countDistinct(RESOURCE).alias("active_resources"),
        )
    )
    per_unit = F.when(F.col("daily_usage") > 0, ratio("daily_cost", "daily_usage")).otherwise(0.0)
    per_resource = F.when(
        F.col("active_resources") > 0, ratio("daily_cost", "active_resources")
    ).otherwise(0.0)
    week = Window.orderBy("usage_date").rowsBetween(-6, 0)
    return (
        daily.withColumn("unit", per_unit)
        .select(
            "usage_date",
            "daily_cost",
            "daily_usage",
            "active_resources",
            F.round("unit", 4).alias("cost_per_unit"),
            cents(per_resource).alias("cost_per_resource"),
            F.round(F.avg("unit").over(week), 4).alias("avg_cost_per_unit_7day"),
        )
        .orderBy("usage_date")
    )


@needs(COST, START)
def monthly_band_forecast(cur: DataFrame, as_of: date, days: int = 30, z: float = 1.96) -> DataFrame:
    """Average day x 30 with a band of ``z`` standard deviations; one row."""
    daily = cur.filter(since_days(as_of, days)).groupBy(day_of().alias("d")).agg(cost_sum("c"))
    mean, sd = F.col("mean"), F.col("sd")
    return daily.agg(
        F.avg("c").alias("mean"), F.stddev_samp("c").alias("sd"), F.count("*").alias("days_analyzed")
    ).select(
        F.round(mean * 30, 2).alias("forecasted_monthly_cost"),
        F.round((mean + sd * z) * 30, 2).alias("upper_bound_95pct"),
        F.round((mean - sd * z) * 30, 2).alias("lower_bound_95pct"),
        "days_analyzed",
    )


@needs(
    PAYER, ACCOUNT, LINE_TYPE, START, "product_region_code", USAGE_TYPE, RESOURCE,
    "product_instance_type", PRODUCT_CODE, USAGE, COST,
)
def ec2_daily_usage(cur: DataFrame, product: str = "AmazonEC2", limit: int | None = 20) -> DataFrame:
    """Instance cost by day, region, usage category and resource."""
    rows = cur.filter(
        (F.col(PRODUCT_CODE) == product)
        & F.col(LINE_TYPE).isin(*USAGE_LINE_TYPES)
        & positive_cost()
    )
    day = "day_line_item_usage_start_date"
    keys = [
        PAYER,
        ACCOUNT,
        LINE_TYPE,
        day_of().alias(day),
        F.col("product_region_code").alias("region"),
        usage_category().alias("usage_category"),
        RESOURCE,
        "product_instance_type",
    ]
    return (
        rows.groupBy(*keys)
        .agg(
            F.sum(USAGE).alias("sum_line_item_usage_amount"),
            cost_sum("sum_line_item_unblended_cost"),
        )
        .orderBy(F.desc("sum_line_item_unblended_cost"), day, ACCOUNT, RESOURCE)
        .transform(first_rows, limit)
    )


@needs(PAYER, ACCOUNT, START, USAGE_TYPE, RESOURCE, "product", PRODUCT_CODE, LINE_TYPE, USAGE, COST)
def athena_daily_usage(cur: DataFrame, product: str = "AmazonAthena", limit: int | None = 20) -> DataFrame:
    """One product by day and resource, region read from the product map."""
    day = "day_line_item_usage_start_date"
    rows = cur.filter(
        (F.col(PRODUCT_CODE) == product) & F.col(LINE_TYPE).isin(*USAGE_LINE_TYPES)
    )
    return (
        rows.groupBy(
            PAYER,
            ACCOUNT,
            day_of().alias(day),
            USAGE_TYPE,
            RESOURCE,
            F.try_element_at("product", F.lit("region")).alias("region"),
            PRODUCT_CODE,
        )
        .agg(
            F.sum(USAGE).alias("sum_line_item_usage_amount"),
            cost_sum("sum_line_item_unblended_cost"),
        )
        .orderBy(F.desc("sum_line_item_unblended_cost"), day, ACCOUNT, RESOURCE)
        .transform(first_rows, limit)
    )


@needs(COST, START, SERVICE, REGION)
def service_monthly_by_region(
    cur: DataFrame, as_of: date, service: str = "AmazonEC2", months_back: int = 6
) -> DataFrame:
    rows = cur.filter((F.col(SERVICE) == service) & since_months(as_of, months_back))
    return monthly_cost(rows, REGION).orderBy("month", F.desc("monthly_cost"))


@needs(COST, SERVICE, ACCOUNT)
def service_by_account(cur: DataFrame, service: str = "AmazonS3", limit: int | None = 10) -> DataFrame:
    return (
        cur.filter((F.col(SERVICE) == service) & positive_cost())
        .groupBy(ACCOUNT)
        .agg(cost_sum("total_cost"))
        .orderBy(F.desc("total_cost"), ACCOUNT)
        .transform(first_rows, limit)
    )


@needs(COST, SERVICE, START)
def service_by_day(
    cur: DataFrame, as_of: date, service: str = "AWSLambda", days: int = 30
) -> DataFrame:
    return (
        cur.filter((F.col(SERVICE) == service) & since_days(as_of, days))
        .groupBy(day_of().alias("date"))
        .agg(cost_sum("daily_cost"))
        .orderBy("date")
    )


@needs(COST, SERVICE, REGION)
def service_by_region(cur: DataFrame, service: str = "AmazonEC2") -> DataFrame:
    return (
        cur.filter(F.col(SERVICE) == service).groupBy(REGION).agg(cost_sum("total_cost"))
    )


@needs(COST, SERVICE, START)
def recent_services(cur: DataFrame, as_of: date, days: int = 7, limit: int | None = 10) -> DataFrame:
    """Services of the last days by cost, with line counts."""
    return (
        cur.filter(since_days(as_of, days))
        .groupBy(SERVICE)
        .agg(F.count("*").alias("records"), cost_sum("total_cost"))
        .orderBy(F.desc("total_cost"), SERVICE)
        .transform(first_rows, limit)
    )


@needs(COST, SERVICE, START, RESOURCE)
def recent_service_detail(
    cur: DataFrame, as_of: date, days: int = 30, limit: int | None = 20, priced_only: bool = True
) -> DataFrame:
    """Lines of the last days per service: cost, average line, lines, resources."""
    rows = cur.filter(since_days(as_of, days))
    return (
        (rows.filter(positive_cost()) if priced_only else rows)
        .groupBy(SERVICE)
        .agg(
            cost_sum("total_cost"),
            F.avg(COST).alias("avg_cost_per_line"),
            F.count("*").alias("line_item_count"),
            F.countDistinct(RESOURCE).alias("unique_resources"),
        )
        .orderBy(F.desc("total_cost"), SERVICE)
        .transform(first_rows, limit)
    )


@needs(COST, SERVICE, USAGE_TYPE, START)
def service_search(cur: DataFrame, text: str, limit: int | None = 20) -> DataFrame:
    """Services whose code contains ``text`` (any case), by usage type."""
    return (
        cur.filter(F.lower(SERVICE).contains(text.lower()))
        .groupBy(F.col(SERVICE).alias("service"), F.col(USAGE_TYPE).alias("usage_type"))
        .agg(
            cost_sum("total_cost"),
            F.count("*").alias("line_items"),
            F.min(START).alias("first_usage"),
            F.max(START).alias("last_usage"),
        )
        .orderBy(F.desc("total_cost"), "service", "usage_type")
        .transform(first_rows, limit)
    )


def _of_top_services(groups: DataFrame, cost: str, n: int) -> DataFrame:
    """Rows of the ``n`` services with the highest total of ``cost``.

    ``groups`` is already down to one row per service and period, which the
    provider's catalogue and the calendar bound; the facts are read once and
    not joined with a second scan for the ranking.
    """
    total = F.sum(cost).over(Window.partitionBy(SERVICE))
    place = F.dense_rank().over(Window.orderBy(F.desc("_total"), SERVICE))
    return (
        groups.filter(F.col(SERVICE).isNotNull())
        .withColumn("_total", total)
        .withColumn("_place", place)
        .filter(F.col("_place") <= n)
        .drop("_total", "_place")
    )


@needs(COST, SERVICE, START)
def top_service_months(cur: DataFrame, as_of: date, months: int = 12, n: int = 10) -> DataFrame:
    """Monthly cost of the ``n`` services that cost most over the whole table."""
    recent = F.when(since_months(as_of, months), F.col(COST))
    groups = cur.groupBy(month_of().alias("month"), SERVICE).agg(
        F.sum(recent).alias("monthly_cost"), cost_sum("ever")
    )
    return (
        _of_top_services(groups, "ever", n)
        .filter("monthly_cost IS NOT NULL")
        .select("month", SERVICE, "monthly_cost")
        .orderBy("month", F.desc("monthly_cost"))
    )


@needs(COST, SERVICE, START, RESOURCE)
def top_service_weeks(cur: DataFrame, start: date, end: date, n: int = 10) -> DataFrame:
    """Weekly cost and resources of the top services of the range, in one job.

    The range is inclusive of ``end`` at midnight, as BETWEEN on timestamps is.
    """
    rows = cur.filter((F.col(START) >= F.lit(start)) & (F.col(START) <= F.lit(end)))
    weekly = rows.groupBy(SERVICE, F.to_date(F.date_trunc("week", START)).alias("week")).agg(
        cost_sum("weekly_cost"), F.countDistinct(RESOURCE).alias("unique_resources")
    )
    return _of_top_services(weekly, "weekly_cost", n).orderBy(SERVICE, "week")


@needs(COST, ACCOUNT, START, SERVICE, RESOURCE)
def account_analysis(cur: DataFrame, as_of: date, days: int | None = 30) -> DataFrame:
    """Per account: cost, distinct services and resources, average line.

    ``days=None`` covers the whole table.
    """
    rows = cur if days is None else cur.filter(since_days(as_of, days))
    parts = rows.groupBy(ACCOUNT, SERVICE, RESOURCE).agg(
        F.sum(COST).alias("cost"), F.count(COST).alias("priced")
    )
    return (
        parts.groupBy(F.col(ACCOUNT).alias("account_id"))
        .agg(
            F.sum("cost").alias("total_cost"),
            F.countDistinct(SERVICE).alias("services_count"),
            F.countDistinct(RESOURCE).alias("resources_count"),
            F.sum("priced").alias("priced"),
        )
        .withColumn("avg_line_cost", ratio("total_cost", "priced"))
        .drop("priced")
        .orderBy(F.desc("total_cost"), "account_id")
    )
