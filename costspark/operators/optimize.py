"""Idle resources, rightsizing, migration and waste."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costspark.functions.cases import first_match
from costspark.functions.dates import START, day_of, in_month, since_days
from costspark.functions.filters import COST, positive_cost
from costspark.functions.needs import needs
from costspark.functions.ratios import cents, percent
from costspark.functions.top import first_rows
from costspark.operators.spend import REGION, RESOURCE, SERVICE, USAGE, USAGE_TYPE, cost_sum

TYPE = "product_instance_type"

# Fixed values.
IDLE_SERVICES = ("AmazonEC2", "AmazonRDS", "ElasticLoadBalancing")
# (size in the type name, average usage below, smaller size)
SIZE_STEPS = (("xlarge", 50, "large"), ("large", 30, "medium"), ("medium", 20, "small"))
HOURS_PER_MONTH = 720.0


def termination_risk(service: str = "service", status: str = "status") -> Column:
    idle = F.col(status) == "idle"
    return (
        F.when(F.col(service) == "ElasticLoadBalancing", "high")
        .when((F.col(service) == "AmazonRDS") & idle, "medium")
        .when(idle, "low")
        .otherwise("medium")
    )


@needs(RESOURCE, SERVICE, TYPE, COST, USAGE, START)
def idle_resources(
    cur: DataFrame,
    as_of: date,
    threshold: float = 5.0,
    services: Sequence[str] = IDLE_SERVICES,
    limit: int | None = 50,
) -> DataFrame:
    """Resources of the month whose average usage is under twice the threshold.

    Under the threshold is idle (90 % of the cost could go), else underutilised
    (30 %).  Usage of 0, below 0 or NULL counts as 0 in the average.
    """
    groups = (
        cur.filter(positive_cost() & F.col(SERVICE).isin(list(services)) & in_month(as_of))
        .groupBy(RESOURCE, SERVICE, TYPE)
        .agg(*usage_sums())
    )
    return idle_groups(groups, threshold, limit)


def usage_sums() -> list[Column]:
    """Cost and usage of a resource as sums, which add up over parts of its lines."""
    used = F.when(F.col(USAGE) > 0, F.col(USAGE)).otherwise(0.0)
    return [
        cost_sum("monthly_cost"),
        F.sum(used).alias("used_sum"),
        F.sum(USAGE).alias("usage_sum"),
        F.count(USAGE).alias("usage_lines"),
        F.count("*").alias("records"),
    ]


def idle_groups(groups: DataFrame, threshold: float = 5.0, limit: int | None = 50) -> DataFrame:
    """``idle_resources`` from ``usage_sums`` per resource, service and type of one month."""
    groups = groups.select(
        F.col(RESOURCE).alias("resource_id"),
        F.col(SERVICE).alias("service"),
        F.col(TYPE).alias("instance_type"),
        "monthly_cost",
        (F.col("used_sum") / F.col("records")).alias("utilization"),
    ).filter(F.col("utilization") < 2 * threshold)
    idle = F.col("utilization") < threshold
    out = (
        groups.withColumns(
            {
                "status": F.when(idle, "idle").otherwise("underutilized"),
                "potential_savings": F.col("monthly_cost") * F.when(idle, 0.9).otherwise(0.3),
            }
        )
        .withColumn("risk_level", termination_risk())
        .orderBy(F.desc("potential_savings"), "resource_id", "service")
    )
    return first_rows(out, limit)


def risk_levels(idle: DataFrame) -> DataFrame:
    """Resources and savings per risk level of ``idle_resources`` rows."""
    return idle.groupBy("risk_level").agg(
        F.count("*").alias("resources"),
        cents(F.sum("potential_savings")).alias("potential_savings"),
    )


def confidence_score(usage: str = "avg_usage") -> Column:
    u = F.col(usage)
    return F.when(u < 20, 95).when(u < 40, 85).when(u < 60, 70).otherwise(50)


@needs(RESOURCE, TYPE, COST, USAGE, START, SERVICE)
def rightsizing(
    cur: DataFrame,
    as_of: date,
    service: str = "AmazonEC2",
    min_records: int = 10,
    max_usage: float = 60.0,
    limit: int | None = 20,
) -> DataFrame:
    """Instances that could go one size down at half the cost.

    The ``limit`` largest candidates are taken before those without savings
    drop out (no cut with None, as summaries need), and the size is replaced inside the name (``2xlarge`` becomes
    ``2large``); both follow the original.
    """
    groups = (
        cur.filter(
            positive_cost() & (F.col(SERVICE) == service) & F.col(TYPE).isNotNull() & in_month(as_of)
        )
        .groupBy(RESOURCE, TYPE)
        .agg(*usage_sums())
    )
    return smaller_groups(groups, min_records, max_usage, limit)


def smaller_groups(
    groups: DataFrame, min_records: int = 10, max_usage: float = 60.0, limit: int | None = 20
) -> DataFrame:
    """``rightsizing`` from ``usage_sums`` per resource and type of one month."""
    size, cost = F.col(TYPE), F.col("monthly_cost")
    fits = {
        (name, smaller): size.contains(name) & (F.col("avg_usage") < below)
        for name, below, smaller in SIZE_STEPS
    }
    new_type = first_match(
        ((hit, F.replace(size, F.lit(old), F.lit(new))) for (old, new), hit in fits.items()), size
    )
    new_cost = first_match(((hit, cost * 0.5) for hit in fits.values()), cost)
    groups = groups.withColumn("avg_usage", F.try_divide(F.col("usage_sum"), F.col("usage_lines"))).filter(
        (F.col("records") > min_records) & (F.col("avg_usage") < max_usage)
    )
    top = (
        groups.select(
            F.col(RESOURCE).alias("resource_id"),
            size.alias("current_instance_type"),
            "monthly_cost",
            "avg_usage",
            new_type.alias("recommended_instance_type"),
            new_cost.alias("estimated_new_cost"),
        )
        .withColumn("savings", F.col("monthly_cost") - F.col("estimated_new_cost"))
        .orderBy(F.desc("savings"), "resource_id", "current_instance_type")
        .transform(first_rows, limit)
    )
    return top.filter("savings > 0").select(
        F.concat(F.lit("rightsizing_"), "resource_id").alias("id"),
        "resource_id",
        "current_instance_type",
        "monthly_cost",
        "avg_usage",
        "recommended_instance_type",
        "estimated_new_cost",
        cents("savings").alias("monthly_savings"),
        cents(F.col("savings") * 12).alias("annual_savings"),
        confidence_score().alias("confidence_score"),
        F.lit("low").alias("risk_level"),
    )


def rightsizing_summary(recommendations: DataFrame) -> DataFrame:
    """Count, total savings and effort of ``rightsizing`` rows; one row."""
    n = F.col("recommendations")
    return recommendations.agg(
        F.count("*").alias("recommendations"),
        cents(
            F.coalesce(F.sum(F.col("monthly_cost") - F.col("estimated_new_cost")), F.lit(0.0))
        ).alias("savings_potential"),
    ).withColumn(
        "implementation_effort",
        F.when(n < 5, "easy").when(n < 15, "medium").otherwise("complex"),
    )


@needs(RESOURCE, TYPE, COST, START, SERVICE)
def migration_candidates(
    cur: DataFrame,
    as_of: date,
    service: str = "AmazonEC2",
    size: str = "micro",
    cost_factor: float = 0.3,
    migration_type: str = "EC2_to_Lambda",
) -> DataFrame:
    """Small instances as one candidate for a move to functions; at most one row."""
    one = cur.filter(
        positive_cost()
        & (F.col(SERVICE) == service)
        & F.col(TYPE).contains(size)
        & in_month(as_of)
    ).agg(F.countDistinct(RESOURCE).alias("affected_resources"), cost_sum("current_monthly_cost"))
    saved = F.col("current_monthly_cost") - F.col("estimated_new_cost")
    return (
        one.withColumn("estimated_new_cost", F.col("current_monthly_cost") * cost_factor)
        .filter((F.col("affected_resources") > 0) & (saved > 0))
        .select(
            F.lit(migration_type).alias("migration_type"),
            "affected_resources",
            "current_monthly_cost",
            "estimated_new_cost",
            cents(saved).alias("monthly_savings"),
            cents(saved * 12).alias("annual_savings"),
        )
    )


@needs(REGION, "product_location", USAGE_TYPE, COST, RESOURCE, START)
def transfer_costs(
    cur: DataFrame, as_of: date, min_cost: float = 100.0, reduction: float = 0.7
) -> DataFrame:
    """Data transfer per region and location where it costs more than ``min_cost``."""
    moved = F.when(F.col(USAGE_TYPE).contains("DataTransfer"), F.col(COST)).otherwise(0.0)
    return (
        cur.filter(positive_cost() & F.col(USAGE_TYPE).contains("Data") & in_month(as_of))
        .groupBy(F.col(REGION).alias("region"), F.col("product_location").alias("availability_zone"))
        .agg(
            F.sum(moved).alias("transfer_cost"),
            F.countDistinct(RESOURCE).alias("resource_count"),
        )
        .filter(F.col("transfer_cost") > min_cost)
        .withColumn("potential_savings", F.col("transfer_cost") * reduction)
        .orderBy(F.desc("transfer_cost"), "region", "availability_zone")
    )


def transfer_savings(transfers: DataFrame) -> DataFrame:
    """Totals of ``transfer_costs`` and what the two usual measures would save."""
    total = F.coalesce(F.sum("potential_savings"), F.lit(0.0))
    return transfers.agg(
        cents(total).alias("savings"),
        cents(total * 0.4).alias("same_zone_consolidation"),
        cents(total * 0.3).alias("vpc_peering"),
    )


@needs(RESOURCE, SERVICE, COST, START)
def resource_activity(
    cur: DataFrame, service: str, as_of: date, idle_days: int = 7, lookback_days: int = 30
) -> DataFrame:
    """Resources of one service not used today: active days and days since last use."""
    since = F.date_diff(F.lit(as_of), F.to_date("last_seen"))
    return (
        cur.filter(
            (F.col(SERVICE) == service) & positive_cost() & since_days(as_of, lookback_days)
        )
        .groupBy(RESOURCE, SERVICE)
        .agg(
            cost_sum("total_cost"),
            F.countDistinct(day_of()).alias("active_days"),
            F.min(START).alias("first_seen"),
            F.max(START).alias("last_seen"),
        )
        .withColumn("days_since_last_use", since)
        .filter("days_since_last_use > 0")
        .select(
            RESOURCE,
            SERVICE,
            "total_cost",
            "active_days",
            "days_since_last_use",
            F.when(F.col("days_since_last_use") > idle_days, "idle")
            .when(F.col("active_days") < 7, "underutilized")
            .otherwise("active")
            .alias("optimization_opportunity"),
            "first_seen",
            "last_seen",
        )
        .orderBy(F.desc("total_cost"), RESOURCE)
    )


def _unused() -> Column:
    return positive_cost() & ((F.col(USAGE) == 0) | F.col(USAGE).isNull())


@needs(RESOURCE, SERVICE, "line_item_operation", COST, USAGE, START)
def zero_usage_waste(
    cur: DataFrame, as_of: date, days: int = 7, min_cost: float = 5.0
) -> DataFrame:
    """Cost without usage per resource, service and operation."""
    return (
        cur.filter(since_days(as_of, days) & _unused())
        .groupBy(RESOURCE, SERVICE, "line_item_operation")
        .agg(
            cost_sum("wasted_cost"),
            F.count("*").alias("idle_periods"),
            F.avg(COST).alias("avg_idle_cost"),
        )
        .filter(F.col("wasted_cost") > min_cost)
        .orderBy(F.desc("wasted_cost"), RESOURCE, SERVICE, "line_item_operation")
    )


@needs(RESOURCE, SERVICE, COST, USAGE, START)
def zero_usage_lines(cur: DataFrame, as_of: date, days: int = 7) -> DataFrame:
    """The single lines that cost something with a usage of exactly 0."""
    return cur.filter(
        positive_cost() & (F.col(USAGE) == 0) & since_days(as_of, days)
    ).select(RESOURCE, SERVICE, COST, START)


@needs(RESOURCE, SERVICE, TYPE, "line_item_operation", COST, USAGE, START)
def utilization_ratio(
    cur: DataFrame,
    as_of: date,
    service: str = "AmazonEC2",
    operation: str = "RunInstances",
    days: int = 30,
    min_cost: float = 50.0,
) -> DataFrame:
    """Hours used of a 720-hour month: terminate, downsize or monitor."""
    share = F.col("total_usage_hours") / HOURS_PER_MONTH
    return (
        cur.filter(
            since_days(as_of, days)
            & (F.col(SERVICE) == service)
            & F.col("line_item_operation").contains(operation)
        )
        .groupBy(RESOURCE, SERVICE, TYPE)
        .agg(cost_sum("total_cost"), F.sum(USAGE).alias("total_usage_hours"))
        .filter(F.col("total_cost") > min_cost)
        .select(
            RESOURCE,
            TYPE,
            "total_cost",
            "total_usage_hours",
            F.round(share, 2).alias("utilization_ratio"),
            F.when(share < 0.2, "Terminate")
            .when(share < 0.5, "Downsize")
            .otherwise("Monitor")
            .alias("recommendation"),
        )
        .orderBy(F.desc("total_cost"), RESOURCE, TYPE)
    )


@needs(
    SERVICE, TYPE, REGION, "line_item_line_item_type", "reservation_reservation_a_r_n", COST, USAGE, START
)
def reservation_coverage(
    cur: DataFrame, as_of: date, service: str = "AmazonEC2", days: int = 30
) -> DataFrame:
    """Reservation fees, reserved and on-demand hours per instance type and region."""
    kind = F.col("line_item_line_item_type")
    reserved = F.col("reservation_reservation_a_r_n").isNotNull()

    def total(condition: Column, value: str) -> Column:
        return F.sum(F.when(condition, F.col(value)).otherwise(0.0))

    usage = kind == "Usage"
    covered = percent("ri_usage_hours", "total_hours")
    return (
        cur.filter(since_days(as_of, days) & (F.col(SERVICE) == service))
        .groupBy(SERVICE, TYPE, REGION)
        .agg(
            total(kind == "RIFee", COST).alias("ri_fees"),
            total(usage & reserved, USAGE).alias("ri_usage_hours"),
            total(usage & ~reserved, USAGE).alias("on_demand_hours"),
            total(usage, USAGE).alias("total_hours"),
        )
        .filter("ri_fees > 0 OR ri_usage_hours > 0")
        .withColumn(
            "ri_coverage_percent", F.when(F.col("total_hours") > 0, covered).otherwise(0.0)
        )
        .orderBy(F.desc("ri_fees"), TYPE, REGION)
    )


@needs(RESOURCE, SERVICE, COST, USAGE, START)
def resource_utilization(
    cur: DataFrame, as_of: date, days: int = 7, min_cost: float = 10.0, limit: int | None = 100
) -> DataFrame:
    """The costliest resources of the last days with usage and first and last use."""
    return (
        cur.filter(F.col(RESOURCE).isNotNull() & since_days(as_of, days))
        .groupBy(RESOURCE, SERVICE)
        .agg(
            cost_sum("total_cost"),
            F.sum(USAGE).alias("total_usage"),
            F.count("*").alias("billing_records"),
            F.min(START).alias("first_usage"),
            F.max(START).alias("last_usage"),
        )
        .filter(F.col("total_cost") > min_cost)
        .orderBy(F.desc("total_cost"), RESOURCE, SERVICE)
        .transform(first_rows, limit)
    )
