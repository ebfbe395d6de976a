"""KPI roll-up of a billing table, savings summary, health check, executive summary."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costspark.functions.filters import COST, kpi_filter, positive_cost
from costspark.functions.needs import needs
from costspark.functions.ratios import cents, ratio
from costspark.operators.spend import ACCOUNT, PAYER, PERIOD, SERVICE, USAGE_TYPE

TYPE = "product_instance_type"

# KPI metrics in report order.
METRICS = [
    "ec2_all_cost",
    "ec2_usage_cost",
    "ec2_spot_cost",
    "ec2_spot_potential_savings",
    "ec2_previous_generation_cost",
    "ec2_previous_generation_potential_savings",
    "ec2_graviton_eligible_cost",
    "ec2_graviton_cost",
    "ec2_graviton_potential_savings",
    "ec2_amd_eligible_cost",
    "ec2_amd_cost",
    "ec2_amd_potential_savings",
    "rds_all_cost",
    "rds_ondemand_cost",
    "rds_graviton_cost",
    "rds_graviton_eligible_cost",
    "rds_graviton_potential_savings",
    "rds_commit_potential_savings",
    "rds_commit_savings",
    "rds_license",
    "rds_no_license",
    "rds_sql_server_cost",
    "rds_oracle_cost",
    "ebs_all_cost",
    "ebs_gp_all_cost",
    "ebs_gp2_cost",
    "ebs_gp3_cost",
    "ebs_gp3_potential_savings",
    "ebs_snapshots_under_1yr_cost",
    "ebs_snapshots_over_1yr_cost",
    "ebs_snapshot_cost",
    "s3_all_storage_cost",
    "s3_standard_storage_cost",
    "s3_standard_storage_potential_savings",
    "compute_all_cost",
    "compute_ondemand_cost",
    "compute_commit_potential_savings",
    "compute_commit_savings",
    "dynamodb_all_cost",
    "lambda_all_cost",
]
EC2_SAVINGS = (
    "ec2_spot_potential_savings",
    "ec2_previous_generation_potential_savings",
    "ec2_graviton_potential_savings",
    "ec2_amd_potential_savings",
)
RDS_SAVINGS = ("rds_graviton_potential_savings", "rds_commit_potential_savings")
STORAGE_SAVINGS = ("ebs_gp3_potential_savings", "s3_standard_storage_potential_savings")


@dataclass(frozen=True)
class KpiRule:
    """``metric`` = sum of matching cost x ``rate``.

    A line matches when it is of one of ``services`` (any if empty) and its
    usage type and instance type contain the given texts (any if empty).
    """

    metric: str
    services: tuple[str, ...] = ()
    usage_type: str = ""
    instance_type: str = ""
    rate: float = 1.0

    def matches(self) -> Column:
        out = F.lit(True)
        if self.services:
            out = out & F.col(SERVICE).isin(*self.services)
        if self.usage_type:
            out = out & F.col(USAGE_TYPE).contains(self.usage_type)
        if self.instance_type:
            out = out & F.col(TYPE).contains(self.instance_type)
        return out


# The sums the original defines; every other metric is 0 unless a rule gives it.
BASE_RULES = (
    KpiRule("ec2_all_cost", ("AmazonEC2",)),
    KpiRule("ec2_usage_cost", ("AmazonEC2",), "BoxUsage"),
    KpiRule("rds_all_cost", ("AmazonRDS",)),
    KpiRule("rds_ondemand_cost", ("AmazonRDS",)),
    KpiRule("s3_all_storage_cost", ("AmazonS3",)),
    KpiRule("compute_all_cost", ("AmazonEC2", "AmazonRDS", "AWSLambda")),
)


@needs(COST, SERVICE, USAGE_TYPE, TYPE, PERIOD, PAYER, ACCOUNT)
def kpi_summary(
    cur: DataFrame,
    as_of: date,
    billing_period: str | None = None,
    payer_account_id: str | None = None,
    linked_account_id: str | None = None,
    tags: Mapping[str, str] | None = None,
    rules: Sequence[KpiRule] = (),
) -> DataFrame:
    """One row: every metric as a conditional sum in a single pass.

    Without ``billing_period`` the whole table counts; the period shown is then
    the month of ``as_of``.  The original names most metrics without a formula;
    ``rules`` supplies ours, and a rule replaces the base one of its metric.
    """
    unknown = {r.metric for r in rules} - set(METRICS)
    if unknown:
        raise ValueError(f"unknown KPI metrics: {sorted(unknown)}")
    formulas: dict[str, Column] = {}
    chosen = [r for r in BASE_RULES if r.metric not in {x.metric for x in rules}]
    for rule in [*chosen, *rules]:
        part = F.sum(F.when(rule.matches(), F.col(COST) * rule.rate))
        part = F.coalesce(part, F.lit(0.0))
        formulas[rule.metric] = formulas[rule.metric] + part if rule.metric in formulas else part
    total = F.coalesce(F.sum(COST), F.lit(0.0))
    rows = cur.filter(
        positive_cost() & kpi_filter(billing_period, payer_account_id, linked_account_id, tags)
    )
    measured = rows.agg(
        total.alias("spend_all_cost"), *[c.alias(m) for m, c in formulas.items()]
    )
    return measured.select(
        F.lit(billing_period or as_of.strftime("%Y-%m")).alias("billing_period"),
        F.lit(payer_account_id or "default").alias("payer_account_id"),
        F.lit(linked_account_id or "default").alias("linked_account_id"),
        "spend_all_cost",
        F.col("spend_all_cost").alias("unblended_cost"),
        F.lit("{}").alias("tags_json"),
        *[F.col(m) if m in formulas else F.lit(0.0).alias(m) for m in METRICS],
    )


def _total(names: Sequence[str]) -> Column:
    out = F.col(names[0])
    for name in names[1:]:
        out = out + F.col(name)
    return out


def savings_summary(kpi: DataFrame) -> DataFrame:
    """Savings totals of ``kpi_summary`` to two places.

    The commitment figure includes the RDS processor savings, as in the original.
    """
    commit = _total((*RDS_SAVINGS, "compute_commit_potential_savings"))
    everything = _total((*EC2_SAVINGS, *RDS_SAVINGS, *STORAGE_SAVINGS, "compute_commit_potential_savings"))
    graviton = _total(("ec2_graviton_potential_savings", "rds_graviton_potential_savings"))
    return kpi.select(
        "spend_all_cost",
        cents(everything).alias("total_potential_savings"),
        cents(graviton).alias("graviton_savings_potential"),
        cents(commit).alias("commitment_savings_potential"),
        cents(_total(STORAGE_SAVINGS)).alias("storage_optimization_potential"),
        cents("ec2_spot_potential_savings").alias("spot_instance_potential"),
        cents(_total(("rds_commit_savings", "compute_commit_savings"))).alias(
            "current_monthly_savings"
        ),
        cents(everything * 12).alias("annualized_savings_opportunity"),
    )


def _savings_ratio() -> Column:
    share = ratio("total_potential_savings", "spend_all_cost") * 100
    return F.when(F.col("spend_all_cost") > 0, share).otherwise(0.0)


def cost_health_check(savings: DataFrame, idle: DataFrame, score: DataFrame) -> DataFrame:
    """Scores and findings from ``savings_summary``, ``idle_resources`` and ``compliance_score``.

    The one-row inputs come in as scalar subqueries.
    """
    share, idle_count, tags = F.col("savings_ratio"), F.col("idle_count"), F.col("tagging_compliance")
    low_tags, many_idle, wasteful = tags < 70, idle_count > 5, share > 20
    # Texts of findings and recommendations.
    scores = F.col("cost_efficiency") + F.col("resource_optimization") + tags
    return (
        savings.select(
            "spend_all_cost", "total_potential_savings", _savings_ratio().alias("savings_ratio")
        )
        .withColumn("idle_count", idle.agg(F.count("*")).scalar())
        .withColumn("tagging_compliance", score.select("compliance_score").scalar())
        .withColumn("cost_efficiency", F.round(F.least(F.lit(100.0), share * 2), 1))
        .withColumn(
            "resource_optimization", F.greatest(F.lit(0), 100 - idle_count * 5).cast("double")
        )
        .withColumn("overall_score", F.round(scores / 3, 1))
        .withColumn(
            "findings",
            F.array_compact(
                F.array(
                    F.when(low_tags, "Low tagging compliance detected"),
                    F.when(
                        many_idle, F.concat(idle_count.cast("string"), F.lit(" idle resources found"))
                    ),
                    F.when(wasteful, "High optimization potential identified"),
                )
            ),
        )
        .withColumn(
            "recommendations",
            F.array_compact(
                F.array(
                    F.when(low_tags, "Implement automated tagging policies"),
                    F.when(many_idle, "Review and terminate unused resources"),
                    F.when(wasteful, "Prioritize cost optimization initiatives"),
                )
            ),
        )
    )


def executive_summary(health: DataFrame, invoices: DataFrame) -> DataFrame:
    """Spend, change, potential, health and risk in one row.

    ``invoices`` is ``invoice_summary``; the change is that of its latest month
    and counts as 0 when unknown.
    """
    latest = invoices.agg(F.coalesce(F.max_by("mom_change", "month"), F.lit(0.0))).scalar()
    change, share = F.col("month_over_month_change"), F.col("potential_savings_percentage")
    wasteful = share > 20
    money = lambda c: F.concat(F.lit("$"), F.format_number(c, 2))
    moved = F.when(change > 0, "increased").otherwise("decreased")
    base = health.select(
        F.col("spend_all_cost").alias("current_monthly_spend"),
        latest.alias("month_over_month_change"),
        F.col("total_potential_savings").alias("optimization_potential"),
        F.col("savings_ratio").alias("potential_savings_percentage"),
        F.col("overall_score").alias("cost_health_score"),
        "idle_count",
        F.slice("recommendations", 1, 3).alias("priority_actions"),
        F.col("findings").alias("detailed_findings"),
    )
    highlights = F.array_compact(
        F.array(
            F.when(
                F.col("current_monthly_spend") > 0,
                F.concat(F.lit("Monthly cloud spend: "), money("current_monthly_spend")),
            ),
            F.when(
                F.col("optimization_potential") > 0,
                F.concat(
                    F.lit("Identified "),
                    money("optimization_potential"),
                    F.lit(" in potential monthly savings"),
                ),
            ),
            F.when(
                F.abs(change) > 5,
                F.concat(
                    F.lit("Spend "), moved, F.lit(" "),
                    F.format_string("%.1f", F.abs(change)), F.lit("% from last month"),
                ),
            ),
            F.when(
                F.col("idle_count") > 0,
                F.concat(
                    F.lit("Found "), F.col("idle_count").cast("string"),
                    F.lit(" idle resources for review"),
                ),
            ),
        )
    )
    return base.withColumn("highlights", highlights).withColumn(
        "risk_level",
        F.when(change > 20, "HIGH").when((change > 10) | wasteful, "MEDIUM").otherwise("LOW"),
    ).withColumn(
        "risk_factors",
        F.array_compact(
            F.array(
                F.when(change > 20, "Rapid cost growth").when(change > 10, "Moderate cost increase"),
                F.when(wasteful, "High optimization potential indicates inefficiency"),
            )
        ),
    )
