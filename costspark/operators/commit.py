"""Discounts: agreements, negotiation, usage stability and commitment scenarios."""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costspark.functions.cases import first_match
from costspark.functions.dates import START, in_month, month_of, since_months
from costspark.functions.filters import COST, positive_cost
from costspark.functions.needs import needs
from costspark.functions.ratios import cents, ratio
from costspark.functions.top import first_rows
from costspark.operators.spend import ACCOUNT, RESOURCE, SERVICE, USAGE, by_keys_and_ids, cost_sum

LINE_TYPE = "line_item_line_item_type"
TYPE = "product_instance_type"

# Text in the line-item type -> pricing model, first match wins.
PRICING_MODELS = (
    ("Reserved", "Reserved Instance"),
    ("SavingsPlans", "Savings Plan"),
    ("Spot", "Spot Instance"),
)
AGREEMENTS = ("Reserved Instance", "Savings Plan")
# (annual spend above, discount %, priority)
DISCOUNT_TIERS = ((500000, 20, "high"), (100000, 15, "medium"), (50000, 10, "low"))
# (commitment type, coverage %, discount %)
SCENARIOS = (("1_year_ri", 70, 30), ("3_year_ri", 50, 45), ("savings_plan", 80, 15))
DEFAULT_BENCHMARK = (8.0, 12.0)


def pricing_model(patterns: Sequence[tuple[str, str]] = PRICING_MODELS) -> Column:
    """Pricing model of a line.

    The default patterns do not match the usual types ``DiscountedUsage`` and
    ``SavingsPlanCoveredUsage``; pass patterns that do where those are meant.
    """
    found = ((F.col(LINE_TYPE).contains(text), model) for text, model in patterns)
    return first_match(found, "On-Demand")


@needs(SERVICE, LINE_TYPE, RESOURCE, COST, USAGE, START, "pricing_term", "reservation_reservation_a_r_n")
def current_agreements(
    cur: DataFrame,
    as_of: date,
    patterns: Sequence[tuple[str, str]] = PRICING_MODELS,
    exact: bool = False,
) -> DataFrame:
    """Reserved and savings-plan cost of the month per model and service.

    Resources count once per pricing term and reservation, as in the original;
    ``exact=True`` counts each once.
    """
    rows = cur.filter(positive_cost() & in_month(as_of)).withColumn(
        "agreement_type", pricing_model(patterns)
    )
    keys = ["agreement_type", SERVICE]
    terms = ["pricing_term", "reservation_reservation_a_r_n"]
    parts = (
        rows.filter(F.col("agreement_type").isin(*AGREEMENTS))
        .groupBy(*keys, *terms, RESOURCE)
        .agg(F.sum(COST).alias("cost"), F.sum(USAGE).alias("usage"))
    )
    resources = F.countDistinct(RESOURCE) if exact else F.count(RESOURCE)
    return (
        parts.groupBy("agreement_type", F.col(SERVICE).alias("service"))
        .agg(
            F.sum("cost").alias("monthly_cost"),
            F.sum("usage").alias("monthly_usage"),
            resources.alias("total_resources"),
        )
        .withColumn("annual_commitment", F.col("monthly_cost") * 12)
        .orderBy(F.desc("monthly_cost"), "agreement_type", "service")
    )


def agreement_totals(agreements: DataFrame) -> DataFrame:
    return agreements.agg(
        F.count("*").alias("agreements_count"),
        cents(F.coalesce(F.sum("annual_commitment"), F.lit(0.0))).alias(
            "total_annual_commitment"
        ),
    )


def _tier(position: int, default) -> Column:
    reached = ((F.col("current_spend") > tier[0], tier[position]) for tier in DISCOUNT_TIERS)
    return first_match(reached, default)


@needs(SERVICE, COST, START, ACCOUNT, RESOURCE)
def negotiation_opportunities(
    cur: DataFrame, as_of: date, months: int = 12, min_spend: float = 10000.0
) -> DataFrame:
    """Services whose yearly spend earns a volume discount."""
    rows = cur.filter(positive_cost() & since_months(as_of, months))
    return (
        by_keys_and_ids(rows, [SERVICE], [ACCOUNT, RESOURCE])
        .groupBy(F.col(SERVICE).alias("service"))
        .agg(
            F.sum("cost").alias("current_spend"),
            F.countDistinct(ACCOUNT).alias("account_count"),
            F.countDistinct(RESOURCE).alias("resource_count"),
        )
        .filter(F.col("current_spend") > min_spend)
        .withColumn("potential_discount_pct", _tier(1, 5))
        .select(
            "service",
            "current_spend",
            "potential_discount_pct",
            (F.col("current_spend") * F.col("potential_discount_pct") / 100).alias(
                "estimated_savings"
            ),
            _tier(2, "low").alias("negotiation_priority"),
            "account_count",
            "resource_count",
        )
        .orderBy(F.desc("estimated_savings"), "service")
    )


def negotiation_plan(opportunities: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Commitment, advice and market benchmark (service, average, top quartile)."""
    spend = F.col("current_spend")
    average, top = DEFAULT_BENCHMARK
    # The three recommendations.
    return opportunities.join(benchmarks, "service", "left").select(
        "service",
        "current_spend",
        "potential_discount_pct",
        "estimated_savings",
        F.when(spend > 500000, "3_year")
        .when(spend > 100000, "1_year")
        .otherwise("none")
        .alias("commitment_required"),
        F.when(
            (spend > 500000) & (F.col("potential_discount_pct") > 15),
            "Schedule enterprise negotiation meeting",
        )
        .when(spend > 100000, "Request volume discount review")
        .otherwise("Monitor for threshold achievement")
        .alias("recommendation"),
        F.coalesce("average_discount", F.lit(average)).alias("average_discount"),
        F.coalesce("top_quartile", F.lit(top)).alias("top_quartile"),
    )


def market_rates(opportunities: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Each benchmark beside our potential discount (0 where we have none)."""
    ours = opportunities.select("service", F.col("potential_discount_pct").alias("ours"))
    return benchmarks.join(ours, "service", "left").select(
        "service",
        F.col("average_discount").alias("industry_average"),
        F.col("top_quartile").alias("top_tier_discount"),
        F.coalesce("ours", F.lit(0)).alias("our_potential"),
    )


def negotiation_summary(opportunities: DataFrame) -> DataFrame:
    return opportunities.agg(
        F.count_if(F.col("negotiation_priority") == "high").alias("high_priority_services"),
        F.coalesce(F.sum("current_spend"), F.lit(0.0)).alias("total_annual_spend"),
        cents(F.coalesce(F.sum("estimated_savings"), F.lit(0.0))).alias(
            "potential_annual_savings"
        ),
    )


@needs(SERVICE, TYPE, COST, USAGE, START)
def usage_stability(
    cur: DataFrame, as_of: date, months: int = 6, limit: int | None = 20
) -> DataFrame:
    """Mean and spread of monthly usage per service and instance type."""
    monthly = (
        cur.filter(positive_cost() & since_months(as_of, months))
        .groupBy(month_of().alias("month"), SERVICE, TYPE)
        .agg(F.sum(USAGE).alias("usage"), cost_sum("cost"))
    )
    spread = ratio("usage_stddev", "avg_monthly_usage")
    return (
        monthly.groupBy(F.col(SERVICE).alias("service"), F.col(TYPE).alias("instance_type"))
        .agg(
            F.avg("usage").alias("avg_monthly_usage"),
            F.stddev_samp("usage").alias("usage_stddev"),
            F.avg("cost").alias("avg_monthly_cost"),
            F.count("*").alias("months_of_data"),
        )
        .filter("months_of_data >= 3 AND avg_monthly_usage > 0")
        .withColumn(
            "usage_pattern",
            F.when(spread < 0.2, "stable").when(spread < 0.5, "moderate").otherwise("volatile"),
        )
        .orderBy(F.desc("avg_monthly_cost"), "service", "instance_type")
        .transform(first_rows, limit)
    )


def seasonal_factor(month: str | Column) -> Column:
    m = F.col(month) if isinstance(month, str) else month
    return 1 + F.sin(m * math.pi / 6) * 0.1


def with_future_months(df: DataFrame, months: int) -> DataFrame:
    """One row per input row and month 1..n."""
    return df.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(months))))


def usage_forecast(stability: DataFrame, months: int = 12, growth: float = 0.02) -> DataFrame:
    """Seasonal, growing usage per service and type, priced at the average unit cost."""
    usage = F.col("avg_monthly_usage") * seasonal_factor("month") * F.pow(F.lit(1 + growth), "month")
    unit = F.col("avg_monthly_cost") / F.col("avg_monthly_usage")
    return with_future_months(stability, months).select(
        "service",
        "instance_type",
        "month",
        F.round(usage, 2).alias("forecasted_usage"),
        F.round(usage * unit, 2).alias("forecasted_cost"),
    )


def annual_usage_forecast(forecast: DataFrame) -> DataFrame:
    return forecast.groupBy("service", "instance_type").agg(
        F.sum("forecasted_usage").alias("total_usage"),
        F.sum("forecasted_cost").alias("total_cost"),
    )


def forecast_risk() -> Column:
    spread = ratio(F.coalesce("usage_stddev", F.lit(0.0)), "avg_monthly_usage")
    pattern = F.col("usage_pattern")
    return (
        F.when((pattern == "volatile") | (spread > 0.5), "high")
        .when(pattern == "moderate", "medium")
        .otherwise("low")
    )


def commitment_recommendations(stability: DataFrame, min_annual: float = 10000.0) -> DataFrame:
    """Reserved instances for stable use, savings plans for moderate use."""
    annual, stable = F.col("annual_cost"), F.col("usage_pattern") == "stable"

    def choose(reserved, plan):
        return F.when(stable, F.lit(reserved)).otherwise(F.lit(plan))

    return (
        stability.withColumn("risk_score", forecast_risk())
        .withColumn("annual_cost", F.col("avg_monthly_cost") * 12)
        .filter(
            (annual >= min_annual)
            & ((stable & (F.col("risk_score") == "low")) | (F.col("usage_pattern") == "moderate"))
        )
        .select(
            "service",
            "instance_type",
            "risk_score",
            choose("Reserved Instance", "Savings Plan").alias("recommendation"),
            choose("3_year", "1_year").alias("term"),
            choose(80, 60).alias("coverage"),
            choose("high", "medium").alias("confidence"),
            (annual * choose(0.4, 0.15)).alias("estimated_savings"),
        )
    )


def portfolio_risk(stability: DataFrame) -> DataFrame:
    """Risk level, stable share, diversification and confidence; one row."""
    n, high = F.col("total_services"), F.col("high_risk_services")
    one = stability.withColumn("risk", forecast_risk()).agg(
        F.count("*").alias("total_services"),
        F.count_if(F.col("risk") == "high").alias("high_risk_services"),
        F.count_if(F.col("usage_pattern") == "stable").alias("stable"),
        F.countDistinct("service").alias("services"),
    )
    stable_share = F.coalesce(F.round(ratio("stable", n) * 100, 1), F.lit(0.0))
    return one.select(
        F.when(high > n * 0.3, "high").when(high > 0, "medium").otherwise("low").alias(
            "portfolio_risk_level"
        ),
        stable_share.alias("stable_services_percentage"),
        "high_risk_services",
        "total_services",
        F.coalesce(F.least(F.lit(100.0), ratio("services", n) * 100), F.lit(0.0)).alias(
            "diversification_score"
        ),
        stable_share.alias("overall_confidence"),
    )


def service_confidence(stability: DataFrame) -> DataFrame:
    """Forecast confidence by usage pattern, per service and instance type."""
    pattern = F.col("usage_pattern")
    return stability.select(
        "service",
        "instance_type",
        F.when(pattern == "stable", 90).when(pattern == "moderate", 70).otherwise(40).alias("confidence"),
    )


@needs(COST, START, ACCOUNT)
def annual_baseline(cur: DataFrame, as_of: date, *by: str) -> DataFrame:
    """Month cost x 12, for the whole table or per ``by`` column; no cost filter."""
    month = cur.filter(in_month(as_of))
    return month.groupBy(*by).agg((F.sum(COST) * 12).alias("annual_spend"))


def commitment_scenarios(
    baseline: DataFrame, scenarios: Sequence[tuple[str, int, int]] = SCENARIOS
) -> DataFrame:
    """Every baseline row under every scenario.

    The scenarios are a literal array in the row, so nothing is joined.
    """
    options = F.array(
        *[
            F.struct(
                F.lit(f"scenario_{i}").alias("scenario_id"),
                F.lit(kind).alias("commitment_type"),
                F.lit(int(cover)).alias("coverage_percentage"),
                F.lit(int(off)).alias("discount_percentage"),
            )
            for i, (kind, cover, off) in enumerate(scenarios, start=1)
        ]
    )
    kind, cover = F.col("commitment_type"), F.col("coverage_percentage")
    off = F.col("discount_percentage") / 100
    covered, saved = F.col("covered_spend"), F.col("annual_savings")
    upfront = F.col("upfront_cost")
    return (
        baseline.select(*baseline.columns, F.inline(options))
        .withColumn("covered_spend", F.col("annual_spend") * cover / 100)
        .withColumn("annual_savings", covered * off)
        .withColumn(
            "net_annual_cost",
            covered * (1 - off) + F.col("annual_spend") * (100 - cover) / 100,
        )
        .withColumn("upfront_cost", covered * 0.1)
        .withColumn(
            "three_year_roi",
            F.when(upfront > 0, F.round((saved * 3 - upfront) / upfront * 100, 1)).otherwise(0.0),
        )
        .withColumn(
            "payback_period_months",
            F.when(saved > 0, F.round(upfront / (saved / 12), 1)).otherwise(0.0),
        )
        .withColumn(
            "risk_level",
            F.when(kind.startswith("3_year") | (cover > 80), "high")
            .when(kind.startswith("1_year") | (cover > 60), "medium")
            .otherwise("low"),
        )
    )


def best_scenarios(simulated: DataFrame, *by: str) -> DataFrame:
    """Best return, lowest risk and highest savings; the earlier scenario wins a tie."""
    risk = F.when(F.col("risk_level") == "low", 1).when(F.col("risk_level") == "medium", 2).otherwise(3)
    number = F.substring_index("scenario_id", "_", -1).cast("int")
    return simulated.groupBy(*by).agg(
        F.max_by("scenario_id", F.struct("three_year_roi", -number)).alias("best_roi_scenario"),
        F.min_by("scenario_id", F.struct(risk, number)).alias("lowest_risk_scenario"),
        F.max_by("scenario_id", F.struct("annual_savings", -number)).alias(
            "highest_savings_scenario"
        ),
    )
