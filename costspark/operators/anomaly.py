"""Daily spend anomalies and monthly growth patterns."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costspark.functions.cases import first_match
from costspark.functions.dates import START, day_of, since_days, since_months
from costspark.functions.filters import COST, positive_cost
from costspark.functions.needs import needs
from costspark.functions.ratios import cents, ratio
from costspark.functions.top import first_rows
from costspark.operators.spend import REGION, SERVICE, cost_sum, monthly_cost

# Fixed values.
DEFAULT_CAUSE = "Unexpected cost variation detected"
GROWTH_STEPS = ((50, "rapid_growth"), (20, "growing"), (-10, "stable"))


def daily_spend(cur: DataFrame, as_of: date, lookback_days: int) -> DataFrame:
    """Cost per day, service and region; lines without either are left out."""
    return (
        cur.filter(positive_cost() & since_days(as_of, lookback_days))
        .filter(F.col(SERVICE).isNotNull() & F.col(REGION).isNotNull())
        .groupBy(day_of().alias("usage_date"), SERVICE, REGION)
        .agg(cost_sum("daily_cost"))
    )


def anomaly_type(mean: str, spread: str, k: float) -> Column:
    cost, band = F.col("daily_cost"), F.col(spread) * k
    return (
        F.when(cost > F.col(mean) + band, "high_spend_anomaly")
        .when((cost < F.col(mean) - band) & (cost > 0), "low_spend_anomaly")
        .otherwise("normal")
    )


@needs(START, COST, SERVICE, REGION)
def detect_anomalies(
    cur: DataFrame,
    as_of: date,
    lookback_days: int = 30,
    sensitivity: float = 2.0,
    limit: int | None = 20,
) -> DataFrame:
    """Days outside mean +- k standard deviations of their service and region.

    Facts are aggregated to days before the window, so a partition holds at
    most one row per day of the look-back however large the service is.
    """
    group = Window.partitionBy(SERVICE, REGION)
    stats = daily_spend(cur, as_of, lookback_days).withColumns(
        {
            "avg_daily_cost": F.avg("daily_cost").over(group),
            "sd": F.stddev_samp("daily_cost").over(group),
            "days": F.count("*").over(group),
        }
    )
    off = F.col("daily_cost") - F.col("avg_daily_cost")
    out = (
        stats.filter("days >= 7")
        .withColumn("anomaly_type", anomaly_type("avg_daily_cost", "sd", sensitivity))
        .filter("anomaly_type <> 'normal'")
        .select(
            "usage_date",
            SERVICE,
            REGION,
            "daily_cost",
            "avg_daily_cost",
            F.when(F.col("sd") > 0, F.abs(off) / F.col("sd")).otherwise(0.0).alias("z_score"),
            "anomaly_type",
            off.alias("cost_deviation"),
        )
        .orderBy(F.desc(F.abs("cost_deviation")), "usage_date", SERVICE, REGION)
    )
    return first_rows(out, limit)


def grade_anomalies(anomalies: DataFrame) -> DataFrame:
    """Severity and confidence from the z-score."""
    z = F.abs("z_score")
    clamped = F.least(F.lit(95.0), F.greatest(F.lit(60.0), 95 - (z - 2) * 10))
    return anomalies.withColumns(
        {
            "severity": F.when(z > 3, "high").when(z > 2.5, "medium").otherwise("low"),
            "confidence": F.round(clamped, 1),
            "cost_impact": F.abs("cost_deviation"),
        }
    )


def explain_anomalies(graded: DataFrame, root_causes: DataFrame) -> DataFrame:
    """Attach the root-cause text of (service, anomaly_type) and the usual factors."""
    causes = root_causes.select(
        F.col("service").alias(SERVICE), "anomaly_type", F.col("text").alias("cause")
    )
    factors = F.array_compact(
        F.array(
            F.when(F.col("cost_impact") > 1000, "large_cost_impact"),
            F.when(F.col(SERVICE) == "AmazonEC2", "check_autoscaling"),
            F.when(F.col("anomaly_type") == "high_spend_anomaly", "review_deployments"),
        )
    )
    return (
        graded.join(causes, [SERVICE, "anomaly_type"], "left")
        .withColumn("root_cause", F.coalesce("cause", F.lit(DEFAULT_CAUSE)))
        .withColumn("contributing_factors", factors)
        .drop("cause")
    )


def root_cause_summary(explained: DataFrame) -> DataFrame:
    """Frequency, impact and services per root cause."""
    return explained.groupBy("root_cause").agg(
        F.count("*").alias("frequency"),
        cents(F.sum("cost_impact")).alias("total_cost_impact"),
        F.array_sort(F.collect_set(SERVICE)).alias("affected_services"),
    )


def overrun_predictions(graded: DataFrame) -> DataFrame:
    """Services with more than one high-severity anomaly."""
    return (
        graded.groupBy(F.col(SERVICE).alias("service"))
        .agg(F.count_if(F.col("severity") == "high").alias("high_severity_count"))
        .filter("high_severity_count > 1")
        .withColumn(
            "probability", F.when(F.col("high_severity_count") > 2, "high").otherwise("medium")
        )
    )


@needs(START, COST, SERVICE)
def growth_patterns(
    cur: DataFrame, as_of: date, months: int = 6, min_avg: float = 1000.0
) -> DataFrame:
    """Spread between the cheapest and dearest month per service.

    (max - min) / min is never negative, so 'declining' cannot occur; the label
    stays in the list as in the original.
    """
    lowest, highest = F.min("monthly_cost"), F.max("monthly_cost")
    steps = ((F.col("growth_rate") > above, label) for above, label in GROWTH_STEPS)
    return (
        monthly_cost(cur.filter(positive_cost() & since_months(as_of, months)), SERVICE)
        .groupBy(F.col(SERVICE).alias("service"))
        .agg(
            F.avg("monthly_cost").alias("avg_monthly_spend"),
            F.stddev_samp("monthly_cost").alias("spend_volatility"),
            (F.try_divide(highest - lowest, lowest) * 100).alias("growth_rate"),
            F.count("*").alias("months_data"),
        )
        .filter((F.col("months_data") >= 3) & (F.col("avg_monthly_spend") > min_avg))
        .withColumn("pattern_type", first_match(steps, "declining"))
        .orderBy(F.desc("avg_monthly_spend"), "service")
    )


def grade_patterns(patterns: DataFrame) -> DataFrame:
    """Priority and confidence per pattern."""
    kind = F.col("pattern_type")

    def by_pattern(rapid: int, declining: int, other: int) -> Column:
        return F.when(kind == "rapid_growth", rapid).when(kind == "declining", declining).otherwise(other)

    return patterns.select(
        "service",
        "pattern_type",
        "avg_monthly_spend",
        F.round("growth_rate", 1).alias("growth_rate"),
        by_pattern(95, 70, 50).alias("priority_score"),
        by_pattern(90, 85, 75).alias("confidence"),
    )


def pattern_benchmarks(graded: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Spend against an industry average table (service, industry_average, efficiency_score)."""
    average, spend = F.col("industry_average"), F.col("avg_monthly_spend")
    percentile = 50 + ratio(average - spend, average) * 50
    return graded.join(benchmarks, "service").select(
        "service",
        spend.alias("our_monthly_spend"),
        "industry_average",
        F.when(spend > average, "above").otherwise("below").alias("vs_industry"),
        "efficiency_score",
        F.least(F.lit(95.0), F.greatest(F.lit(5.0), percentile)).alias("percentile"),
    )


def pattern_summary(graded: DataFrame) -> DataFrame:
    """Counts per pattern and mean growth; one row."""
    n, rapid = F.col("total_services_analyzed"), F.col("rapid_growth_services")
    return (
        graded.agg(
            F.count("*").alias("total_services_analyzed"),
            F.count_if(F.col("pattern_type") == "rapid_growth").alias("rapid_growth_services"),
            F.count_if(F.col("pattern_type") == "declining").alias("declining_services"),
            F.coalesce(F.round(F.avg("growth_rate"), 1), F.lit(0.0)).alias("avg_growth_rate"),
        )
        .withColumn("stable_services", n - rapid - F.col("declining_services"))
        .withColumn("growth_volatility", F.when(rapid > n * 0.3, "high").otherwise("low"))
    )


def pattern_recommendations(graded: DataFrame) -> DataFrame:
    """Services whose priority is above 80."""
    return graded.filter("priority_score > 80").select(
        "service",
        F.lit("ai_optimization").alias("type"),
        F.lit("high").alias("priority"),
        "pattern_type",
        "confidence",
    )
