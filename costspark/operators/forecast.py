"""Monthly forecasts per service and the questions asked of a month."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costspark.functions.dates import START, in_month, since_months
from costspark.functions.filters import COST, positive_cost
from costspark.functions.needs import needs
from costspark.functions.ratios import cents, ratio
from costspark.functions.top import first_rows
from costspark.operators.commit import seasonal_factor, with_future_months
from costspark.operators.spend import REGION, RESOURCE, SERVICE, cost_sum, monthly_cost

# Fixed values: (scenario, factor, probability).
SCENARIOS = (("optimistic", 0.85, 25), ("baseline", 1.0, 50), ("pessimistic", 1.2, 25))


@needs(START, COST, SERVICE)
def forecast_inputs(cur: DataFrame, as_of: date, months: int = 12) -> DataFrame:
    """Monthly cost per service with the row before and the row 12 back."""
    rows = Window.partitionBy(SERVICE).orderBy("month")
    return (
        monthly_cost(cur.filter(positive_cost() & since_months(as_of, months)), SERVICE)
        .select(
            "month",
            SERVICE,
            "monthly_cost",
            F.lag("monthly_cost", 1).over(rows).alias("prev_month_cost"),
            F.lag("monthly_cost", 12).over(rows).alias("year_ago_cost"),
        )
        .orderBy(SERVICE, "month")
    )


def service_trend(inputs: DataFrame, recent: int = 6, min_months: int = 3) -> DataFrame:
    """Latest cost and mean monthly change of the last ``recent`` rows per service.

    The mean of consecutive differences is (last - first) / (n - 1).
    """
    group = Window.partitionBy(SERVICE)
    numbered = inputs.select(
        SERVICE,
        "month",
        "monthly_cost",
        F.row_number().over(group.orderBy(F.desc("month"))).alias("back"),
        F.count("*").over(group).alias("months"),
    )
    first, last = F.min_by("monthly_cost", "month"), F.max_by("monthly_cost", "month")
    change, base = F.col("avg_change"), F.col("base_cost")
    certainty = F.when(
        base > 0, F.greatest(F.lit(60.0), 90 - F.try_divide(F.abs(change), base) * 100)
    ).otherwise(60.0)
    return (
        numbered.filter((F.col("months") >= min_months) & (F.col("back") <= recent))
        .groupBy(F.col(SERVICE).alias("service"))
        .agg(last.alias("base_cost"), ((last - first) / (F.count("*") - 1)).alias("avg_change"))
        .withColumn("confidence", F.round(certainty, 1))
        .withColumn("trend", F.when(change > 0, "increasing").otherwise("decreasing"))
    )


def service_forecast(trend: DataFrame, months: int = 6) -> DataFrame:
    """Linear trend with a season and a band of 15 %, never below 0."""
    raw = (F.col("base_cost") + F.col("avg_change") * F.col("month")) * seasonal_factor("month")
    floor = F.lit(0.0)
    return with_future_months(trend, months).select(
        "service",
        "month",
        F.greatest(floor, raw).alias("forecasted_cost"),
        F.greatest(floor, raw * 0.85).alias("lower"),
        (raw * 1.15).alias("upper"),
        "confidence",
        "trend",
    )


def service_forecast_totals(forecast: DataFrame) -> DataFrame:
    return forecast.groupBy("service", "confidence", "trend").agg(
        F.sum("forecasted_cost").alias("total_forecasted")
    )


def forecast_summary(totals: DataFrame) -> DataFrame:
    """Services, total, growing and shrinking services, mean confidence; one row."""
    return totals.agg(
        F.count("*").alias("total_services_forecasted"),
        cents(F.coalesce(F.sum("total_forecasted"), F.lit(0.0))).alias("total_forecasted_cost"),
        F.count_if(F.col("trend") == "increasing").alias("growth_services"),
        F.count_if(F.col("trend") == "decreasing").alias("declining_services"),
        F.coalesce(F.round(F.avg("confidence"), 1), F.lit(0.0)).alias("forecast_confidence"),
    )


def forecast_scenarios(totals: DataFrame) -> DataFrame:
    """The total under three scenarios."""
    total = F.coalesce(F.sum("total_forecasted"), F.lit(0.0)).alias("total")
    cases = F.array(
        *[
            F.struct(
                F.lit(name).alias("scenario"),
                (F.col("total") * factor).alias("total_cost"),
                F.lit(chance).alias("probability"),
            )
            for name, factor, chance in SCENARIOS
        ]
    )
    return totals.agg(total).select(F.inline(cases))


def _priced_month(cur: DataFrame, as_of: date) -> DataFrame:
    return cur.filter(positive_cost() & in_month(as_of))


@needs(START, COST, SERVICE, RESOURCE)
def highest_cost_services(cur: DataFrame, as_of: date, limit: int | None = 5) -> DataFrame:
    return (
        _priced_month(cur, as_of)
        .groupBy(SERVICE)
        .agg(cost_sum("total_cost"), F.countDistinct(RESOURCE).alias("resource_count"))
        .orderBy(F.desc("total_cost"), SERVICE)
        .transform(first_rows, limit)
    )


@needs(START, COST)
def spend_trend(cur: DataFrame, as_of: date, months: int = 6) -> DataFrame:
    return monthly_cost(cur.filter(positive_cost() & since_months(as_of, months))).orderBy("month")


@needs(START, COST, REGION, SERVICE)
def region_costs(cur: DataFrame, as_of: date) -> DataFrame:
    return (
        _priced_month(cur, as_of)
        .groupBy(REGION)
        .agg(cost_sum("total_cost"), F.countDistinct(SERVICE).alias("service_count"))
        .orderBy(F.desc("total_cost"))
    )


@needs(START, COST)
def month_total(cur: DataFrame, as_of: date) -> DataFrame:
    return (
        _priced_month(cur, as_of)
        .agg(cost_sum("value"))
        .select(F.lit("total_spend").alias("metric"), "value")
    )


@needs(START, COST, SERVICE, RESOURCE)
def month_overview(cur: DataFrame, as_of: date) -> DataFrame:
    """Month cost with distinct services and resources; one row."""
    return _priced_month(cur, as_of).groupBy(SERVICE, RESOURCE).agg(cost_sum("cost")).agg(
        F.sum("cost").alias("total_monthly_cost"),
        F.countDistinct(SERVICE).alias("service_count"),
        F.countDistinct(RESOURCE).alias("resource_count"),
    )


def trend_change(trend: DataFrame) -> DataFrame:
    """Change of the last month of ``spend_trend`` against the one before; one row."""
    before = F.lag("monthly_cost").over(Window.orderBy("month"))
    one = trend.withColumn("before", before).agg(
        F.max("month").alias("month"),
        F.max_by("monthly_cost", "month").alias("latest_cost"),
        F.max_by("before", "month").alias("previous_cost"),
    )
    change = ratio(F.col("latest_cost") - F.col("previous_cost"), "previous_cost") * 100
    return one.withColumn("change_pct", change).withColumn(
        "direction", F.when(F.col("change_pct") > 0, "increased").otherwise("decreased")
    )
