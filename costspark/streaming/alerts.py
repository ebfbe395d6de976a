"""Daily cost per service on a stream, and the alerts it raises.

State is one sum per open day, service and region; the watermark closes a day
and drops later rows for it (``closed_days`` keeps them and corrects the month).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from costspark.functions.cases import first_match
from costspark.functions.dates import START
from costspark.functions.filters import COST
from costspark.functions.ratios import ratio
from costspark.operators.anomaly import anomaly_type
from costspark.operators.spend import REGION, SERVICE
from costspark.streaming.sum_log import listed

# How often a stream runs.
MODES = ("real_time", "batched", "scheduled")
# Share of the threshold that warns before it is passed; then severity steps
# (share of the threshold above, severity).
REACHED = 0.8
# Shares of a monthly budget whose crossing is told.
MONTH_LEVELS = (0.8, 1.0, 1.2, 1.5)
SEVERITY = ((1.5, "critical"), (1.2, "high"), (1.0, "medium"))


def daily_cost_stream(
    lines: DataFrame, *keys: str, time: str = START, cost: str = COST, delay: str = "2 days"
) -> DataFrame:
    """Cost per day and ``keys``; a day is final once ``delay`` has passed it."""
    keys = keys or (SERVICE,)
    return (
        lines.withWatermark(time, delay)
        .groupBy(F.window(time, "1 day"), *keys)
        .agg(F.sum(cost).alias("current_cost"))
        .select(F.to_date("window.start").alias("usage_date"), *keys, "current_cost")
    )


def _severity(share: Column) -> Column:
    return first_match(((share > above, name) for above, name in SEVERITY), "low")


def budget_alerts(daily: DataFrame, budgets: DataFrame, reached: float = REACHED) -> DataFrame:
    """Days at or near the service's threshold (service, threshold).

    Works on a batch of days and on the stream alike: the budgets are static.
    """
    share = ratio("current_cost", "threshold")
    limits = budgets.select(F.col("service").alias(SERVICE), "threshold")
    return (
        daily.join(limits, SERVICE)
        .filter(share >= reached)
        .select(
            F.concat_ws("-", F.lit("budget"), F.col("usage_date").cast("string"), SERVICE).alias("alert_id"),
            F.when(share > 1, "budget_exceeded").otherwise("threshold_reached").alias("alert_type"),
            F.col(SERVICE).alias("service"),
            "current_cost",
            "threshold",
            _severity(share).alias("severity"),
            "usage_date",
        )
    )


def month_to_date_alerts(daily: DataFrame, budgets: DataFrame, levels: tuple[float, ...] = MONTH_LEVELS) -> DataFrame:
    """The first day of a month on which a service's cost so far reaches a level of its monthly budget.

    ``daily``: usage_date, service, current_cost; ``budgets``: service, budget.  One row for each (service,
    month, level), levels being shares of the budget; several on one day if it passes several.
    """
    month = F.date_trunc("month", "usage_date").cast("date")
    so_far = Window.partitionBy(SERVICE, "month").orderBy("usage_date").rowsBetween(Window.unboundedPreceding, 0)
    limits = budgets.filter("budget > 0").select(F.col("service").alias(SERVICE), "budget")
    days = daily.groupBy("usage_date", SERVICE).agg(F.sum("current_cost").alias("current_cost"))
    run = (
        days.join(limits, SERVICE)
        .withColumn("month", month)
        .withColumn("month_to_date", F.sum("current_cost").over(so_far))
        .withColumn("level", F.explode(F.array(*map(F.lit, levels))))
        .filter(F.col("month_to_date") >= F.col("level") * F.col("budget"))
    )
    first = run.groupBy(SERVICE, "month", "level").agg(
        F.min(F.struct("usage_date", "month_to_date", "budget")).alias("at")
    )
    share = ratio("at.month_to_date", "at.budget")
    return first.select(
        F.concat_ws("-", F.lit("month"), F.date_format("month", "yyyy-MM"), SERVICE, F.col("level").cast("string")).alias("alert_id"),
        F.when(F.col("level") >= 1, "budget_exceeded").otherwise("threshold_reached").alias("alert_type"),
        F.col(SERVICE).alias("service"),
        "month",
        "level",
        F.col("at.usage_date").alias("crossed_on"),
        F.col("at.month_to_date").alias("month_to_date"),
        F.col("at.budget").alias("budget"),
        _severity(share).alias("severity"),
    )


def start_month_alerts(
    lines: DataFrame,
    budgets: DataFrame,
    path: str,
    levels: tuple[float, ...] = MONTH_LEVELS,
    time: str = START,
    cost: str = COST,
    delay: str = "2 days",
    mode: str = "real_time",
    minutes: int = 5,
) -> StreamingQuery:
    """Append to ``path``/alerts each crossing of a monthly budget, once, as its day closes.

    Days become final in order (``daily_cost_stream``) and are kept by batch and month in ``path``/days.  A
    batch sums the months that it touches, a row a day and service, and appends the crossings that fall on
    its own days, so a level crossed by several batches together is told by the one that crosses
    it.  A repeated batch overwrites its own days and alerts.
    """

    def step(days: DataFrame, number: int) -> None:
        spark = days.sparkSession
        own = f"{path}/days/batch={number}"
        dated = days.withColumn("month", F.date_format("usage_date", "yyyy-MM"))
        dated.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("month").parquet(own)
        months = sorted(p.rsplit("=", 1)[1] for p in listed(spark, own, "month=*"))
        if not months:
            return
        kinds = f"usage_date date, {SERVICE} string, current_cost double, month string, batch long"
        past = spark.read.schema(kinds).parquet(f"{path}/days").filter(F.col("month").isin(months) & (F.col("batch") <= number))
        first = past.filter(F.col("batch") == number).agg(F.min("usage_date")).first()[0]
        alerts = month_to_date_alerts(past, budgets, levels).filter(F.col("crossed_on") >= F.lit(first))
        alerts.write.mode("overwrite").parquet(f"{path}/alerts/batch={number}")

    daily = daily_cost_stream(lines, SERVICE, time=time, cost=cost, delay=delay)
    return (
        daily.writeStream.outputMode("append")
        .foreachBatch(step)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(**trigger(mode, minutes))
        .start()
    )


def month_alerts(spark: SparkSession, path: str) -> DataFrame:
    """The alerts of ``start_month_alerts`` so far."""
    return spark.read.option("recursiveFileLookup", True).parquet(f"{path}/alerts")


def anomaly_baseline(daily: DataFrame) -> DataFrame:
    """Mean and spread of daily cost per service and region, a week at least.

    Every micro-batch reads the static side again, so write the baseline (see
    ``runtime.materialise``) before a long-running stream joins it.
    """
    return (
        daily.groupBy(SERVICE, REGION)
        .agg(
            F.avg("daily_cost").alias("avg_daily_cost"),
            F.stddev_samp("daily_cost").alias("sd"),
            F.count("*").alias("days"),
        )
        .filter("days >= 7")
        .drop("days")
    )


def anomaly_alerts(daily: DataFrame, baseline: DataFrame, sensitivity: float = 2.0) -> DataFrame:
    """Days outside the static baseline of their service and region."""
    off = F.col("daily_cost") - F.col("avg_daily_cost")
    z = F.abs(ratio(off, "sd"))
    return (
        daily.withColumnRenamed("current_cost", "daily_cost")
        .join(baseline, [SERVICE, REGION])
        .withColumn("anomaly_type", anomaly_type("avg_daily_cost", "sd", sensitivity))
        .filter("anomaly_type <> 'normal'")
        .select(
            F.lit("unusual_spike").alias("alert_type"),
            F.col(SERVICE).alias("service"),
            F.col(REGION).alias("region"),
            F.col("daily_cost").alias("current_cost"),
            (F.col("avg_daily_cost") + F.col("sd") * sensitivity).alias("threshold"),
            "anomaly_type",
            F.when(z > 3, "high").when(z > 2.5, "medium").otherwise("low").alias("severity"),
            "usage_date",
        )
    )


def trigger(mode: str, minutes: int = 5) -> dict[str, object]:
    """``writeStream.trigger`` arguments of a delivery mode."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode == "scheduled":
        return {"availableNow": True}
    return {"processingTime": f"{minutes} minutes" if mode == "batched" else "0 seconds"}


def start_sink(
    events: DataFrame, path: str, checkpoint: str, mode: str = "real_time", minutes: int = 5
) -> StreamingQuery:
    """Append final rows to a Parquet table, exactly once."""
    return (
        events.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger(mode, minutes))
        .start()
    )
