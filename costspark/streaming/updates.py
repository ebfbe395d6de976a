"""Batch operators kept up to date as line items arrive."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from costspark.functions.dates import START, month_start, shift_months
from costspark.functions.filters import COST, positive_cost
from costspark.operators import forecast, optimize, spend
from costspark.operators.spend import RESOURCE, SERVICE
from costspark.streaming.alerts import trigger
from costspark.streaming.sum_log import MONTH, SumLog, delete, listed

POINTER = f"{MONTH} string, part string, level int, newest date"


@dataclass(frozen=True)
class Update:
    """An operator over sums of line items.

    ``roll`` turns lines into rows of ``keys``, ``month`` (yyyy-MM) and sums; equal keys of
    several batches add up.  ``result`` works on those rows as of a day.
    """

    roll: Callable[[DataFrame], DataFrame]
    keys: tuple[str, ...]
    result: Callable[[DataFrame, date], DataFrame]


def _daily_service(lines: DataFrame) -> DataFrame:
    """Cost per day and service: still a table of lines to the forecasts."""
    day = F.date_trunc("day", START)
    return (
        lines.filter(positive_cost())
        .groupBy(day.alias(START), SERVICE)
        .agg(F.sum(COST).alias(COST))
        .withColumn(MONTH, F.date_format(START, "yyyy-MM"))
    )


def _monthly_usage(lines: DataFrame) -> DataFrame:
    month = F.date_format(START, "yyyy-MM").alias(MONTH)
    return lines.filter(positive_cost()).groupBy(month, SERVICE, RESOURCE, optimize.TYPE).agg(*optimize.usage_sums())


def opportunities(min_records: int = 10) -> Update:
    """Idle resources and smaller sizes of the newest month as opportunity events."""

    def result(sums: DataFrame, as_of: date) -> DataFrame:
        now = sums.filter(F.col(MONTH) == as_of.strftime("%Y-%m"))
        idle_services = F.col(SERVICE).isin(list(optimize.IDLE_SERVICES))
        idle = optimize.idle_groups(now.filter(idle_services), limit=None).select(
            F.concat_ws("-", F.lit("idle"), "resource_id", "service").alias("opportunity_id"),
            F.lit("idle_resource").alias("type"),
            "potential_savings",
            F.lit(90).alias("confidence"),
            (F.col("status") == "idle").alias("action_required"),
        )
        sized = now.filter((F.col(SERVICE) == "AmazonEC2") & F.col(optimize.TYPE).isNotNull())
        smaller = optimize.smaller_groups(sized, min_records, limit=None).select(
            F.col("id").alias("opportunity_id"),
            F.lit("rightsizing").alias("type"),
            F.col("monthly_savings").alias("potential_savings"),
            F.col("confidence_score").alias("confidence"),
            F.lit(True).alias("action_required"),
        )
        return idle.unionByName(smaller)

    return Update(_monthly_usage, (SERVICE, RESOURCE, optimize.TYPE), result)


def service_forecasts() -> Update:
    """Six-month forecast per service."""

    def result(days: DataFrame, as_of: date) -> DataFrame:
        return forecast.service_forecast(forecast.service_trend(forecast.forecast_inputs(days, as_of)))

    return Update(_daily_service, (START, SERVICE), result)


def next_month() -> Update:
    """Next month's total."""

    def result(days: DataFrame, as_of: date) -> DataFrame:
        return spend.next_month_forecast(spend.invoice_summary(days, as_of))

    return Update(_daily_service, (START, SERVICE), result)


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """Batch numbers of the pointers that are complete, in order."""
    return sorted(int(p.split("batch=")[1].split("/")[0]) for p in listed(spark, path, "batch=*/_SUCCESS"))


def latest_result(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest complete result of ``start_updates``; None before the first."""
    done = _numbers(spark, f"{path}/pointers")
    return spark.read.parquet(f"{path}/results/batch={done[-1]}") if done else None


def _pointer(spark: SparkSession, path: str) -> tuple[list[tuple[str, str, int]], date | None]:
    """Entries of the log and the newest day of a pointer: a row for each part of a month."""
    rows = spark.read.schema(POINTER).parquet(path).collect()
    return [(r[MONTH], r["part"], r["level"]) for r in rows if r["part"] is not None], rows[0]["newest"]


def start_updates(
    lines: DataFrame,
    update: Update,
    path: str,
    mode: str = "real_time",
    minutes: int = 5,
    months: int = 12,
    fan: int = 8,
) -> StreamingQuery:
    """Add each micro-batch to sums by month, then run ``update`` on them as of the newest day so far.

    A batch appends its own sums to a log (``SumLog``; ``fan`` parts of a month are merged into one), so
    what is written follows the batch, and the operator reads the sums of the newest day's month and
    ``months`` before it: the work follows the batch and the sums, not the history of lines.  A batch is read
    once: its newest day is observed while its sums are written.  A pointer table, written last,
    names the parts of each month and the newest day; the newest day never goes back.  A batch
    that Spark repeats starts from the pointer before it and overwrites its own parts, so nothing is lost
    or doubled, and readers (``latest_result``) keep the earlier result until the new one is whole.
    """
    pointers = f"{path}/pointers"

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        earlier = [n for n in _numbers(spark, pointers) if n < number]
        entries, newest = _pointer(spark, f"{pointers}/batch={earlier[-1]}") if earlier else ([], None)
        seen = Observation()
        rolled = update.roll(batch.observe(seen, F.max(F.to_date(START)).alias("day")))
        log = SumLog(f"{path}/sums", update.keys, rolled.schema, list(entries), fan)
        log.append(rolled, number)
        newest = max((d for d in (newest, seen.get["day"]) if d is not None), default=None)
        if newest is None:
            return
        oldest = shift_months(month_start(newest), -months).strftime("%Y-%m")
        result = update.result(log.sums(spark, since=oldest), newest)
        result.write.mode("overwrite").parquet(f"{path}/results/batch={number}")
        rows = [(*e, newest) for e in log.entries] or [(None, None, None, newest)]
        spark.createDataFrame(rows, POINTER).coalesce(1).write.mode("overwrite").parquet(f"{pointers}/batch={number}")
        # Two pointers stay, for a batch that is repeated and for readers of the one before.
        log.sweep(spark, entries)
        for n in earlier[:-1]:
            delete(spark, f"{pointers}/batch={n}")
            delete(spark, f"{path}/results/batch={n}")

    return (
        lines.writeStream.foreachBatch(step)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(**trigger(mode, minutes))
        .start()
    )
