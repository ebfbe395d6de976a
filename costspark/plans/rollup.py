"""Stored roll-ups: daily sums by key and monthly sketches, replaced month by month."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costspark.functions.dates import START
from costspark.functions.filters import COST
from costspark.operators.spend import ACCOUNT, REGION, RESOURCE, SERVICE

USAGE = "line_item_usage_amount"
TYPE = "product_instance_type"
MONTH = "rollup_month"


def daily_rollup(cur: DataFrame, keys: Sequence[str] = (SERVICE, REGION, TYPE)) -> DataFrame:
    """Cost, usage and lines per day and ``keys``, under the names of the facts.

    Still a table of lines to the operators that sum by month (``invoice_summary``, ``cost_trend``,
    ``usage_stability``, ``growth_patterns``, ``forecast_inputs`` and their like): days, not months, are the grain,
    so a look-back that begins inside a month takes the same days; charges (cost above zero) and the rest
    have rows of their own, so a filter on positive cost takes the same lines.
    """
    day = F.date_trunc("day", START).cast(cur.schema[START].dataType)
    return (
        cur.groupBy(day.alias(START), *keys, (F.col(COST) > 0).alias("charge"))
        .agg(F.sum(COST).alias(COST), F.sum(USAGE).alias(USAGE), F.count("*").alias("lines"))
        .withColumn(MONTH, F.date_format(START, "yyyy-MM"))
    )


def monthly_sketches(
    cur: DataFrame, keys: Sequence[str] = (ACCOUNT, SERVICE), counted: str = RESOURCE, precision: int = 12
) -> DataFrame:
    """A HyperLogLog sketch of ``counted`` per month and ``keys``: a few KB however many values.

    With ``precision`` p the relative standard error of a count is about 1.04 / sqrt(2^p), 1.6 % at 12.
    """
    return cur.groupBy(*keys, F.date_format(START, "yyyy-MM").alias(MONTH)).agg(
        F.hll_sketch_agg(counted, precision).alias("sketch"), F.count(counted).alias("counted_lines")
    )


def store(rollup: DataFrame, path: str) -> DataFrame:
    """Write the months that ``rollup`` holds, in place of what ``path`` has of them; other months stay."""
    rollup.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path)
    return stored(rollup.sparkSession, path, rollup)


def stored(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The stored roll-up; the schema is that of ``like``, so no footer is read."""
    return spark.read.schema(like.schema).parquet(path)


def approximate_distinct(sketches: DataFrame, *keys: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Distinct values per ``keys`` (none: over all) in a range of months, from sketches alone: no facts are read."""
    rows = sketches
    if start:
        rows = rows.filter(F.col(MONTH) >= start)
    if end:
        rows = rows.filter(F.col(MONTH) <= end)
    rows = rows.filter("sketch IS NOT NULL")
    estimate = F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("approx_distinct")
    return rows.groupBy(*keys).agg(estimate, F.sum("counted_lines").alias("counted_lines"))
