"""Data-quality report of a billing table and checks of billing periods."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costspark.functions.dates import START
from costspark.functions.filters import COST
from costspark.operators.spend import SERVICE
from costspark.sources.exports import EXPORTS

CRITICAL = (COST, SERVICE)


def row_hashes(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes of the whole row, maps compared as sorted entries."""
    parts = [
        F.array_sort(F.map_entries(f.name)) if isinstance(f.dataType, T.MapType) else F.col(f.name)
        for f in df.schema.fields
    ]
    return [F.xxhash64(*parts), F.xxhash64(F.lit("second"), *parts)]


def quality_report(df: DataFrame, as_of: date) -> DataFrame:
    """One row: counts, null shares, freshness, duplicates, issues and score.

    Duplicates are rows minus distinct rows; rows are compared by a 128-bit
    hash, so only hashes are shuffled, and repeated rows collapse before that.
    Issues cost 20 points and warnings 5.
    """
    first, second = row_hashes(df)
    measures = _measures(df.columns)
    wanted = [c for c in (*CRITICAL, START) if c in df.columns]
    rows = df.select(*dict.fromkeys(wanted), first.alias("h1"), second.alias("h2"))
    return _report(rows.agg(*measures, F.countDistinct("h1", "h2").alias("distinct_rows")), df.columns, as_of)


def _measures(columns: Sequence[str]) -> list[Column]:
    """What the report takes from the rows, but for distinct rows."""
    measures = [
        F.count(F.lit(1)).alias("total_rows"),
        (F.count_if(F.col(COST) < 0) if COST in columns else F.lit(0)).alias("negative_costs"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in CRITICAL if c in columns],
    ]
    if START in columns:
        measures.append(F.max(F.to_date(START)).alias("latest_date"))
    return measures


def observe_quality(df: DataFrame) -> tuple[DataFrame, Observation]:
    """``df`` that counts what ``observed_report`` needs while a job, a copy for one, runs through it once."""
    seen = Observation()
    return df.observe(seen, *_measures(df.columns)), seen


def observed_report(seen: Observation, copy: DataFrame, as_of: date) -> DataFrame:
    """``quality_report`` of rows that were copied under ``observe_quality``.

    Counts come from the copying job; only duplicates read the copy. Waits for that job.
    """
    found = seen.get
    kind = lambda name: "date" if name == "latest_date" else "bigint"
    schema = ", ".join(f"`{name}` {kind(name)}" for name in found)
    one = copy.sparkSession.createDataFrame([tuple(found.values())], schema)
    first, second = row_hashes(copy)
    hashes = copy.select(first.alias("h1"), second.alias("h2"))
    return _report(one.withColumn("distinct_rows", hashes.agg(F.countDistinct("h1", "h2")).scalar()), copy.columns, as_of)


def _report(one: DataFrame, columns: Sequence[str], as_of: date) -> DataFrame:
    """The report from one row of measures."""
    present = [c for c in CRITICAL if c in columns]
    total = F.col("total_rows")
    share = {c: F.try_divide(F.col(f"null_{c}"), total) * 100 for c in present}
    age = F.date_diff(F.lit(as_of), "latest_date") if START in columns else F.lit(None).cast("int")
    duplicates = total - F.col("distinct_rows")
    text = lambda pattern, *cs: F.format_string(pattern, *cs)
    empty = total == 0
    # Texts of issues and warnings.
    issues = F.array_compact(
        F.array(
            F.when(empty, "Table is empty"),
            F.lit(None if COST in columns else f"Missing required column: {COST}"),
            *[
                F.when(s > 10, text(f"High null percentage in {c}: %.1f%%", s))
                for c, s in share.items()
            ],
        )
    )
    warnings = F.array_compact(
        F.array(
            F.when(
                F.col("negative_costs") > 0,
                text("Found %d rows with negative costs", F.col("negative_costs")),
            ),
            *[
                F.when((s > 0) & (s <= 10), text(f"Some null values in {c}: %.1f%%", s))
                for c, s in share.items()
            ],
            F.when(age > 7, text("Data may be stale - latest date is %d days old", age)),
            F.when(
                duplicates > 0,
                text(
                    "Found %d duplicate rows (%.1f%%)",
                    duplicates,
                    F.try_divide(duplicates, total) * 100,
                ),
            ),
        )
    )
    score = 100.0 - 20 * F.size("issues") - 5 * F.size("warnings")
    return one.select(
        total,
        F.lit(len(columns)).alias("total_columns"),
        "negative_costs",
        *[F.round(s, 4).alias(f"null_pct_{c}") for c, s in share.items()],
        age.alias("days_old"),
        duplicates.alias("duplicate_rows"),
        issues.alias("issues"),
        warnings.alias("warnings"),
    ).select(
        "*",
        (F.size("issues") == 0).alias("valid"),
        F.when(total == 0, 0.0)
        .otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), score)))
        .alias("data_quality_score"),
    )


def check_date_range(
    start: str | None, end: str | None, export_type: str = "CUR2.0"
) -> list[str]:
    """Problems of a read range; empty when it is fine."""
    kind = EXPORTS[export_type]
    problems = [
        f"{name} format invalid. Expected: {kind.date_format}"
        for name, value in (("start_date", start), ("end_date", end))
        if value and not re.match(kind.pattern, value)
    ]
    if start and end and start > end:
        problems.append("start_date cannot be after end_date")
    return problems


def check_periods(df: DataFrame, column: str, export_type: str = "CUR2.0") -> DataFrame:
    """Rows per partition value with whether the value has the export's format."""
    return (
        df.groupBy(F.col(column).cast("string").alias("period"))
        .agg(F.count("*").alias("rows"))
        .withColumn(
            "valid", F.coalesce(F.col("period").rlike(EXPORTS[export_type].pattern), F.lit(False))
        )
    )
