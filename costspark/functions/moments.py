"""Count, mean and squared deviations of a group, which merge exactly from parts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def moments(value: str) -> list[Column]:
    """Aggregates n, mean, m2 (sum of squared deviations from the mean) of a column; null values don't count."""
    return [F.count(value).alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count(value)).alias("m2")]


def merge_moments(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row (n, mean, m2) per key of rows of moments, by the rule for parallel variance.

    Two parts make n = a + b, mean = mean_a + d * b / n and m2 = m2_a + m2_b + d^2 * a * b / n, d being the
    difference of the means: no sum of squares, so nothing cancels.  A key has as many rows as there are parts.
    """
    rows = F.filter(F.collect_list(F.struct("n", "mean", "m2")), lambda p: p["n"] > 0)
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def both(a: Column, b: Column) -> Column:
        n, d = a["n"] + b["n"], b["mean"] - a["mean"]
        return F.struct(
            n.alias("n"),
            (a["mean"] + d * b["n"] / n).alias("mean"),
            (a["m2"] + b["m2"] + d * d * a["n"] * b["n"] / n).alias("m2"),
        )

    merged = parts.groupBy(*keys).agg(F.aggregate(F.array_sort(rows), zero, both).alias("all"))
    return merged.select(*keys, "all.n", "all.mean", "all.m2")


def spread() -> Column:
    """The sample standard deviation of n, mean, m2; null below two values."""
    return F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)))
