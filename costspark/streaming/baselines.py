"""Anomaly alerts whose baseline follows the days that have closed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from costspark.functions.dates import START
from costspark.functions.filters import COST
from costspark.functions.moments import merge_moments, moments, spread
from costspark.operators.spend import REGION, SERVICE
from costspark.streaming.alerts import anomaly_alerts, daily_cost_stream, trigger
from costspark.streaming.sum_log import delete, listed

KEYS = (SERVICE, REGION)
PARTS = f"{SERVICE} string, {REGION} string, n bigint, mean double, m2 double"


def _newest(spark: SparkSession, path: str, below: int | None = None) -> int | None:
    numbers = [int(p.split("batch=")[1].split("/")[0]) for p in listed(spark, f"{path}/moments", "batch=*/_SUCCESS")]
    return max((n for n in numbers if below is None or n < below), default=None)


def _baseline(parts: DataFrame, min_days: int) -> DataFrame:
    return parts.filter(F.col("n") >= min_days).select(*KEYS, F.col("mean").alias("avg_daily_cost"), spread().alias("sd"))


def following_baseline(spark: SparkSession, path: str, min_days: int = 7) -> DataFrame | None:
    """The baseline of all closed days so far (see ``alerts.anomaly_baseline``); None before the first."""
    newest = _newest(spark, path)
    if newest is None:
        return None
    return _baseline(spark.read.schema(PARTS).parquet(f"{path}/moments/batch={newest}"), min_days)


def start_following_alerts(
    lines: DataFrame,
    path: str,
    sensitivity: float = 2.0,
    min_days: int = 7,
    time: str = START,
    cost: str = COST,
    delay: str = "2 days",
    mode: str = "real_time",
    minutes: int = 5,
) -> StreamingQuery:
    """Append to ``path``/alerts the closed days that lie outside the baseline of the days closed before them.

    The state is a row of moments (n, mean, m2 of the daily cost) per service and region, however long the history:
    a batch judges its days by the moments so far, then merges its own into them and writes them
    under its number.  So after any batches the baseline equals average and deviation over all closed days.
    A repeated batch starts from the moments before it and overwrites its own.
    """

    def step(days: DataFrame, number: int) -> None:
        spark = days.sparkSession
        before = _newest(spark, path, number)
        earlier = spark.read.schema(PARTS).parquet(f"{path}/moments/batch={before}") if before is not None else None
        if earlier is not None:
            alerts = anomaly_alerts(days, _baseline(earlier, min_days), sensitivity)
            alerts.write.mode("overwrite").parquet(f"{path}/alerts/batch={number}")
        own = days.filter(F.col(SERVICE).isNotNull() & F.col(REGION).isNotNull())
        own = own.groupBy(*KEYS).agg(*moments("current_cost"))
        parts = own if earlier is None else merge_moments(earlier.unionByName(own), KEYS)
        parts.select(*KEYS, "n", "mean", "m2").write.mode("overwrite").parquet(f"{path}/moments/batch={number}")
        for old in listed(spark, f"{path}/moments", "batch=*"):  # two stay, for a batch that is repeated
            if int(old.rsplit("=", 1)[1]) < (number if before is None else before):
                delete(spark, old)

    return (
        daily_cost_stream(lines, *KEYS, time=time, cost=cost, delay=delay)
        .writeStream.outputMode("append")
        .foreachBatch(step)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(**trigger(mode, minutes))
        .start()
    )
