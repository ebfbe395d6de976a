"""Daily cost of closed days as a table of months, corrected when rows come after their day was closed."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from costspark.functions.dates import START
from costspark.functions.filters import COST
from costspark.operators.spend import REGION, SERVICE
from costspark.streaming.alerts import trigger
from costspark.streaming.sum_log import MONTH, SumLog, delete, listed

POINTER = f"{MONTH} string, part string, level int, newest timestamp_ntz"
MEASURES = ["current_cost", "lines", "late_lines"]


def closed_before(newest: datetime | None, delay_days: int) -> date | None:
    """Days before this one are closed once ``newest`` is the newest event."""
    return (newest - timedelta(days=delay_days)).date() if newest else None


def _month(day: date) -> str:
    return day.strftime("%Y-%m")


def start_closed_days(
    lines: DataFrame,
    path: str,
    keys: tuple[str, ...] = (SERVICE, REGION),
    time: str = START,
    cost: str = COST,
    delay_days: int = 2,
    mode: str = "real_time",
    minutes: int = 5,
    fan: int = 8,
) -> StreamingQuery:
    """Keep ``path``/served: usage_date, ``keys``, current_cost, lines, late_lines of every closed day, by month.

    A day closes when it ends ``delay_days`` before the newest event of the batches so far.  Rows that
    come after the close of their day, which a watermark would drop, are kept whole in ``path``/late and
    added: their months are summed again and replaced (dynamic partition overwrite), and nothing else
    is.  So the table equals a batch sum over all rows of closed days, whatever their order.

    Sums are a log of parts (``SumLog``), the pointer is written last, and a repeated batch
    overwrites what it wrote.  Rows without a time take no part.
    """
    pointers, served = f"{path}/pointers", f"{path}/served"

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        numbers = [int(p.split("batch=")[1].split("/")[0]) for p in listed(spark, pointers, "batch=*/_SUCCESS")]
        earlier = sorted(n for n in numbers if n < number)
        entries, newest = [], None
        if earlier:
            held = spark.read.schema(POINTER).parquet(f"{pointers}/batch={earlier[-1]}").collect()  # parts of months
            entries, newest = [(r[MONTH], r["part"], r["level"]) for r in held], held[0]["newest"]
        bound = closed_before(newest, delay_days)
        day = F.to_date(F.col(time))
        late = F.coalesce(day < F.lit(bound), F.lit(False)) if bound else F.lit(False)
        seen = Observation()
        rows = batch.filter(F.col(time).isNotNull())
        if bound:
            rows.filter(late).write.mode("overwrite").parquet(f"{path}/late/batch={number}")
        rolled = (
            rows.observe(seen, F.max(F.col(time).cast("timestamp_ntz")).alias("newest"))
            .groupBy(day.alias("usage_date"), *keys)
            .agg(F.sum(cost).alias("current_cost"), F.count("*").alias("lines"), F.count_if(late).alias("late_lines"))
            .withColumn(MONTH, F.date_format("usage_date", "yyyy-MM"))
        )
        log = SumLog(f"{path}/sums", ("usage_date", *keys), rolled.schema, list(entries), fan)
        touched = log.append(rolled, number)
        newest = max((t for t in (newest, seen.get["newest"]) if t is not None), default=None)
        if newest is None:
            return
        now = closed_before(newest, delay_days)
        first = _month(bound) if bound else ""
        months = {m for m, _, _ in log.entries if first <= m <= _month(now)}  # days closed by this batch
        months |= {m for m in touched if m <= first}  # late rows, or open days of the month of the bound
        table = log.sums(spark, months=sorted(months)).filter(F.col("usage_date") < F.lit(now))
        table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(served)
        spark.createDataFrame([(*e, newest) for e in log.entries], POINTER).coalesce(1).write.mode("overwrite").parquet(
            f"{pointers}/batch={number}"
        )
        log.sweep(spark, entries)
        for n in earlier[:-1]:
            delete(spark, f"{pointers}/batch={n}")

    return (
        lines.writeStream.foreachBatch(step)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(**trigger(mode, minutes))
        .start()
    )
