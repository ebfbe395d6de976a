"""The eight dashboard tables in one run."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costspark.functions.dates import since_months
from costspark.operators import allocate, anomaly, commit, kpi, optimize, spend
from costspark.runtime import materialise

COMPONENTS = {
    "spend_summary": spend.invoice_summary,
    "top_services": spend.top_services,
    "top_regions": spend.top_regions,
    "optimization_opportunities": optimize.idle_resources,
    "tagging_compliance": allocate.tagging_compliance,
    "discount_agreements": commit.current_agreements,
    "ai_insights": anomaly.growth_patterns,
}


def dashboard_columns() -> list[str]:
    """Columns that the components read."""
    names = [c for fn in (*COMPONENTS.values(), kpi.kpi_summary) for c in fn.columns]
    return list(dict.fromkeys(names))


def months_needed(options: dict[str, dict]) -> int:
    """The longest look-back, in months: 12, or what an option names in months or days."""
    named = [(k, v) for o in options.values() for k, v in o.items()]
    months = [v for k, v in named if k in ("months", "months_back")]
    days = [v // 28 + 1 for k, v in named if k in ("days", "lookback_days")]
    return max([12, *months, *days])


def run_dashboard(
    cur: DataFrame, as_of: date, path: str, **options: dict
) -> dict[str, DataFrame]:
    """Write every component below ``path`` and return them read back.

    The components look at 12 months at most (the KPI row at the whole table),
    or as far back as ``options`` ask, which map a component to its keyword
    arguments.  Those months are cut once to the columns in use and written; the
    components then prune columns and row groups of that table.
    """
    spark: SparkSession = cur.sparkSession
    recent = cur.filter(since_months(as_of, months_needed(options))).select(
        [c for c in dashboard_columns() if c in cur.columns]
    )
    slice_ = materialise(recent, f"{path}/_months")
    out = {}
    tables = {
        "kpi_summary": kpi.kpi_summary(cur, as_of, **options.get("kpi_summary", {})),
        **{n: fn(slice_, as_of, **options.get(n, {})) for n, fn in COMPONENTS.items()},
    }
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        out[name] = spark.read.parquet(f"{path}/{name}")
    return out


def dashboard_overview(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per component table."""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("component"), "rows")
             for n, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
