"""Reports from stored roll-ups: the same rows as from the facts."""

from pyspark.sql import functions as F

from checks import saving_checks, spend_checks, trend_checks  # noqa: F401  (their SQL is what the roll-ups are held against)
from checks.base import AS_OF, ORACLE, QUERIES, cur, register, tidy
from costspark.operators import anomaly, commit, forecast, spend
from costspark.plans import rollup
from costspark.runtime import scratch_path

FACTS = (
    "line_item_usage_start_date", "line_item_unblended_cost", "line_item_usage_amount", "product_servicecode",
    "product_region", "product_instance_type", "line_item_usage_account_id", "line_item_resource_id",
)


def _rolled(s, d):
    """Half of the lines stored first, then all of them: months are replaced, not added to."""
    path = scratch_path(s, "rollup")
    facts = cur(s, d, *FACTS[:6])
    rollup.store(rollup.daily_rollup(facts.filter("line_item_usage_amount > 20")), path)
    return rollup.store(rollup.daily_rollup(facts), path)


# Report over a table of lines, and the places that its query rounds to.
REPORTS = {
    "invoice_summary": (lambda r: spend.invoice_summary(r, AS_OF, months_back=24), 2),
    "cost_trend": (lambda r: spend.cost_trend(r, AS_OF), 2),
    "usage_stability": (lambda r: commit.usage_stability(r, AS_OF), 5),
    "growth_patterns": (lambda r: anomaly.growth_patterns(r, AS_OF), 5),
    "forecast_inputs": (lambda r: forecast.forecast_inputs(r, AS_OF, months=15), 2),
}
for _name, (_report, _digits) in REPORTS.items():
    QUERIES[f"rolled_{_name}"] = lambda s, d, report=_report, digits=_digits: tidy(report(_rolled(s, d)), digits)
    ORACLE[f"rolled_{_name}"] = ORACLE[_name]


def _sketched(s, d):
    """Accounts' and services' distinct resources of the last two years from sketches, beside the exact counts."""
    facts = cur(s, d, *FACTS)
    kept = rollup.store(rollup.monthly_sketches(facts), scratch_path(s, "sketches"))
    found = rollup.approximate_distinct(kept, "product_servicecode", start="2000-01")
    exact = facts.filter("line_item_usage_start_date >= '2000-01-01'").groupBy(F.col("product_servicecode").alias("of"))
    exact = exact.agg(F.countDistinct("line_item_resource_id").alias("resources"))
    met = found.join(exact, F.col("product_servicecode").eqNullSafe(F.col("of")))
    near = F.abs(F.col("approx_distinct") - F.col("resources")) <= 0.05 * F.col("resources") + 1
    return met.select(F.col("product_servicecode").alias("service"), "resources", "counted_lines", near.alias("within_bound"))


register(
    "approximate_distinct_resources",
    _sketched,
    """
    SELECT service, count(DISTINCT resource) AS resources, count(resource) AS counted_lines, true AS within_bound
    FROM cur WHERE ts >= DATE '2000-01-01' GROUP BY service
    """,
)
