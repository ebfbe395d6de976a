"""The plans behind the operators: what is pushed, pruned and left out."""

from __future__ import annotations

import inspect
from datetime import date

from checks.base import QUERIES
from costspark.operators import allocate, forecast, spend
from costspark.plans.billing_view import COLUMNS, billing_view

SF = "/root/testdata/sf0.001"
AS_OF = date(2001, 10, 31)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df) -> str:
    utils = df.sparkSession._jvm.org.apache.spark.sql.api.python.PythonSQLUtils
    return utils.explainString(df._jdf.queryExecution(), "formatted")


def test_month_filter_reaches_the_scan(spark):
    text = formatted(spend.top_services(billing_view(spark, SF, *spend.top_services.columns), AS_OF))
    pushed = text[text.index("PushedFilters"):]
    assert "GreaterThanOrEqual(l_shipdate,2001-10-01T00:00)" in pushed
    assert "LessThan(l_shipdate,2001-11-01T00:00)" in pushed
    assert "l_tax" not in text and "orders.parquet" not in text


def test_only_needed_tables_are_joined(spark):
    text = plan(billing_view(spark, SF, "product_servicecode"))
    assert "part.parquet" in text and "customer.parquet" not in text
    assert "Join" not in plan(billing_view(spark, SF, "line_item_unblended_cost"))


def test_operators_declare_known_columns():
    for module in (spend, allocate):
        for name, fn in vars(module).items():
            if inspect.isfunction(fn):
                for column in getattr(fn, "columns", ()):
                    assert column in COLUMNS, (name, column)


def test_no_query_builds_a_cartesian_product(spark):
    for name in ("account_distribution", "cost_health_check", "commitment_scenarios", "forecast_scenarios",
                 "pricing_matrix", "tagging_compliance", "top_services"):
        text = plan(QUERIES[name](spark, SF))
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name


def test_tagging_compliance_reads_the_facts_once(spark):
    df = allocate.tagging_compliance(billing_view(spark, SF, *allocate.tagging_compliance.columns), AS_OF)
    df.collect()
    assert "ReusedExchange" in plan(df)


def test_hot_keys_spread_by_id(spark):
    """Distinct counts shuffle by the counted id before they group by the key."""
    for df in (
        spend.top_services(billing_view(spark, SF, *spend.top_services.columns), AS_OF),
        allocate.tagging_compliance(billing_view(spark, SF, *allocate.tagging_compliance.columns), AS_OF),
    ):
        first = [x for x in formatted(df).splitlines() if "Arguments: hashpartitioning" in x][0]
        assert "line_item_resource_id" in first


def test_top_services_of_a_range_scan_the_facts_once(spark):
    text = plan(QUERIES["top_service_weeks"](spark, SF))
    assert text.count("lineitem.parquet") == 1


def test_distinct_counts_do_not_copy_facts(bill):
    """One shuffle of the facts, and what Spark copies per distinct count is grouped already."""
    df = bill(dict(start="2024-03-05", service="s", resource="a", account="x", payer="p", cost=1.0))
    for frame in (spend.overall_totals(df), forecast.month_overview(df, AS_OF), spend.account_summary(df, ordered=False)):
        plan = frame._jdf.queryExecution().sparkPlan().toString()
        assert plan.index("Expand") < plan.rindex("HashAggregate")  # below the copies: the first grouping
    plan = spend.account_summary(df, ordered=False)._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "rangepartitioning" not in plan


def test_bucketed_facts_are_enriched_without_a_shuffle(spark, tmp_path):
    from costspark.operators.enrich import ENRICHMENTS, enrich
    from costspark.sources import sinks

    pairs = {e.table_id: e.keys for e in ENRICHMENTS["CUR"]}["invoice_summaries"]
    facts = spark.range(200).selectExpr(*[f"cast(id % {7 + i} AS string) AS {a}" for i, (a, _) in enumerate(pairs)], "id AS v")
    dims = facts.drop("v").distinct().selectExpr(*[f"{a} AS {b}" for a, b in pairs], "1 AS w")
    opened = []
    for i, (df, keys) in enumerate(((facts, [a for a, _ in pairs]), (dims, [b for _, b in pairs]))):
        sinks.save_bucketed(df, f"bucketed_{i}", str(tmp_path / str(i)), keys, 4)
        opened.append(sinks.open_bucketed(spark, f"opened_{i}", str(tmp_path / str(i)), df.schema, keys, 4))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = enrich(opened[0], {"invoice_summaries": opened[1]}, "invoice_summaries")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert joined.filter("invoice_summaries_w = 1").count() == 200
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
        for name in ("bucketed_0", "bucketed_1", "opened_0", "opened_1"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
