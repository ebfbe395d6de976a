from __future__ import annotations

from datetime import date

import pytest

from costspark.operators import spend
from costspark.plans import rollup
from tests.conftest import AS_OF, rows


def test_rollup_keeps_what_the_reports_filter_by(spark, tmp_path, bill):
    lines = [
        dict(start="2024-02-28", cost=5.0, usage=1.0, service="s", region="r"),
        dict(start="2024-03-01", cost=3.0, usage=1.0, service="s", region="r"),
        dict(start="2024-03-01", cost=-1.0, usage=1.0, service="s", region="r"),  # a credit is no charge
        dict(start="2024-03-31", cost=2.0, usage=None, service=None, region=None),
        dict(start="2024-03-31", cost=None, usage=4.0, service="s", region="r"),
    ]
    path = str(tmp_path / "rollup")
    kept = rollup.store(rollup.daily_rollup(bill(*lines)), path)
    for report in (lambda t: spend.invoice_summary(t, AS_OF), lambda t: spend.cost_trend(t, date(2024, 8, 29), months_back=6)):
        assert rows(report(kept)) == rows(report(bill(*lines)))
    changed = [dict(start="2024-03-02", cost=7.0, usage=1.0, service="s", region="r")]
    kept = rollup.store(rollup.daily_rollup(bill(*changed)), path)  # March again, February stays
    assert rows(spend.invoice_summary(kept, AS_OF), "total_spend") == [(7.0,), (5.0,)]


def test_sketches_answer_any_range_without_facts(spark, tmp_path, bill):
    base = spark.range(30_000).selectExpr(
        "make_timestamp_ntz(2024, 1 + cast(id % 3 AS int), 1, 0, 0, 0) AS line_item_usage_start_date", "'a' AS line_item_usage_account_id",
        "if(id % 2 = 0, 'x', null) AS product_servicecode", "if(id % 5 = 0, null, concat('r', id)) AS line_item_resource_id",
    )
    sketches = rollup.monthly_sketches(base)
    path = str(tmp_path / "sketches")
    kept = rollup.store(sketches, path)
    ((every,),) = rows(rollup.approximate_distinct(kept), "approx_distinct")
    assert every == pytest.approx(24_000, rel=0.05)
    march = rollup.approximate_distinct(kept, "product_servicecode", start="2024-03", end="2024-03")
    got = {k: n for k, n in rows(march, "product_servicecode", "approx_distinct")}
    assert got["x"] == pytest.approx(4_000, rel=0.05) and got[None] == pytest.approx(4_000, rel=0.05)
    assert rows(rollup.approximate_distinct(kept, start="2025-01"), "approx_distinct") in ([(0,)], [(None,)])
    plan = march._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "line_item" not in plan
    assert "rollup_month" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
