from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from costspark.functions.dates import shift_months
from costspark.functions.filters import base_filter, date_filter, kpi_filter
from costspark.operators import spend
from costspark.operators import usage_reports as usage
from tests.conftest import AS_OF, rows


def line(month, cost, service="AmazonEC2", **more):
    return dict(start=f"{month}-05", cost=cost, service=service, **more)


def test_shift_months_clamps():
    assert shift_months(date(2024, 3, 31), -1) == date(2024, 2, 29)
    assert shift_months(date(2024, 1, 31), 13) == date(2025, 2, 28)
    assert shift_months(date(2024, 12, 1), 1) == date(2025, 1, 1)


def test_invoice_summary_changes_and_zero_prior(bill):
    df = bill(line("2024-01", 100.0), line("2024-02", 150.0), line("2024-03", 75.0), line("2024-03", -5.0))
    got = rows(spend.invoice_summary(df, AS_OF), "total_spend", "mom_change", "yoy_change")
    assert got == [(75.0, -50.0, None), (150.0, 50.0, None), (100.0, None, None)]


def test_row_lag_shifts_over_gaps_calendar_does_not(bill):
    months = ["2023-02"] + [f"2023-{m:02d}" for m in range(4, 13)] + ["2024-01", "2024-02", "2024-03"]
    df = bill(*[line(m, 10.0 * (i + 1)) for i, m in enumerate(months)])
    by_row = spend.invoice_summary(df, AS_OF, 24).first()
    assert by_row["yoy_change"] == round((130 - 10) / 10 * 100, 2)
    by_month = spend.invoice_summary(df, AS_OF, 24, calendar=True)
    assert by_month.first()["yoy_change"] is None
    feb = by_month.filter(F.col("month") == date(2024, 2, 1)).first()
    assert feb["yoy_change"] == round((120 - 10) / 10 * 100, 2)


def test_next_month_forecast_needs_two_months(bill):
    one = spend.invoice_summary(bill(line("2024-03", 10.0)), AS_OF)
    assert rows(spend.next_month_forecast(one)) == [(0.0, 0)]
    two = spend.invoice_summary(bill(line("2024-03", 10.0), line("2024-02", 8.0)), AS_OF)
    assert rows(spend.next_month_forecast(two)) == [(12.5, 75)]
    none = spend.invoice_summary(bill(), AS_OF)
    assert rows(spend.next_month_forecast(none)) == [(0.0, 0)]


def test_top_regions_share_counts_unnamed_region(bill):
    df = bill(
        line("2024-03", 60.0, region="us"), line("2024-03", 40.0), line("2024-02", 30.0, region="us"),
        line("2024-02", 5.0, region="eu"),
    )
    assert rows(spend.top_regions(df, AS_OF)) == [("us", 60.0, 60.0, 100.0)]


def test_top_services_limit_and_ties(bill):
    df = bill(*[line("2024-03", 10.0, s, resource=r) for s in "cba" for r in ("x", "x", "y")])
    got = rows(spend.top_services(df, AS_OF, limit=2))
    assert got == [("a", 30.0, 33.33, 2), ("b", 30.0, 33.33, 2)]


def test_breakdown_without_dimension_is_total(bill):
    df = bill(line("2024-03", 1.0, resource="a"), line("2024-03", 2.0, "AmazonS3", resource="a"))
    assert rows(spend.spend_breakdown(df, AS_OF, ())) == [("All", 3.0, 1)]
    assert len(rows(spend.spend_breakdown(df, AS_OF, ("service",)))) == 2


def test_account_summary_counts_each_once(bill):
    df = bill(
        *[line("2024-03", 1.0, s, account="a", payer="p", resource=r) for s, r in
          [("x", "1"), ("x", "1"), ("y", "1"), ("y", None), (None, "2")]]
    )
    assert rows(spend.account_summary(df)) == [("a", "p", 5.0, 2, 2)]


def test_cost_trend_zero_prior_gives_null(bill, spark):
    monthly = bill(line("2024-01", 0.5), line("2024-02", 1.0), line("2024-03", 3.0))
    got = rows(spend.cost_trend(monthly, AS_OF, "AmazonEC2"), "monthly_cost", "month_over_month_change_pct")
    assert got == [(3.0, 200.0), (1.0, 100.0), (0.5, None)]


def test_rank_shares_place_on_ties(bill):
    costs = {"a": 5.0, "b": 9.0, "c": 5.0, "d": 1.0, "e": 9.0, "f": 0.001}
    df = bill(*[line("2024-03", v, account=k) for k, v in costs.items()])
    got = {r[0]: r[3] for r in rows(spend.account_distribution(df))}
    assert got == {"b": 1, "e": 1, "a": 3, "c": 3, "d": 5, "f": 6}


def test_rank_matches_window_on_many_values(spark):
    df = spark.range(2000).selectExpr("id", "CAST(pmod(hash(id), 700) + 1 AS decimal(28,10)) AS v")
    ranked = spend.rank_by_value(df, "v", "got").selectExpr(
        "got", "rank() OVER (ORDER BY v DESC) AS want"
    )
    assert ranked.count() == 2000
    assert ranked.filter("got <> want").count() == 0


def test_invoice_usage_is_decimal(spark):
    df = spark.createDataFrame([("i", 0.1)] * 3 + [("i", None)], "bill_invoice_id string, line_item_usage_amount double")
    assert str(rows(spend.invoice_usage(df))[0][1]) == "0.30"


def test_service_growth_needs_minimum_and_sorts_nulls_last(bill):
    df = bill(
        line("2024-01", 200.0, "a"), line("2024-02", 300.0, "a"), line("2024-02", 500.0, "b"),
        line("2024-01", 10.0, "c"), line("2024-02", 99.0, "c"),
    )
    got = rows(spend.service_growth(df, AS_OF), "product_servicecode", "growth_percentage")
    assert got == [("a", 50.0), ("b", None)]


def test_service_efficiency_moving_average_has_seven_rows(bill):
    df = bill(*[dict(start=f"2024-03-{d:02d}", cost=float(d), usage=1.0, service="s", resource="r") for d in range(5, 15)])
    last = usage.service_efficiency(df, "s", AS_OF).collect()[-1]
    assert last["avg_cost_per_unit_7day"] == 11.0
    zero = bill(dict(start="2024-03-05", cost=1.0, usage=0.0, service="s"))
    assert rows(usage.service_efficiency(zero, "s", AS_OF), "cost_per_unit", "cost_per_resource") == [(0.0, 0.0)]


def test_usage_category_order(bill):
    kinds = ["X-BoxUsage:EBS", "EBS:Volume", "DataTransfer-Out", "NatGateway-Hours", "Other"]
    df = bill(
        *[dict(start="2024-03-05", cost=1.0, usage=1.0, usage_type=k, product_code="AmazonEC2", kind="Usage", resource=k)
          for k in kinds],
        dict(start="2024-03-05", cost=1.0, usage_type="BoxUsage", product_code="AmazonEC2", kind="Tax"),
    ).withColumn("product_region_code", F.col("product_region"))
    got = {r["line_item_resource_id"]: r["usage_category"] for r in usage.ec2_daily_usage(df).collect()}
    assert list(got.values()).count("Other") == 1 and len(got) == 5
    assert got["X-BoxUsage:EBS"] == "EC2 Instance Usage"


def test_filters(bill):
    df = bill(
        line("2024-03", 5.0, payer="p", account="a", tags={"user:Team": "data"}, period="2024-03-01"),
        line("2024-02", 5.0, payer="p", account="b", tags={"Team": "data"}, period="2024-02-01"),
        line("2024-03", 0.5, payer="q", account="a", period="2024-03-01"),
    )
    count = lambda c: df.filter(c).count()
    assert count(base_filter()) == 3
    assert count(base_filter("2024-03", "p", "a", ["AmazonEC2"], 1.0)) == 1
    assert count(date_filter()) == 3
    assert count(date_filter(end=date(2024, 3, 5))) == 3
    assert count(date_filter(date(2024, 3, 6), last_n_months=1, as_of=AS_OF)) == 2
    assert count(kpi_filter(tags={"Team": "data"})) == 2
    assert count(kpi_filter("2024-03", tags={"Team": "data"})) == 1
    with pytest.raises(ValueError):
        date_filter(last_n_months=2)


def test_extract_reads_only_the_newest_days(bill):
    df = bill(*[dict(start=f"2024-03-{d:02d}", cost=float(c), service="s") for d in range(1, 6) for c in (1, 2, 3)])
    got = rows(spend.spend_extract(df, limit=5), "line_item_usage_start_date", "line_item_unblended_cost")
    assert [(t.day, c) for t, c in got] == [(5, 3.0), (5, 2.0), (5, 1.0), (4, 3.0), (4, 2.0)]
    assert spend.spend_extract(df, limit=100).count() == 15
    assert spend.spend_extract(bill(), limit=3).count() == 0
    assert spend.spend_extract(df, start=date(2024, 3, 2), end=date(2024, 3, 3), limit=100).count() == 6


def test_distribution_keeps_tiny_costs(bill):
    df = bill(*[dict(start="2024-03-01", account=a, cost=c) for a, c in (("a", 5.0), ("b", 2e-11), ("c", 3e-12), ("d", 2e-11))])
    got = {r[0]: r[3] for r in rows(spend.account_distribution(df))}
    assert got == {"a": 1, "b": 2, "c": 4, "d": 2}


def test_rank_splits_a_hot_band(spark):
    """Flat fees with small differences, zeros and a NULL: the plain rank."""
    values = [f"{100 + i / 1000:.10f}" for i in range(600)] + ["0", "0", "7.5", "100.0010000000"]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "t string").selectExpr("CAST(t AS decimal(38,20)) AS v")
    got = {(float(r["v"]) if r["v"] is not None else None): r["r"] for r in spend.rank_by_value(df, "v", "r").collect()}
    numbers = [float(v) for v in values]
    assert got == {v: 1 + sum(o > v for o in numbers) for v in numbers} | {None: None}
