"""Spend trends, breakdowns and usage reports."""

from datetime import date

from pyspark.sql import functions as F

from checks.base import AS_OF, DAY, MONTH, cur, on_cur, register
from costspark.functions.filters import base_filter, date_filter, kpi_filter, positive_cost
from costspark.operators import focus, spend
from costspark.operators import usage_reports as usage
from costspark.plans.billing_view import focus_view

register(
    "invoice_summary",
    on_cur(spend.invoice_summary, AS_OF, months_back=24),
    f"""
    WITH m AS (SELECT month, sum(cost) AS s FROM cur
               WHERE cost > 0 AND ts >= {DAY} - INTERVAL 24 MONTH GROUP BY month),
         p AS (SELECT month, s, lag(s) OVER (ORDER BY month) AS p1,
                      lag(s, 12) OVER (ORDER BY month) AS p12 FROM m)
    SELECT month, round(s, 2) AS total_spend,
           CASE WHEN p1 > 0 THEN round((s - p1) / p1 * 100, 2) END AS mom_change,
           CASE WHEN p12 > 0 THEN round((s - p12) / p12 * 100, 2) END AS yoy_change
    FROM p
    """,
)

register(
    "invoice_summary_calendar",
    on_cur(spend.invoice_summary, AS_OF, months_back=24, calendar=True),
    f"""
    WITH m AS (SELECT month, sum(cost) AS s FROM cur
               WHERE cost > 0 AND ts >= {DAY} - INTERVAL 24 MONTH GROUP BY month)
    SELECT a.month, round(a.s, 2) AS total_spend,
           CASE WHEN b.s > 0 THEN round((a.s - b.s) / b.s * 100, 2) END AS mom_change,
           CASE WHEN c.s > 0 THEN round((a.s - c.s) / c.s * 100, 2) END AS yoy_change
    FROM m a LEFT JOIN m b ON b.month = a.month - INTERVAL 1 MONTH
             LEFT JOIN m c ON c.month = a.month - INTERVAL 12 MONTH
    """,
)

register(
    "next_month_forecast",
    lambda s, d: spend.next_month_forecast(
        spend.invoice_summary(cur(s, d, spend.invoice_summary), AS_OF)
    ),
    f"""
    WITH m AS (SELECT month, sum(cost) AS s FROM cur
               WHERE cost > 0 AND ts >= {DAY} - INTERVAL 12 MONTH GROUP BY month),
         r AS (SELECT s, row_number() OVER (ORDER BY month DESC) AS n FROM m),
         v AS (SELECT max(CASE WHEN n = 1 THEN s END) AS m0, max(CASE WHEN n = 2 THEN s END) AS m1 FROM r)
    SELECT CASE WHEN m1 IS NULL THEN 0.0 ELSE round(m0 * (1 + (m0 - m1) / m1), 2) END AS next_month,
           CASE WHEN m1 IS NULL THEN 0 ELSE 75 END AS confidence
    FROM v
    """,
)

register(
    "top_regions",
    on_cur(spend.top_regions, AS_OF),
    f"""
    WITH n AS (SELECT region, sum(cost) AS s FROM cur WHERE cost > 0 AND {MONTH} GROUP BY region),
         p AS (SELECT region, sum(cost) AS s FROM cur WHERE cost > 0
               AND ts >= DATE '2001-09-01' AND ts < DATE '2001-10-01' GROUP BY region)
    SELECT n.region AS region_name, round(n.s, 2) AS spend,
           round(n.s / (SELECT sum(s) FROM n) * 100, 2) AS percentage,
           CASE WHEN p.s > 0 THEN round((n.s - p.s) / p.s * 100, 2) END AS mom_change
    FROM n LEFT JOIN p ON n.region = p.region
    WHERE n.region IS NOT NULL ORDER BY n.s DESC LIMIT 10
    """,
)

TOP_SERVICES = f"""
    WITH g AS (SELECT service, sum(cost) AS s, count(DISTINCT resource) AS r FROM cur
               WHERE cost > 0 AND {MONTH} GROUP BY service)
    SELECT service AS service_name, round(s, 2) AS spend,
           round(s / (SELECT sum(s) FROM g) * 100, 2) AS percentage, r AS resource_count
    FROM g WHERE service IS NOT NULL ORDER BY s DESC LIMIT 10
"""
register("top_services", on_cur(spend.top_services, AS_OF), TOP_SERVICES)

register(
    "spend_breakdown",
    on_cur(spend.spend_breakdown, AS_OF),
    f"""
    SELECT region, service, round(sum(cost), 2) AS spend, count(DISTINCT resource) AS resource_count
    FROM cur WHERE cost > 0 AND {MONTH} GROUP BY region, service
    ORDER BY sum(cost) DESC, region, service LIMIT 50
    """,
)
register(
    "spend_breakdown_total",
    on_cur(spend.spend_breakdown, AS_OF, dimensions=()),
    f"""
    SELECT 'All' AS dimension, round(sum(cost), 2) AS spend, count(DISTINCT resource) AS resource_count
    FROM cur WHERE cost > 0 AND {MONTH}
    """,
)
register(
    "spend_breakdown_cube",
    on_cur(spend.spend_breakdown, AS_OF, cube=True),
    f"""
    SELECT region, service, round(sum(cost), 2) AS spend, count(DISTINCT resource) AS resource_count
    FROM cur WHERE cost > 0 AND {MONTH} GROUP BY CUBE (region, service)
    ORDER BY sum(cost) DESC, region NULLS FIRST, service NULLS FIRST LIMIT 50
    """,
)

register(
    "spend_extract",
    on_cur(spend.spend_extract, start=date(2000, 1, 1), end=date(2001, 10, 31)),
    """
    SELECT ts AS line_item_usage_start_date, service AS product_servicecode, region AS product_region,
           cost AS line_item_unblended_cost, resource AS line_item_resource_id
    FROM cur WHERE cost > 0 AND ts >= DATE '2000-01-01' AND ts <= DATE '2001-10-31'
    ORDER BY ts DESC, cost DESC, service, region NULLS FIRST, resource NULLS FIRST LIMIT 10000
    """,
)

register(
    "monthly_aggregation",
    lambda s, d: spend.monthly_aggregation(
        cur(s, d, spend.monthly_aggregation, "product_servicecode"), ["product_servicecode"]
    ),
    """
    SELECT month AS billing_month, service AS product_servicecode, round(sum(cost), 2) AS total_cost,
           count(DISTINCT resource) AS resource_count
    FROM cur WHERE cost > 0 GROUP BY month, service
    """,
)
register(
    "service_summary",
    on_cur(spend.service_summary),
    """
    SELECT service, round(sum(cost), 2) AS total_cost, count(DISTINCT resource) AS resource_count,
           count(*) AS line_item_count, round(avg(cost), 2) AS avg_cost_per_line_item
    FROM cur WHERE cost > 0 GROUP BY service ORDER BY sum(cost) DESC LIMIT 20
    """,
)
register(
    "account_summary",
    on_cur(spend.account_summary),
    """
    SELECT account AS account_id, payer AS payer_account_id, round(sum(cost), 2) AS total_cost,
           count(DISTINCT service) AS service_count, count(DISTINCT resource) AS resource_count
    FROM cur WHERE cost > 0 GROUP BY account, payer
    """,
)
TREND = """
    WITH m AS (SELECT month, service, sum(cost) AS s FROM cur
               WHERE cost > 0 AND ts >= DATE '2001-10-31' - INTERVAL 6 MONTH {only} GROUP BY month, service),
         p AS (SELECT *, lag(s) OVER (PARTITION BY service ORDER BY month) AS p FROM m)
    SELECT month, {service} round(s, 2) AS monthly_cost, round(p, 2) AS previous_month_cost,
           round((s - p) / nullif(p, 0) * 100, 2) AS month_over_month_change_pct
    FROM p
"""
register(
    "cost_trend",
    on_cur(spend.cost_trend, AS_OF),
    TREND.format(only="", service="service AS product_servicecode,"),
)
register(
    "cost_trend_one_service",
    on_cur(spend.cost_trend, AS_OF, service="AmazonRDS"),
    TREND.format(only="AND service = 'AmazonRDS'", service=""),
)
register(
    "overall_totals",
    on_cur(spend.overall_totals),
    """
    SELECT count(*) AS total_line_items, round(sum(cost), 2) AS total_cost,
           count(DISTINCT service) AS unique_services, count(DISTINCT ts) AS unique_days,
           count(DISTINCT account) AS unique_accounts, round(avg(cost), 2) AS avg_line_item_cost,
           min(ts) AS earliest_date, max(ts) AS latest_date
    FROM cur
    """,
)
register(
    "daily_costs",
    on_cur(spend.daily_costs),
    """
    SELECT ts AS date, round(sum(cost), 2) AS daily_cost, count(*) AS line_items,
           count(DISTINCT service) AS unique_services
    FROM cur GROUP BY ts ORDER BY ts LIMIT 30
    """,
)
register(
    "billing_period_summary",
    on_cur(spend.billing_period_summary),
    """
    SELECT CAST(month AS TIMESTAMP) AS billing_period, round(sum(cost), 2) AS monthly_cost,
           count(DISTINCT account) AS unique_accounts, count(*) AS total_line_items
    FROM cur GROUP BY month
    """,
)
register(
    "region_service_usage",
    on_cur(spend.region_service_usage),
    """
    SELECT region, service AS product_servicecode, round(sum(cost), 2) AS cost, count(*) AS usage_records
    FROM cur WHERE cost > 0 AND region IS NOT NULL AND region <> ''
    GROUP BY region, service ORDER BY sum(cost) DESC LIMIT 10
    """,
)
register(
    "billing_period_trend",
    on_cur(spend.billing_period_trend, limit=None),
    """
    SELECT CAST(month AS TIMESTAMP) AS billing_period, service AS product_servicecode,
           round(sum(cost), 2) AS current_cost,
           round(lag(sum(cost)) OVER w, 2) AS previous_cost,
           round((sum(cost) - lag(sum(cost)) OVER w) / nullif(lag(sum(cost)) OVER w, 0) * 100, 2)
               AS cost_change_percent
    FROM cur WHERE cost > 0 GROUP BY month, service
    WINDOW w AS (PARTITION BY service ORDER BY month)
    """,
)
register(
    "account_distribution",
    on_cur(spend.account_distribution),
    """
    WITH a AS (SELECT account, sum(CAST(cost AS DECIMAL(28,10))) AS s FROM cur WHERE cost > 0 GROUP BY account)
    SELECT account AS line_item_usage_account_id, round(CAST(s AS DOUBLE), 2) AS total_cost,
           round(CAST(s AS DOUBLE) / CAST((SELECT sum(s) FROM a) AS DOUBLE) * 100, 2) AS cost_percentage,
           rank() OVER (ORDER BY s DESC) AS cost_rank
    FROM a
    """,
)
register(
    "invoice_usage",
    on_cur(spend.invoice_usage),
    """
    SELECT invoice AS bill_invoice_id, sum(CAST(usage AS DECIMAL(18,2))) AS total_usage_amount
    FROM cur GROUP BY invoice
    """,
)
register(
    "monthly_gross_net",
    on_cur(spend.monthly_gross_net, since=date(2000, 1, 1)),
    """
    SELECT month, round(sum(cost), 4) AS monthly_cost, round(sum(net_cost), 4) AS net_cost,
           count(DISTINCT service) AS services_used
    FROM cur WHERE ts >= DATE '2000-01-01' GROUP BY month
    """,
    digits=4,
)
register(
    "monthly_cost_text",
    on_cur(spend.monthly_cost_text, AS_OF),
    f"""
    SELECT strftime(month, '%Y-%m') AS month, round(sum(cost), 2) AS cost
    FROM cur WHERE ts >= {DAY} - INTERVAL 12 MONTH GROUP BY 1
    """,
)
register(
    "service_growth",
    on_cur(spend.service_growth, AS_OF),
    f"""
    WITH m AS (SELECT service, month, sum(cost) AS s FROM cur
               WHERE ts >= {DAY} - INTERVAL 6 MONTH GROUP BY service, month),
         p AS (SELECT *, lag(s) OVER (PARTITION BY service ORDER BY month) AS p FROM m)
    SELECT service AS product_servicecode, round(s, 2) AS current_cost, round(p, 2) AS prev_month_cost,
           CASE WHEN p > 0 THEN round((s - p) / p * 100, 2) END AS growth_percentage
    FROM p WHERE month = DATE '2001-09-01' AND s > 100
    """,
)
register(
    "service_efficiency",
    on_cur(usage.service_efficiency, "AmazonEC2", AS_OF),
    f"""
    WITH d AS (SELECT CAST(ts AS DATE) AS usage_date, sum(cost) AS c, sum(usage) AS u,
                      count(DISTINCT resource) AS r
               FROM cur WHERE service = 'AmazonEC2' AND ts >= {DAY} - INTERVAL 30 DAY GROUP BY 1),
         e AS (SELECT *, CASE WHEN u > 0 THEN c / u ELSE 0 END AS pu,
                      CASE WHEN r > 0 THEN c / r ELSE 0 END AS pr FROM d)
    SELECT usage_date, round(c, 4) AS daily_cost, round(u, 4) AS daily_usage, r AS active_resources,
           round(pu, 4) AS cost_per_unit, round(round(pr, 6), 2) AS cost_per_resource,
           round(avg(pu) OVER (ORDER BY usage_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4)
               AS avg_cost_per_unit_7day
    FROM e
    """,
    digits=4,
)
register(
    "monthly_band_forecast",
    on_cur(usage.monthly_band_forecast, AS_OF),
    f"""
    WITH d AS (SELECT CAST(ts AS DATE) AS day, sum(cost) AS c FROM cur
               WHERE ts >= {DAY} - INTERVAL 30 DAY GROUP BY 1)
    SELECT round(avg(c) * 30, 2) AS forecasted_monthly_cost,
           round((avg(c) + stddev_samp(c) * 1.96) * 30, 2) AS upper_bound_95pct,
           round((avg(c) - stddev_samp(c) * 1.96) * 30, 2) AS lower_bound_95pct,
           count(*) AS days_analyzed
    FROM d
    """,
)
register(
    "ec2_daily_usage",
    on_cur(usage.ec2_daily_usage),
    """
    SELECT payer AS bill_payer_account_id, account AS line_item_usage_account_id,
           kind AS line_item_line_item_type, CAST(ts AS DATE) AS day_line_item_usage_start_date, region,
           CASE WHEN usage_type LIKE '%BoxUsage%' THEN 'EC2 Instance Usage'
                WHEN usage_type LIKE '%EBS%' THEN 'EBS Storage'
                WHEN usage_type LIKE '%DataTransfer%' THEN 'Data Transfer'
                WHEN usage_type LIKE '%NatGateway%' THEN 'NAT Gateway' ELSE 'Other' END AS usage_category,
           resource AS line_item_resource_id, itype AS product_instance_type,
           round(sum(usage), 2) AS sum_line_item_usage_amount,
           round(sum(cost), 2) AS sum_line_item_unblended_cost
    FROM cur
    WHERE service = 'AmazonEC2' AND kind IN ('DiscountedUsage', 'Usage', 'SavingsPlanCoveredUsage') AND cost > 0
    GROUP BY ALL
    ORDER BY sum(cost) DESC, day_line_item_usage_start_date, account, resource NULLS FIRST LIMIT 20
    """.replace("GROUP BY ALL", "GROUP BY 1, 2, 3, 4, 5, 6, 7, 8"),
)
register(
    "athena_daily_usage",
    on_cur(usage.athena_daily_usage),
    """
    SELECT payer AS bill_payer_account_id, account AS line_item_usage_account_id,
           CAST(ts AS DATE) AS day_line_item_usage_start_date, usage_type AS line_item_usage_type,
           resource AS line_item_resource_id, region, service AS line_item_product_code,
           round(sum(usage), 2) AS sum_line_item_usage_amount,
           round(sum(cost), 2) AS sum_line_item_unblended_cost
    FROM cur
    WHERE service = 'AmazonAthena' AND kind IN ('DiscountedUsage', 'Usage', 'SavingsPlanCoveredUsage')
    GROUP BY 1, 2, 3, 4, 5, 6, 7
    ORDER BY sum(cost) DESC, 3, account, resource NULLS FIRST LIMIT 20
    """,
)
register(
    "service_monthly_by_region",
    on_cur(usage.service_monthly_by_region, AS_OF),
    f"""
    SELECT month, region AS product_region, round(sum(cost), 2) AS monthly_cost FROM cur
    WHERE service = 'AmazonEC2' AND ts >= {DAY} - INTERVAL 6 MONTH GROUP BY month, region
    """,
)
register(
    "service_by_account",
    on_cur(usage.service_by_account),
    """
    SELECT account AS line_item_usage_account_id, round(sum(cost), 2) AS total_cost FROM cur
    WHERE service = 'AmazonS3' AND cost > 0 GROUP BY account ORDER BY sum(cost) DESC, account LIMIT 10
    """,
)
register(
    "service_by_day",
    on_cur(usage.service_by_day, AS_OF),
    f"""
    SELECT CAST(ts AS DATE) AS date, round(sum(cost), 2) AS daily_cost FROM cur
    WHERE service = 'AWSLambda' AND ts >= {DAY} - INTERVAL 30 DAY GROUP BY 1
    """,
)
register(
    "service_by_region",
    on_cur(usage.service_by_region),
    """
    SELECT region AS product_region, round(sum(cost), 2) AS total_cost FROM cur
    WHERE service = 'AmazonEC2' GROUP BY region
    """,
)
register(
    "recent_services_7_days",
    on_cur(usage.recent_services, AS_OF),
    f"""
    SELECT service AS product_servicecode, count(*) AS records, round(sum(cost), 2) AS total_cost
    FROM cur WHERE ts >= {DAY} - INTERVAL 7 DAY GROUP BY service ORDER BY sum(cost) DESC LIMIT 10
    """,
)
register(
    "recent_service_detail_30_days",
    on_cur(usage.recent_service_detail, AS_OF),
    f"""
    SELECT service AS product_servicecode, round(sum(cost), 2) AS total_cost,
           round(avg(cost), 2) AS avg_cost_per_line, count(*) AS line_item_count,
           count(DISTINCT resource) AS unique_resources
    FROM cur WHERE ts >= {DAY} - INTERVAL 30 DAY AND cost > 0
    GROUP BY service ORDER BY sum(cost) DESC LIMIT 20
    """,
)
register(
    "service_search",
    on_cur(usage.service_search, "amazon"),
    """
    SELECT service, usage_type, round(sum(cost), 2) AS total_cost, count(*) AS line_items,
           min(ts) AS first_usage, max(ts) AS last_usage
    FROM cur WHERE lower(service) LIKE '%amazon%' GROUP BY service, usage_type
    ORDER BY sum(cost) DESC LIMIT 20
    """,
)
register(
    "top_service_months",
    on_cur(usage.top_service_months, AS_OF, months=12, n=3),
    f"""
    SELECT month, service AS product_servicecode, round(sum(cost), 2) AS monthly_cost FROM cur
    WHERE ts >= {DAY} - INTERVAL 12 MONTH AND service IN
          (SELECT service FROM cur GROUP BY service ORDER BY sum(cost) DESC LIMIT 3)
    GROUP BY month, service
    """,
)
register(
    "top_service_weeks",
    on_cur(usage.top_service_weeks, date(2000, 1, 1), date(2000, 12, 31), n=3),
    """
    WITH y AS (SELECT * FROM cur WHERE ts BETWEEN DATE '2000-01-01' AND DATE '2000-12-31')
    SELECT service AS product_servicecode, CAST(date_trunc('week', ts) AS DATE) AS week,
           round(sum(cost), 2) AS weekly_cost, count(DISTINCT resource) AS unique_resources
    FROM y WHERE service IN (SELECT service FROM y GROUP BY service ORDER BY sum(cost) DESC LIMIT 3)
    GROUP BY 1, 2
    """,
)
register(
    "account_analysis",
    on_cur(usage.account_analysis, AS_OF),
    f"""
    SELECT account AS account_id, round(sum(cost), 6) AS total_cost,
           count(DISTINCT service) AS services_count, count(DISTINCT resource) AS resources_count,
           round(avg(cost), 6) AS avg_line_cost
    FROM cur WHERE ts >= {DAY} - INTERVAL 30 DAY GROUP BY account
    """,
    digits=6,
)

# FOCUS reports.
FOCUS = """
    SELECT location AS account_name, r_name AS region_name, service, resource, itype, sp_arn, l_linenumber,
           CASE service WHEN 'AmazonS3' THEN 'Storage' WHEN 'AmazonRDS' THEN 'Databases'
                WHEN 'AmazonAthena' THEN 'Databases' ELSE 'Compute' END AS category,
           CASE WHEN p_size <= 12 THEN 'Hrs' ELSE 'GB' END AS unit, usage, month,
           CAST(cost AS DECIMAL(18,2)) AS list_cost,
           CAST(cost AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS effective_cost
    FROM cur
"""


def _focus(fn, *args, **kwargs):
    return lambda s, d: fn(focus_view(s, d), *args, **kwargs)


def _d(expression: str, name: str) -> str:
    return f"round(CAST({expression} AS DOUBLE), 4) AS {name}"


register(
    "focus_cost_by_service",
    _focus(focus.cost_by_service, AS_OF, months=12),
    f"""
    SELECT category AS ServiceCategory, service AS ServiceName, {_d("sum(effective_cost)", "TotalCost")},
           count(*) AS RecordCount
    FROM foc WHERE month >= {DAY} - INTERVAL 12 MONTH GROUP BY 1, 2 ORDER BY sum(effective_cost) DESC LIMIT 20
    """,
    digits=4,
    foc=FOCUS,
)
register(
    "focus_account_region_savings",
    _focus(focus.account_region_savings, AS_OF),
    f"""
    SELECT account_name AS BillingAccountName, region_name AS RegionName,
           {_d("sum(effective_cost)", "TotalCost")}, {_d("sum(list_cost)", "TotalListCost")},
           {_d("sum(list_cost - effective_cost)", "TotalSavings")}
    FROM foc WHERE month >= {DAY} - INTERVAL 3 MONTH GROUP BY 1, 2
    """,
    digits=4,
    foc=FOCUS,
)
register(
    "focus_commitment_discounts",
    _focus(focus.commitment_discounts, AS_OF),
    f"""
    SELECT 'Savings Plan' AS CommitmentDiscountType,
           CASE l_linenumber WHEN 1 THEN 'Spend' ELSE 'Usage' END AS CommitmentDiscountCategory,
           count(DISTINCT sp_arn) AS DiscountCount, {_d("sum(effective_cost)", "TotalEffectiveCost")},
           {_d("sum(list_cost)", "TotalListCost")},
           {_d("sum(list_cost - effective_cost)", "CommitmentSavings")}
    FROM foc WHERE sp_arn IS NOT NULL AND month >= {DAY} - INTERVAL 1 MONTH GROUP BY 1, 2
    """,
    digits=4,
    foc=FOCUS,
)
register(
    "focus_resource_use_by_type",
    _focus(focus.resource_use_by_type, AS_OF),
    f"""
    SELECT itype AS ResourceType, unit AS ConsumedUnit, count(DISTINCT resource) AS UniqueResources,
           {_d("sum(usage)", "TotalQuantity")}, {_d("sum(effective_cost)", "TotalCost")},
           {_d("avg(effective_cost)", "AvgCostPerResource")}
    FROM foc WHERE resource IS NOT NULL AND month >= {DAY} - INTERVAL 1 MONTH
    GROUP BY 1, 2 ORDER BY sum(effective_cost) DESC LIMIT 15
    """,
    digits=4,
    foc=FOCUS,
)

# Filters and query building.
register(
    "base_filter",
    lambda s, d: cur(
        s, d, spend.account_summary
    ).filter(
        base_filter("2001-10", service_codes=["AmazonEC2", "AmazonRDS"], min_cost=1000.0)
    ).groupBy("product_servicecode").agg(F.count("*").alias("lines")),
    f"""
    SELECT service AS product_servicecode, count(*) AS lines FROM cur
    WHERE cost > 1000 AND {MONTH} AND service IN ('AmazonEC2', 'AmazonRDS') GROUP BY service
    """,
)
register(
    "date_filter",
    lambda s, d: cur(s, d, spend.invoice_summary).agg(
        F.count_if(date_filter(last_n_months=3, as_of=AS_OF)).alias("last_3_months"),
        F.count_if(date_filter(date(2000, 2, 29), date(2000, 6, 30))).alias("between_dates"),
        F.count_if(date_filter()).alias("all_rows"),
    ),
    f"""
    SELECT count(*) FILTER (WHERE ts >= {DAY} - INTERVAL 3 MONTH) AS last_3_months,
           count(*) FILTER (WHERE ts BETWEEN DATE '2000-02-29' AND DATE '2000-06-30') AS between_dates,
           count(*) AS all_rows
    FROM cur
    """,
)
register(
    "fluent_query",
    lambda s, d: (
        cur(s, d, "product_servicecode", "product_region", "line_item_unblended_cost")
        .where("line_item_unblended_cost > 500 AND product_region IS NOT NULL")
        .groupBy("product_servicecode", "product_region")
        .agg(F.sum("line_item_unblended_cost").alias("cost"), F.count("*").alias("lines"))
        .where("lines > 5")
        .orderBy(F.desc("cost"))
        .limit(15)
    ),
    """
    SELECT service AS product_servicecode, region AS product_region, round(sum(cost), 2) AS cost,
           count(*) AS lines
    FROM cur WHERE cost > 500 AND region IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 5
    ORDER BY sum(cost) DESC LIMIT 15
    """,
)
register(
    "kpi_filter",
    lambda s, d: (
        cur(s, d, "line_item_unblended_cost", "bill_billing_period_start_date", "resource_tags",
            "bill_payer_account_id")
        .filter(positive_cost() & kpi_filter("2001-10", tags={"Environment": "prod"}))
        .groupBy("bill_payer_account_id")
        .agg(F.sum("line_item_unblended_cost").alias("cost"))
    ),
    f"""
    SELECT payer AS bill_payer_account_id, round(sum(cost), 2) AS cost FROM cur
    WHERE cost > 0 AND {MONTH} AND env = 'prod' GROUP BY payer
    """,
)
