"""Anomalies, growth patterns, forecasts and KPIs."""

from checks.base import AS_OF, DAY, MONTH, cur, on_cur, register
from checks.saving_checks import IDLE, TAGS
from costspark.operators import allocate, anomaly, forecast, kpi, optimize, spend
from costspark.operators.kpi import KpiRule

DAILY = f"""
    WITH d AS (SELECT CAST(ts AS DATE) AS day, service, region, sum(cost) AS c FROM cur
               WHERE cost > 0 AND ts >= {DAY} - INTERVAL 30 DAY GROUP BY 1, 2, 3),
         s AS (SELECT service, region, avg(c) AS a, stddev_samp(c) AS sd FROM d
               GROUP BY 1, 2 HAVING count(*) >= 7),
         x AS (SELECT d.day, d.service, d.region, c, a,
                      CASE WHEN sd > 0 THEN abs(c - a) / sd ELSE 0 END AS z,
                      CASE WHEN c > a + sd * 2 THEN 'high_spend_anomaly'
                           WHEN c < a - sd * 2 AND c > 0 THEN 'low_spend_anomaly' ELSE 'normal' END AS kind
               FROM d JOIN s ON s.service = d.service AND s.region = d.region),
         an AS (SELECT *, c - a AS dev FROM x WHERE kind <> 'normal'),
         gr AS (SELECT *, CASE WHEN z > 3 THEN 'high' WHEN z > 2.5 THEN 'medium' ELSE 'low' END AS severity,
                       round(least(95, greatest(60, 95 - (z - 2) * 10)), 1) AS confidence FROM an),
         rc(service, kind, text) AS (VALUES ('AmazonEC2', 'high_spend_anomaly', 'New or larger instances'),
             ('AmazonS3', 'high_spend_anomaly', 'More transfer or storage'),
             ('AWSLambda', 'low_spend_anomaly', 'Fewer executions')),
         ex AS (SELECT gr.*, coalesce(text, 'Unexpected cost variation detected') AS cause
                FROM gr LEFT JOIN rc ON rc.service = gr.service AND rc.kind = gr.kind)
"""
CAUSES = [
    ("AmazonEC2", "high_spend_anomaly", "New or larger instances"),
    ("AmazonS3", "high_spend_anomaly", "More transfer or storage"),
    ("AWSLambda", "low_spend_anomaly", "Fewer executions"),
]


def _graded(s, d):
    return anomaly.grade_anomalies(
        anomaly.detect_anomalies(cur(s, d, anomaly.detect_anomalies), AS_OF, limit=None)
    )


def _explained(s, d):
    causes = s.createDataFrame(CAUSES, "service string, anomaly_type string, text string")
    return anomaly.explain_anomalies(_graded(s, d), causes)


ANOMALY = """day AS usage_date, service AS product_servicecode, region AS product_region,
    round(c, 6) AS daily_cost, round(a, 6) AS avg_daily_cost, round(z, 6) AS z_score,
    kind AS anomaly_type, round(dev, 6) AS cost_deviation"""
register(
    "detect_anomalies",
    on_cur(anomaly.detect_anomalies, AS_OF),
    DAILY + f"SELECT {ANOMALY} FROM an ORDER BY abs(c - a) DESC, day, service, region LIMIT 20",
    digits=6,
)
register(
    "grade_anomalies",
    _graded,
    DAILY + f"SELECT {ANOMALY}, severity, confidence, round(abs(dev), 6) AS cost_impact FROM gr",
    digits=6,
)
register(
    "explain_anomalies",
    _explained,
    DAILY + f"""
    SELECT {ANOMALY}, severity, confidence, round(abs(dev), 6) AS cost_impact, cause AS root_cause,
           concat_ws('; ', CASE WHEN abs(dev) > 1000 THEN 'large_cost_impact' END,
                     CASE WHEN service = 'AmazonEC2' THEN 'check_autoscaling' END,
                     CASE WHEN kind = 'high_spend_anomaly' THEN 'review_deployments' END) AS contributing_factors
    FROM ex
    """,
    digits=6,
)
register(
    "root_cause_summary",
    lambda s, d: anomaly.root_cause_summary(_explained(s, d)),
    DAILY + """
    SELECT cause AS root_cause, count(*) AS frequency, round(sum(abs(dev)), 2) AS total_cost_impact,
           string_agg(DISTINCT service, '; ' ORDER BY service) AS affected_services
    FROM ex GROUP BY cause
    """,
)
register(
    "overrun_predictions",
    lambda s, d: anomaly.overrun_predictions(
        anomaly.grade_anomalies(
            anomaly.detect_anomalies(
                cur(s, d, anomaly.detect_anomalies), AS_OF, lookback_days=2000, limit=None
            )
        )
    ),
    f"""
    WITH d AS (SELECT CAST(ts AS DATE) AS day, service, region, sum(cost) AS c FROM cur
               WHERE cost > 0 AND ts >= {DAY} - INTERVAL 2000 DAY GROUP BY 1, 2, 3),
         s AS (SELECT service, region, avg(c) AS a, stddev_samp(c) AS sd FROM d
               GROUP BY 1, 2 HAVING count(*) >= 7),
         an AS (SELECT d.service, CASE WHEN sd > 0 THEN abs(c - a) / sd ELSE 0 END AS z
                FROM d JOIN s ON s.service = d.service AND s.region = d.region
                WHERE c > a + sd * 2 OR (c < a - sd * 2 AND c > 0))
    SELECT service, count(*) AS high_severity_count, CASE WHEN count(*) > 2 THEN 'high' ELSE 'medium' END
        AS probability
    FROM an WHERE z > 3 GROUP BY service HAVING count(*) > 1
    """,
)
PATTERNS = f"""
    WITH m AS (SELECT month, service, sum(cost) AS s FROM cur
               WHERE cost > 0 AND ts >= {DAY} - INTERVAL 6 MONTH GROUP BY 1, 2),
         g AS (SELECT service, avg(s) AS a, stddev_samp(s) AS v, (max(s) - min(s)) / nullif(min(s), 0) * 100 AS r,
                      count(*) AS n FROM m GROUP BY 1 HAVING count(*) >= 3),
         p AS (SELECT *, CASE WHEN r > 50 THEN 'rapid_growth' WHEN r > 20 THEN 'growing' WHEN r > -10 THEN 'stable'
                              ELSE 'declining' END AS pattern FROM g WHERE a > 1000),
         q AS (SELECT service, pattern, a, round(r, 1) AS r,
                      CASE pattern WHEN 'rapid_growth' THEN 95 WHEN 'declining' THEN 70 ELSE 50 END AS pr,
                      CASE pattern WHEN 'rapid_growth' THEN 90 WHEN 'declining' THEN 85 ELSE 75 END AS conf FROM p)
"""


def _patterns(s, d):
    return anomaly.growth_patterns(cur(s, d, anomaly.growth_patterns), AS_OF)


def _graded_patterns(s, d):
    return anomaly.grade_patterns(_patterns(s, d))


register(
    "growth_patterns",
    _patterns,
    PATTERNS + """
    SELECT service, round(a, 5) AS avg_monthly_spend, round(v, 5) AS spend_volatility,
           round(r, 5) AS growth_rate, n AS months_data, pattern AS pattern_type FROM p
    """,
    digits=5,
)
register(
    "grade_patterns",
    _graded_patterns,
    PATTERNS + """
    SELECT service, pattern AS pattern_type, round(a, 5) AS avg_monthly_spend, r AS growth_rate,
           pr AS priority_score, conf AS confidence FROM q
    """,
    digits=5,
)
register(
    "pattern_benchmarks",
    lambda s, d: anomaly.pattern_benchmarks(
        _graded_patterns(s, d),
        s.createDataFrame(
            [("AmazonEC2", 4000000.0, 78), ("AmazonS3", 15000000.0, 85), ("AmazonGlacier", 1.0, 90)],
            "service string, industry_average double, efficiency_score int",
        ),
    ),
    PATTERNS + """, b(service, ia, es) AS (VALUES ('AmazonEC2', 4000000.0::DOUBLE, 78),
        ('AmazonS3', 15000000.0::DOUBLE, 85), ('AmazonGlacier', 1.0::DOUBLE, 90))
    SELECT q.service, round(a, 5) AS our_monthly_spend, ia AS industry_average,
           CASE WHEN a > ia THEN 'above' ELSE 'below' END AS vs_industry, es AS efficiency_score,
           round(least(95.0, greatest(5.0, 50 + (ia - a) / ia * 50)), 5) AS percentile
    FROM q JOIN b ON b.service = q.service
    """,
    digits=5,
)
register(
    "pattern_summary",
    lambda s, d: anomaly.pattern_summary(_graded_patterns(s, d)),
    PATTERNS + """
    SELECT count(*) AS total_services_analyzed, count(*) FILTER (WHERE pattern = 'rapid_growth') AS rapid_growth_services,
           count(*) FILTER (WHERE pattern = 'declining') AS declining_services, round(avg(r), 1) AS avg_growth_rate,
           count(*) - count(*) FILTER (WHERE pattern IN ('rapid_growth', 'declining')) AS stable_services,
           CASE WHEN count(*) FILTER (WHERE pattern = 'rapid_growth') > count(*) * 0.3 THEN 'high' ELSE 'low' END
               AS growth_volatility
    FROM q
    """,
)
register(
    "pattern_recommendations",
    lambda s, d: anomaly.pattern_recommendations(_graded_patterns(s, d)),
    PATTERNS + """
    SELECT service, 'ai_optimization' AS type, 'high' AS priority, pattern AS pattern_type, conf AS confidence
    FROM q WHERE pr > 80
    """,
)

# Forecasts.
MONTHLY = f"""
    WITH m AS (SELECT month, service, sum(cost) AS s FROM cur
               WHERE cost > 0 AND ts >= {DAY} - INTERVAL 12 MONTH GROUP BY 1, 2)
"""
FORECAST = MONTHLY + """,
    r AS (SELECT service, month, s, row_number() OVER (PARTITION BY service ORDER BY month DESC) AS back,
                 count(*) OVER (PARTITION BY service) AS n,
                 s - lag(s) OVER (PARTITION BY service ORDER BY month) AS diff FROM m),
    t AS (SELECT service, max(CASE WHEN back = 1 THEN s END) AS base,
                 avg(CASE WHEN back < 6 THEN diff END) AS chg
          FROM r WHERE n >= 3 AND back <= 6 GROUP BY service),
    u AS (SELECT *, CASE WHEN base > 0 THEN round(greatest(60, 90 - abs(chg) / base * 100), 1) ELSE 60 END AS conf,
                 CASE WHEN chg > 0 THEN 'increasing' ELSE 'decreasing' END AS trend FROM t),
    f AS (SELECT service, conf, trend, mo, (base + chg * mo) * (1 + 0.1 * sin(mo * pi() / 6)) AS v
          FROM u, (SELECT CAST(range AS INTEGER) AS mo FROM range(1, 7)))
"""


def _trend(s, d):
    return forecast.service_trend(forecast.forecast_inputs(cur(s, d, forecast.forecast_inputs), AS_OF))


def _totals(s, d):
    return forecast.service_forecast_totals(forecast.service_forecast(_trend(s, d)))


register(
    "forecast_inputs",
    on_cur(forecast.forecast_inputs, AS_OF, months=15),
    MONTHLY.replace("12 MONTH", "15 MONTH") + """
    SELECT month, service AS product_servicecode, round(s, 2) AS monthly_cost,
           round(lag(s) OVER w, 2) AS prev_month_cost, round(lag(s, 12) OVER w, 2) AS year_ago_cost
    FROM m WINDOW w AS (PARTITION BY service ORDER BY month)
    """,
)
register(
    "service_trend",
    _trend,
    FORECAST + """
    SELECT service, round(base, 6) AS base_cost, round(chg, 6) AS avg_change, conf AS confidence, trend FROM u
    """,
    digits=6,
)
register(
    "service_forecast",
    lambda s, d: forecast.service_forecast(_trend(s, d)),
    FORECAST + """
    SELECT service, mo AS month, round(greatest(0, v), 6) AS forecasted_cost,
           round(greatest(0, v * 0.85), 6) AS lower, round(v * 1.15, 6) AS upper, conf AS confidence, trend FROM f
    """,
    digits=6,
)
register(
    "service_forecast_totals",
    _totals,
    FORECAST + """
    SELECT service, conf AS confidence, trend, round(sum(greatest(0, v)), 6) AS total_forecasted
    FROM f GROUP BY 1, 2, 3
    """,
    digits=6,
)
register(
    "forecast_summary",
    lambda s, d: forecast.forecast_summary(_totals(s, d)),
    FORECAST + """
    SELECT count(DISTINCT service) AS total_services_forecasted, round(sum(greatest(0, v)), 2) AS total_forecasted_cost,
           count(DISTINCT CASE WHEN trend = 'increasing' THEN service END) AS growth_services,
           count(DISTINCT CASE WHEN trend = 'decreasing' THEN service END) AS declining_services,
           (SELECT round(avg(conf), 1) FROM u) AS forecast_confidence
    FROM f
    """,
)
register(
    "forecast_scenarios",
    lambda s, d: forecast.forecast_scenarios(_totals(s, d)),
    FORECAST + """
    SELECT scenario, round((SELECT sum(greatest(0, v)) FROM f) * factor, 2) AS total_cost, probability
    FROM (VALUES ('optimistic', 0.85::DOUBLE, 25), ('baseline', 1.0::DOUBLE, 50), ('pessimistic', 1.2::DOUBLE, 25))
         AS sc(scenario, factor, probability)
    """,
)
register(
    "highest_cost_services",
    on_cur(forecast.highest_cost_services, AS_OF),
    f"""
    SELECT service AS product_servicecode, round(sum(cost), 2) AS total_cost,
           count(DISTINCT resource) AS resource_count
    FROM cur WHERE cost > 0 AND {MONTH} GROUP BY service ORDER BY sum(cost) DESC LIMIT 5
    """,
)
register(
    "service_cost_breakdown",
    on_cur(forecast.highest_cost_services, AS_OF, limit=10),
    f"""
    SELECT service AS product_servicecode, round(sum(cost), 2) AS total_cost,
           count(DISTINCT resource) AS resource_count
    FROM cur WHERE cost > 0 AND {MONTH} GROUP BY service ORDER BY sum(cost) DESC LIMIT 10
    """,
)
SPEND_TREND = f"""
    WITH m AS (SELECT month, sum(cost) AS s FROM cur WHERE cost > 0 AND ts >= {DAY} - INTERVAL 6 MONTH GROUP BY 1)
"""
register(
    "spend_trend",
    on_cur(forecast.spend_trend, AS_OF),
    SPEND_TREND + "SELECT month, round(s, 2) AS monthly_cost FROM m",
)
register(
    "region_costs",
    on_cur(forecast.region_costs, AS_OF),
    f"""
    SELECT region AS product_region, round(sum(cost), 2) AS total_cost, count(DISTINCT service) AS service_count
    FROM cur WHERE cost > 0 AND {MONTH} GROUP BY region
    """,
)
register(
    "month_total",
    on_cur(forecast.month_total, AS_OF),
    f"SELECT 'total_spend' AS metric, round(sum(cost), 2) AS value FROM cur WHERE cost > 0 AND {MONTH}",
)
register(
    "month_overview",
    on_cur(forecast.month_overview, AS_OF),
    f"""
    SELECT round(sum(cost), 2) AS total_monthly_cost, count(DISTINCT service) AS service_count,
           count(DISTINCT resource) AS resource_count
    FROM cur WHERE cost > 0 AND {MONTH}
    """,
)
register(
    "trend_change",
    lambda s, d: forecast.trend_change(
        forecast.spend_trend(cur(s, d, forecast.spend_trend), AS_OF)
    ),
    SPEND_TREND + """, p AS (SELECT month, s, lag(s) OVER (ORDER BY month) AS b FROM m)
    SELECT month, round(s, 2) AS latest_cost, round(b, 2) AS previous_cost,
           round((s - b) / b * 100, 2) AS change_pct,
           CASE WHEN s > b THEN 'increased' ELSE 'decreased' END AS direction
    FROM p ORDER BY month DESC LIMIT 1
    """,
)

# KPIs.
RULES = (
    KpiRule("ec2_spot_cost", ("AmazonEC2",), "SpotUsage"),
    KpiRule("ec2_graviton_eligible_cost", ("AmazonEC2",), "BoxUsage", "large"),
    KpiRule("ec2_graviton_potential_savings", ("AmazonEC2",), "BoxUsage", "large", 0.2),
    KpiRule("ebs_all_cost", (), "EBS:"),
    KpiRule("ebs_gp2_cost", (), "gp2"),
    KpiRule("ebs_gp3_cost", (), "gp3"),
    KpiRule("ebs_gp3_potential_savings", (), "gp2", rate=0.2),
    KpiRule("ebs_snapshot_cost", (), "Snapshot"),
    KpiRule("s3_standard_storage_cost", ("AmazonS3",), "Box"),
    KpiRule("s3_standard_storage_potential_savings", ("AmazonS3",), "Box", rate=0.3),
    KpiRule("rds_graviton_potential_savings", ("AmazonRDS",), "Box", "xlarge", 0.1),
    KpiRule("compute_commit_potential_savings", ("AWSLambda",), rate=0.12),
    KpiRule("lambda_all_cost", ("AWSLambda",)),
)
BASE_KPIS = {
    "ec2_all_cost": "service = 'AmazonEC2'",
    "ec2_usage_cost": "service = 'AmazonEC2' AND usage_type LIKE '%BoxUsage%'",
    "rds_all_cost": "service = 'AmazonRDS'",
    "rds_ondemand_cost": "service = 'AmazonRDS'",
    "s3_all_storage_cost": "service = 'AmazonS3'",
    "compute_all_cost": "service IN ('AmazonEC2', 'AmazonRDS', 'AWSLambda')",
}
RULE_KPIS = {
    "ec2_spot_cost": ("service = 'AmazonEC2' AND usage_type LIKE '%SpotUsage%'", 1),
    "ec2_graviton_eligible_cost": (
        "service = 'AmazonEC2' AND usage_type LIKE '%BoxUsage%' AND itype LIKE '%large%'", 1),
    "ec2_graviton_potential_savings": (
        "service = 'AmazonEC2' AND usage_type LIKE '%BoxUsage%' AND itype LIKE '%large%'", 0.2),
    "ebs_all_cost": ("usage_type LIKE '%EBS:%'", 1),
    "ebs_gp2_cost": ("usage_type LIKE '%gp2%'", 1),
    "ebs_gp3_cost": ("usage_type LIKE '%gp3%'", 1),
    "ebs_gp3_potential_savings": ("usage_type LIKE '%gp2%'", 0.2),
    "ebs_snapshot_cost": ("usage_type LIKE '%Snapshot%'", 1),
    "s3_standard_storage_cost": ("service = 'AmazonS3' AND usage_type LIKE '%Box%'", 1),
    "s3_standard_storage_potential_savings": ("service = 'AmazonS3' AND usage_type LIKE '%Box%'", 0.3),
    "rds_graviton_potential_savings": (
        "service = 'AmazonRDS' AND usage_type LIKE '%Box%' AND itype LIKE '%xlarge%'", 0.1),
    "compute_commit_potential_savings": ("service = 'AWSLambda'", 0.12),
    "lambda_all_cost": ("service = 'AWSLambda'", 1),
}


def _kpi_sql(where: str, metrics: dict, period: str) -> str:
    sums = ", ".join(
        f"round(coalesce(sum(CASE WHEN {c} THEN cost * {r} ELSE 0 END), 0), 2) AS {m}"
        for m, (c, r) in metrics.items()
    )
    zeros = ", ".join(f"0.0::DOUBLE AS {m}" for m in kpi.METRICS if m not in metrics)
    return f"""
    SELECT '{period}' AS billing_period, 'default' AS payer_account_id, 'default' AS linked_account_id,
           round(sum(cost), 2) AS spend_all_cost, round(sum(cost), 2) AS unblended_cost, '{{}}' AS tags_json,
           {sums}, {zeros}
    FROM cur WHERE cost > 0 {where}
    """


BASE_METRICS = {m: (c, 1) for m, c in BASE_KPIS.items()}
register("kpi_summary", on_cur(kpi.kpi_summary, AS_OF), _kpi_sql("", BASE_METRICS, "2001-10"))
register(
    "kpi_summary_filtered",
    lambda s, d: kpi.kpi_summary(
        cur(s, d, kpi.kpi_summary, "resource_tags"), AS_OF, "2001-09", tags={"Team": "data"}
    ),
    _kpi_sql(
        "AND month = DATE '2001-09-01' AND team = 'data'", BASE_METRICS, "2001-09"
    ),
)
register(
    "kpi_rules",
    on_cur(kpi.kpi_summary, AS_OF, rules=RULES),
    _kpi_sql("", {**BASE_METRICS, **RULE_KPIS}, "2001-10"),
)


def _savings(s, d):
    return kpi.savings_summary(
        kpi.kpi_summary(cur(s, d, kpi.kpi_summary), AS_OF, "2001-10", rules=RULES)
    )


def _potential(*metrics: str) -> str:
    return " + ".join(
        f"sum(CASE WHEN {RULE_KPIS[m][0]} THEN cost * {RULE_KPIS[m][1]} ELSE 0 END)" for m in metrics
    )


SAVINGS = f"""kp AS (SELECT sum(cost) AS spend,
        {_potential("ec2_graviton_potential_savings")} AS ec2g,
        {_potential("rds_graviton_potential_savings")} AS rdsg,
        {_potential("ebs_gp3_potential_savings", "s3_standard_storage_potential_savings")} AS storage,
        {_potential("compute_commit_potential_savings")} AS compute
    FROM cur WHERE cost > 0 AND {MONTH}),
    sv AS (SELECT *, round(ec2g + rdsg + storage + compute, 2) AS pot,
                  (ec2g + rdsg + storage + compute) AS pot_raw FROM kp)"""
register(
    "savings_summary",
    _savings,
    f"""
    WITH {SAVINGS}
    SELECT round(spend, 2) AS spend_all_cost, pot AS total_potential_savings,
           round(ec2g + rdsg, 2) AS graviton_savings_potential,
           round(rdsg + compute, 2) AS commitment_savings_potential,
           round(storage, 2) AS storage_optimization_potential, 0.0::DOUBLE AS spot_instance_potential,
           0.0::DOUBLE AS current_monthly_savings, round(pot_raw * 12, 2) AS annualized_savings_opportunity
    FROM sv
    """,
)


def _health(s, d):
    idle = optimize.idle_resources(cur(s, d, optimize.idle_resources), AS_OF, limit=None)
    score = allocate.compliance_score(
        allocate.tagging_compliance(cur(s, d, allocate.tagging_compliance), AS_OF)
    )
    return kpi.cost_health_check(_savings(s, d), idle, score)


HEALTH = IDLE + "," + TAGS + f""", {SAVINGS},
    cs AS (SELECT round(sum(CASE WHEN status <> 'untagged' THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE) * 100, 1)
               AS tags FROM gt),
    h0 AS (SELECT spend, pot, pot / spend * 100 AS ratio, (SELECT count(*) FROM idle) AS idles,
                  (SELECT tags FROM cs) AS tags FROM sv),
    h AS (SELECT *, round(least(100, ratio * 2), 1) AS eff, greatest(0, 100 - idles * 5) AS opt,
                 round((round(least(100, ratio * 2), 1) + greatest(0, 100 - idles * 5) + tags) / 3, 1) AS overall
          FROM h0)
"""
FINDINGS = """concat_ws('; ', CASE WHEN tags < 70 THEN 'Low tagging compliance detected' END,
    CASE WHEN idles > 5 THEN CAST(idles AS VARCHAR) || ' idle resources found' END,
    CASE WHEN ratio > 20 THEN 'High optimization potential identified' END)"""
ADVICE = """concat_ws('; ', CASE WHEN tags < 70 THEN 'Implement automated tagging policies' END,
    CASE WHEN idles > 5 THEN 'Review and terminate unused resources' END,
    CASE WHEN ratio > 20 THEN 'Prioritize cost optimization initiatives' END)"""
register(
    "cost_health_check",
    _health,
    HEALTH + f"""
    SELECT round(spend, 2) AS spend_all_cost, pot AS total_potential_savings, round(ratio, 2) AS savings_ratio,
           idles AS idle_count, tags AS tagging_compliance, eff AS cost_efficiency,
           CAST(opt AS DOUBLE) AS resource_optimization, overall AS overall_score,
           {FINDINGS} AS findings, {ADVICE} AS recommendations
    FROM h
    """,
)
register(
    "executive_summary",
    lambda s, d: kpi.executive_summary(
        _health(s, d), spend.invoice_summary(cur(s, d, spend.invoice_summary), AS_OF)
    ),
    HEALTH + f""",
    im AS (SELECT month, sum(cost) AS s FROM cur WHERE cost > 0 AND ts >= {DAY} - INTERVAL 12 MONTH GROUP BY 1),
    ip AS (SELECT month, round((s - lag(s) OVER (ORDER BY month)) / lag(s) OVER (ORDER BY month) * 100, 2) AS mom
           FROM im),
    e AS (SELECT h.*, (SELECT mom FROM ip ORDER BY month DESC LIMIT 1) AS mom FROM h)
    SELECT round(spend, 2) AS current_monthly_spend, mom AS month_over_month_change,
           pot AS optimization_potential, round(ratio, 2) AS potential_savings_percentage,
           overall AS cost_health_score, idles AS idle_count, {ADVICE} AS priority_actions,
           {FINDINGS} AS detailed_findings,
           concat_ws('; ', 'Monthly cloud spend: $' || format('{{:,.2f}}', spend),
                     'Identified $' || format('{{:,.2f}}', pot) || ' in potential monthly savings',
                     CASE WHEN abs(mom) > 5 THEN 'Spend ' || CASE WHEN mom > 0 THEN 'increased' ELSE 'decreased' END
                          || ' ' || CAST(CAST(round(CAST(abs(mom) AS DECIMAL(18,2)), 1) AS DECIMAL(18,1)) AS VARCHAR)
                          || '% from last month' END,
                     'Found ' || CAST(idles AS VARCHAR) || ' idle resources for review') AS highlights,
           CASE WHEN mom > 20 THEN 'HIGH' WHEN mom > 10 OR ratio > 20 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
           concat_ws('; ', CASE WHEN mom > 20 THEN 'Rapid cost growth' WHEN mom > 10 THEN 'Moderate cost increase' END,
                     CASE WHEN ratio > 20 THEN 'High optimization potential indicates inefficiency' END) AS risk_factors
    FROM e
    """,
)
