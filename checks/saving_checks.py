"""Optimisation, allocation and discounts."""

from pyspark.sql import functions as F

from checks.base import AS_OF, DAY, MONTH, cur, on_cur, register
from costspark.operators import allocate, commit, optimize

IDLE = f"""
    WITH g AS (SELECT resource, service, itype, sum(cost) AS c,
                      avg(CASE WHEN usage > 0 THEN usage ELSE 0 END) AS u
               FROM cur WHERE cost > 0 AND {MONTH}
                 AND service IN ('AmazonEC2', 'AmazonRDS', 'ElasticLoadBalancing')
               GROUP BY resource, service, itype),
         idle AS (SELECT *, CASE WHEN u < 5 THEN 'idle' ELSE 'underutilized' END AS status,
                         CASE WHEN u < 5 THEN c * 0.9 ELSE c * 0.3 END AS saved
                  FROM g WHERE u < 10),
         risk AS (SELECT *, CASE WHEN service = 'ElasticLoadBalancing' THEN 'high'
                                 WHEN service = 'AmazonRDS' AND status = 'idle' THEN 'medium'
                                 WHEN status = 'idle' THEN 'low' ELSE 'medium' END AS risk_level FROM idle)
"""
register(
    "idle_resources",
    on_cur(optimize.idle_resources, AS_OF),
    IDLE + """
    SELECT resource AS resource_id, service, itype AS instance_type, round(c, 4) AS monthly_cost,
           round(u, 4) AS utilization, status, round(saved, 4) AS potential_savings, risk_level
    FROM risk ORDER BY saved DESC, resource, service LIMIT 50
    """,
    digits=4,
)
register(
    "termination_risk_levels",
    lambda s, d: optimize.risk_levels(
        optimize.idle_resources(cur(s, d, optimize.idle_resources), AS_OF, limit=None)
    ),
    IDLE + """
    SELECT risk_level, count(*) AS resources, round(sum(saved), 2) AS potential_savings
    FROM risk GROUP BY risk_level
    """,
)
SIZES = f"""
    WITH g AS (SELECT resource, itype, sum(cost) AS c, avg(usage) AS u FROM cur
               WHERE cost > 0 AND service = 'AmazonEC2' AND {MONTH}
               GROUP BY resource, itype HAVING count(*) > 1),
         r AS (SELECT *, CASE WHEN itype LIKE '%xlarge%' AND u < 50 THEN replace(itype, 'xlarge', 'large')
                              WHEN itype LIKE '%large%' AND u < 30 THEN replace(itype, 'large', 'medium')
                              WHEN itype LIKE '%medium%' AND u < 20 THEN replace(itype, 'medium', 'small')
                              ELSE itype END AS better,
                      CASE WHEN (itype LIKE '%xlarge%' AND u < 50) OR (itype LIKE '%large%' AND u < 30)
                             OR (itype LIKE '%medium%' AND u < 20) THEN c * 0.5 ELSE c END AS nc
               FROM g WHERE u < 60),
         t AS (SELECT *, row_number() OVER (ORDER BY c - nc DESC, resource, itype) AS place FROM r)
"""
register(
    "rightsizing",
    on_cur(optimize.rightsizing, AS_OF, min_records=1),
    SIZES + """
    SELECT 'rightsizing_' || resource AS id, resource AS resource_id, itype AS current_instance_type,
           round(c, 4) AS monthly_cost, round(u, 4) AS avg_usage, better AS recommended_instance_type,
           round(nc, 4) AS estimated_new_cost, CAST(round(CAST(c - nc AS DECIMAL(28,6)), 2) AS DOUBLE) AS monthly_savings,
           CAST(round(CAST((c - nc) * 12 AS DECIMAL(28,6)), 2) AS DOUBLE) AS annual_savings,
           CASE WHEN u < 20 THEN 95 WHEN u < 40 THEN 85 WHEN u < 60 THEN 70 ELSE 50 END AS confidence_score,
           'low' AS risk_level
    FROM t WHERE c - nc > 0 AND place <= 20
    """,
    digits=4,
)
register(
    "rightsizing_summary",
    lambda s, d: optimize.rightsizing_summary(
        optimize.rightsizing(cur(s, d, optimize.rightsizing), AS_OF, min_records=1, limit=None)
    ),
    SIZES + """
    SELECT count(*) AS recommendations, round(coalesce(sum(c - nc), 0), 2) AS savings_potential,
           CASE WHEN count(*) < 5 THEN 'easy' WHEN count(*) < 15 THEN 'medium' ELSE 'complex' END
               AS implementation_effort
    FROM t WHERE c - nc > 0
    """,
)
register(
    "migration_candidates",
    on_cur(optimize.migration_candidates, AS_OF),
    f"""
    WITH g AS (SELECT count(DISTINCT resource) AS n, sum(cost) AS c FROM cur
               WHERE cost > 0 AND service = 'AmazonEC2' AND itype LIKE '%micro%' AND {MONTH})
    SELECT 'EC2_to_Lambda' AS migration_type, n AS affected_resources, round(c, 4) AS current_monthly_cost,
           round(c * 0.3, 4) AS estimated_new_cost, round(c - c * 0.3, 2) AS monthly_savings,
           round((c - c * 0.3) * 12, 2) AS annual_savings
    FROM g WHERE n > 0
    """,
    digits=4,
)
TRANSFER = f"""
    WITH t AS (SELECT region, location,
                      sum(CASE WHEN usage_type LIKE '%DataTransfer%' THEN cost ELSE 0 END) AS c,
                      count(DISTINCT resource) AS n
               FROM cur WHERE cost > 0 AND usage_type LIKE '%Data%' AND {MONTH}
               GROUP BY region, location HAVING c > 100)
"""
register(
    "transfer_costs",
    on_cur(optimize.transfer_costs, AS_OF),
    TRANSFER + """
    SELECT region, location AS availability_zone, round(c, 4) AS transfer_cost, n AS resource_count,
           round(c * 0.7, 4) AS potential_savings FROM t
    """,
    digits=4,
)
register(
    "transfer_savings",
    lambda s, d: optimize.transfer_savings(
        optimize.transfer_costs(cur(s, d, optimize.transfer_costs), AS_OF)
    ),
    TRANSFER + """
    SELECT round(sum(c * 0.7), 2) AS savings, round(sum(c * 0.7) * 0.4, 2) AS same_zone_consolidation,
           round(sum(c * 0.7) * 0.3, 2) AS vpc_peering FROM t
    """,
)
register(
    "resource_activity",
    on_cur(optimize.resource_activity, "AmazonEC2", AS_OF),
    f"""
    WITH g AS (SELECT resource, service, sum(cost) AS c, count(DISTINCT CAST(ts AS DATE)) AS days,
                      min(ts) AS f, max(ts) AS l, CAST({DAY} - CAST(max(ts) AS DATE) AS INTEGER) AS since
               FROM cur WHERE service = 'AmazonEC2' AND cost > 0 AND ts >= {DAY} - INTERVAL 30 DAY
               GROUP BY resource, service)
    SELECT resource AS line_item_resource_id, service AS product_servicecode, round(c, 2) AS total_cost,
           days AS active_days, since AS days_since_last_use,
           CASE WHEN since > 7 THEN 'idle' WHEN days < 7 THEN 'underutilized' ELSE 'active' END
               AS optimization_opportunity,
           f AS first_seen, l AS last_seen
    FROM g WHERE since > 0
    """,
)
register(
    "zero_usage_waste",
    on_cur(optimize.zero_usage_waste, AS_OF),
    f"""
    SELECT resource AS line_item_resource_id, service AS product_servicecode,
           operation AS line_item_operation, round(sum(cost), 6) AS wasted_cost, count(*) AS idle_periods,
           round(avg(cost), 6) AS avg_idle_cost
    FROM cur WHERE ts >= {DAY} - INTERVAL 7 DAY AND cost > 0 AND (usage = 0 OR usage IS NULL)
    GROUP BY 1, 2, 3 HAVING sum(cost) > 5
    """,
    digits=6,
)
register(
    "zero_usage_lines",
    on_cur(optimize.zero_usage_lines, AS_OF),
    f"""
    SELECT resource AS line_item_resource_id, service AS product_servicecode,
           cost AS line_item_unblended_cost, ts AS line_item_usage_start_date
    FROM cur WHERE cost > 0 AND usage = 0 AND ts >= {DAY} - INTERVAL 7 DAY
    """,
)
register(
    "utilization_ratio",
    on_cur(optimize.utilization_ratio, AS_OF),
    f"""
    WITH g AS (SELECT resource, itype, sum(cost) AS c, sum(usage) AS h FROM cur
               WHERE ts >= {DAY} - INTERVAL 30 DAY AND service = 'AmazonEC2'
                 AND operation LIKE '%RunInstances%' GROUP BY resource, itype)
    SELECT resource AS line_item_resource_id, itype AS product_instance_type, round(c, 4) AS total_cost,
           round(h, 4) AS total_usage_hours, round(h / 720.0, 2) AS utilization_ratio,
           CASE WHEN h / 720.0 < 0.2 THEN 'Terminate' WHEN h / 720.0 < 0.5 THEN 'Downsize' ELSE 'Monitor' END
               AS recommendation
    FROM g WHERE c > 50
    """,
    digits=4,
)
register(
    "reservation_coverage",
    on_cur(optimize.reservation_coverage, AS_OF, days=365),
    f"""
    WITH g AS (SELECT service, itype, region,
                      sum(CASE WHEN kind = 'RIFee' THEN cost ELSE 0 END) AS fees,
                      sum(CASE WHEN kind = 'Usage' AND ri_arn IS NOT NULL THEN usage ELSE 0 END) AS ri,
                      sum(CASE WHEN kind = 'Usage' AND ri_arn IS NULL THEN usage ELSE 0 END) AS od,
                      sum(CASE WHEN kind = 'Usage' THEN usage ELSE 0 END) AS h
               FROM cur WHERE ts >= {DAY} - INTERVAL 365 DAY AND service = 'AmazonEC2' GROUP BY 1, 2, 3)
    SELECT service AS product_servicecode, itype AS product_instance_type, region AS product_region,
           round(fees, 2) AS ri_fees, ri AS ri_usage_hours, od AS on_demand_hours, h AS total_hours,
           CASE WHEN h > 0 THEN round(ri / h * 100, 2) ELSE 0 END AS ri_coverage_percent
    FROM g WHERE fees > 0 OR ri > 0
    """,
)
register(
    "resource_utilization",
    on_cur(optimize.resource_utilization, AS_OF),
    f"""
    SELECT resource AS line_item_resource_id, service AS product_servicecode, round(sum(cost), 2) AS total_cost,
           sum(usage) AS total_usage, count(*) AS billing_records, min(ts) AS first_usage, max(ts) AS last_usage
    FROM cur WHERE resource IS NOT NULL AND ts >= {DAY} - INTERVAL 7 DAY
    GROUP BY 1, 2 HAVING sum(cost) > 10 ORDER BY sum(cost) DESC, resource, service LIMIT 100
    """,
)

# Allocation.
HIERARCHY = f"""
    WITH g AS (SELECT payer, account, service, sum(cost) AS c, count(DISTINCT resource) AS r FROM cur
               WHERE cost > 0 AND {MONTH} GROUP BY payer, account, service),
         a AS (SELECT payer, account, sum(c) AS c, sum(r) AS r FROM g GROUP BY payer, account)
"""
register(
    "account_hierarchy",
    on_cur(allocate.account_hierarchy, AS_OF),
    HIERARCHY + """
    SELECT payer AS payer_account_id, account AS linked_account_id, round(c, 2) AS account_total_cost,
           CAST(r AS BIGINT) AS total_resources,
           CASE WHEN c > 10000 THEN 'Large' WHEN c > 1000 THEN 'Medium' ELSE 'Small' END AS account_size,
           'cost-center-' || right(account, 4) AS cost_center
    FROM a
    """,
)
register(
    "account_hierarchy_exact",
    on_cur(allocate.account_hierarchy, AS_OF, exact=True),
    f"""
    SELECT payer AS payer_account_id, account AS linked_account_id, round(sum(cost), 2) AS account_total_cost,
           count(DISTINCT resource) AS total_resources,
           CASE WHEN sum(cost) > 10000 THEN 'Large' WHEN sum(cost) > 1000 THEN 'Medium' ELSE 'Small' END
               AS account_size,
           'cost-center-' || right(account, 4) AS cost_center
    FROM cur WHERE cost > 0 AND {MONTH} GROUP BY payer, account
    """,
)
register(
    "cost_centers",
    lambda s, d: allocate.cost_centers(
        allocate.account_hierarchy(cur(s, d, allocate.account_hierarchy), AS_OF)
    ),
    HIERARCHY + """
    SELECT 'cost-center-' || right(account, 4) AS name, round(sum(c), 2) AS total_cost,
           count(*) AS account_count FROM a GROUP BY 1
    """,
)
STATUS = """CASE WHEN coalesce(env, team, project, owner) IS NULL THEN 'untagged'
    WHEN env IS NOT NULL AND team IS NOT NULL THEN 'fully_tagged'
    WHEN env IS NOT NULL OR team IS NOT NULL THEN 'partially_tagged' ELSE 'custom_tagged' END"""
TAGS = f"""
         t AS (SELECT resource, service, cost, {STATUS} AS status FROM cur
               WHERE cost > 0 AND resource IS NOT NULL AND {MONTH}),
         gt AS (SELECT status, service, count(DISTINCT resource) AS n, sum(cost) AS c FROM t GROUP BY 1, 2)
"""
TAGGING = "WITH " + TAGS
register(
    "tagging_status",
    lambda s, d: (
        cur(s, d, "resource_tags", "line_item_unblended_cost")
        .groupBy(allocate.tagging_status().alias("tagging_status"))
        .agg(F.count("*").alias("lines"), F.sum("line_item_unblended_cost").alias("cost"))
    ),
    f"""
    SELECT {STATUS} AS tagging_status, count(*) AS lines, round(sum(cost), 2) AS cost FROM cur GROUP BY 1
    """,
)
register(
    "tagging_compliance",
    on_cur(allocate.tagging_compliance, AS_OF),
    TAGGING + """
    SELECT status AS tagging_status, service AS product_servicecode, n AS resource_count,
           round(c, 2) AS total_cost,
           round(n / CAST((SELECT count(DISTINCT resource) FROM t) AS DOUBLE) * 100, 2) AS resource_percentage,
           round(c / (SELECT sum(cost) FROM t) * 100, 2) AS cost_percentage
    FROM gt
    """,
)


def _compliance(s, d):
    return allocate.tagging_compliance(cur(s, d, allocate.tagging_compliance), AS_OF)


register(
    "compliance_score",
    lambda s, d: allocate.compliance_score(_compliance(s, d)),
    TAGGING + """
    SELECT CAST(sum(n) AS BIGINT) AS total_resources,
           CAST(sum(CASE WHEN status <> 'untagged' THEN n ELSE 0 END) AS BIGINT) AS tagged_resources,
           round(sum(CASE WHEN status <> 'untagged' THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE) * 100, 1)
               AS compliance_score
    FROM gt
    """,
)
register(
    "tag_coverage",
    lambda s, d: allocate.tag_coverage(_compliance(s, d)),
    TAGGING + """
    SELECT service AS product_servicecode,
           CAST(sum(CASE WHEN status <> 'untagged' THEN n ELSE 0 END) AS BIGINT) AS tagged_resources,
           CAST(sum(n) AS BIGINT) AS total_resources,
           round(sum(CASE WHEN status <> 'untagged' THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE) * 100, 1)
               AS coverage_percentage
    FROM gt GROUP BY service
    """,
)
register(
    "untagged_services",
    lambda s, d: allocate.untagged_services(_compliance(s, d)),
    TAGGING + """
    SELECT service, n AS resource_count, round(c, 2) AS cost_impact,
           round(c / (SELECT sum(cost) FROM t) * 100, 2) AS cost_percentage
    FROM gt WHERE status = 'untagged'
    """,
)
CENTERS = f"""
    WITH t AS (SELECT CASE env WHEN 'prod' THEN 'Production' WHEN 'dev' THEN 'Development'
                           WHEN 'test' THEN 'Testing' ELSE 'Unallocated' END AS environment,
                      CASE team WHEN 'platform' THEN 'Platform' WHEN 'data' THEN 'Data'
                           WHEN 'product' THEN 'Product' ELSE 'Shared' END AS team_name,
                      coalesce(project, 'General') AS project_name, resource, service, cost
               FROM cur WHERE cost > 0 AND {MONTH})
"""
register(
    "cost_center_breakdown",
    on_cur(allocate.cost_center_breakdown, AS_OF),
    CENTERS + """
    SELECT environment, team_name AS team, project_name AS project,
           count(DISTINCT resource) AS resource_count, round(sum(cost), 2) AS allocated_cost,
           count(DISTINCT service) AS service_count,
           environment || '-' || team_name || '-' || project_name AS cost_center_id
    FROM t GROUP BY environment, team_name, project_name
    """,
)
BUDGETS = [("Production", 4000000.0), ("Development", 9000000.0), ("Testing", 5000000.0), ("Other", 1.0)]
register(
    "budget_variance",
    lambda s, d: allocate.budget_variance(
        allocate.cost_center_breakdown(cur(s, d, allocate.cost_center_breakdown), AS_OF),
        s.createDataFrame(BUDGETS, "environment string, amount double"),
    ),
    CENTERS.replace("WITH t AS", """WITH b(e, budget) AS (VALUES ('Production', 4000000.0::DOUBLE),
        ('Development', 9000000.0::DOUBLE), ('Testing', 5000000.0::DOUBLE), ('Other', 1.0::DOUBLE)), t AS""") + """
    SELECT environment AS cost_center, budget, round(sum(cost), 2) AS actual,
           round(sum(cost) - budget, 2) AS variance,
           round((sum(cost) - budget) / budget * 100, 2) AS variance_percentage,
           CASE WHEN (sum(cost) - budget) / budget * 100 > 10 THEN 'over_budget' ELSE 'within_budget' END
               AS status
    FROM t JOIN b ON e = environment GROUP BY environment, budget
    """,
)
register(
    "tag_allocation",
    on_cur(allocate.tag_allocation),
    """
    SELECT env AS environment, team, round(sum(cost), 2) AS allocated_cost FROM cur
    WHERE env IS NOT NULL GROUP BY env, team
    """,
)
RULES = [
    ("AmazonEC2", "Environment", "prod"),
    ("AmazonEC2", "Team", "data"),
    ("AmazonS3", "Owner", "ops"),
    ("AmazonGlacier", "Owner", "ops"),
]
register(
    "tag_rule_impact",
    lambda s, d: allocate.tag_rule_impact(
        cur(s, d, allocate.tag_rule_impact),
        s.createDataFrame(RULES, "service string, tag_key string, tag_value string"),
        AS_OF,
    ),
    f"""
    WITH r(service, tag_key, tag_value) AS (VALUES ('AmazonEC2', 'Environment', 'prod'),
             ('AmazonEC2', 'Team', 'data'), ('AmazonS3', 'Owner', 'ops'), ('AmazonGlacier', 'Owner', 'ops')),
         m AS (SELECT * FROM cur WHERE {MONTH})
    SELECT r.service, tag_key, tag_value, count(DISTINCT resource) AS affected_resources
    FROM r LEFT JOIN m ON m.service = r.service
      AND coalesce(CASE tag_key WHEN 'Environment' THEN env WHEN 'Team' THEN team ELSE owner END, '') <> tag_value
    GROUP BY 1, 2, 3
    """,
)

# Discounts.
PATTERNS = (("DiscountedUsage", "Reserved Instance"), ("SavingsPlan", "Savings Plan"), ("Spot", "Spot Instance"))
MODEL = """CASE WHEN kind LIKE '%DiscountedUsage%' THEN 'Reserved Instance'
    WHEN kind LIKE '%SavingsPlan%' THEN 'Savings Plan' ELSE 'On-Demand' END"""
register(
    "pricing_model",
    lambda s, d: (
        cur(s, d, "line_item_line_item_type", "line_item_unblended_cost")
        .groupBy(
            commit.pricing_model().alias("default_model"), commit.pricing_model(PATTERNS).alias("model")
        )
        .agg(F.count("*").alias("lines"))
    ),
    f"""
    SELECT CASE WHEN kind LIKE '%Reserved%' THEN 'Reserved Instance' WHEN kind LIKE '%SavingsPlans%'
                THEN 'Savings Plan' WHEN kind LIKE '%Spot%' THEN 'Spot Instance' ELSE 'On-Demand' END
               AS default_model,
           {MODEL} AS model, count(*) AS lines
    FROM cur GROUP BY 1, 2
    """,
)
AGREEMENTS = f"""
    WITH g AS (SELECT service, term, ri_arn, {MODEL} AS model, sum(cost) AS c, sum(usage) AS u,
                      count(DISTINCT resource) AS r
               FROM cur WHERE cost > 0 AND {MONTH} GROUP BY 1, 2, 3, 4),
         a AS (SELECT model, service, sum(c) AS c, sum(u) AS u, sum(r) AS r FROM g
               WHERE model IN ('Reserved Instance', 'Savings Plan') GROUP BY model, service)
"""
register(
    "current_agreements",
    on_cur(commit.current_agreements, AS_OF, PATTERNS),
    AGREEMENTS + """
    SELECT model AS agreement_type, service, round(c, 2) AS monthly_cost, round(u, 2) AS monthly_usage,
           CAST(r AS BIGINT) AS total_resources, round(c * 12, 2) AS annual_commitment FROM a
    """,
)
register(
    "agreement_totals",
    lambda s, d: commit.agreement_totals(
        commit.current_agreements(cur(s, d, commit.current_agreements), AS_OF, PATTERNS)
    ),
    AGREEMENTS + """
    SELECT count(*) AS agreements_count, round(sum(c * 12), 2) AS total_annual_commitment FROM a
    """,
)
NEGOTIATION = f"""
    WITH g AS (SELECT service, sum(cost) AS s, count(DISTINCT account) AS a, count(DISTINCT resource) AS r
               FROM cur WHERE cost > 0 AND ts >= {DAY} - INTERVAL 12 MONTH GROUP BY service HAVING sum(cost) > 10000),
         n AS (SELECT *, CASE WHEN s > 500000 THEN 20 WHEN s > 100000 THEN 15 WHEN s > 50000 THEN 10 ELSE 5 END AS p,
                      CASE WHEN s > 500000 THEN 'high' WHEN s > 100000 THEN 'medium' ELSE 'low' END AS pr FROM g)
"""
BENCH = [("AmazonEC2", 12.0, 18.0), ("AmazonS3", 8.0, 12.0), ("AmazonGlacier", 5.0, 8.0)]
BENCH_SQL = """b(service, avg_d, top_d) AS (VALUES ('AmazonEC2', 12.0::DOUBLE, 18.0::DOUBLE),
    ('AmazonS3', 8.0::DOUBLE, 12.0::DOUBLE), ('AmazonGlacier', 5.0::DOUBLE, 8.0::DOUBLE))"""


def _opportunities(s, d):
    return commit.negotiation_opportunities(cur(s, d, commit.negotiation_opportunities), AS_OF)


def _benchmarks(s):
    return s.createDataFrame(BENCH, "service string, average_discount double, top_quartile double")


register(
    "negotiation_opportunities",
    lambda s, d: _opportunities(s, d),
    NEGOTIATION + """
    SELECT service, round(s, 2) AS current_spend, p AS potential_discount_pct,
           round(s * p / 100, 2) AS estimated_savings, pr AS negotiation_priority,
           a AS account_count, r AS resource_count FROM n
    """,
)
register(
    "negotiation_plan",
    lambda s, d: commit.negotiation_plan(_opportunities(s, d), _benchmarks(s)),
    NEGOTIATION + f""", {BENCH_SQL}
    SELECT n.service, round(s, 2) AS current_spend, p AS potential_discount_pct,
           round(s * p / 100, 2) AS estimated_savings,
           CASE WHEN s > 500000 THEN '3_year' WHEN s > 100000 THEN '1_year' ELSE 'none' END AS commitment_required,
           CASE WHEN s > 500000 AND p > 15 THEN 'Schedule enterprise negotiation meeting'
                WHEN s > 100000 THEN 'Request volume discount review'
                ELSE 'Monitor for threshold achievement' END AS recommendation,
           coalesce(avg_d, 8.0) AS average_discount, coalesce(top_d, 12.0) AS top_quartile
    FROM n LEFT JOIN b ON b.service = n.service
    """,
)
register(
    "market_rates",
    lambda s, d: commit.market_rates(_opportunities(s, d), _benchmarks(s)),
    NEGOTIATION + f""", {BENCH_SQL}
    SELECT b.service, avg_d AS industry_average, top_d AS top_tier_discount, coalesce(p, 0) AS our_potential
    FROM b LEFT JOIN n ON b.service = n.service
    """,
)
register(
    "negotiation_summary",
    lambda s, d: commit.negotiation_summary(_opportunities(s, d)),
    NEGOTIATION + """
    SELECT count(*) FILTER (WHERE pr = 'high') AS high_priority_services,
           round(sum(s), 2) AS total_annual_spend, round(sum(s * p / 100), 2) AS potential_annual_savings FROM n
    """,
)
STABILITY = f"""
    WITH m AS (SELECT month, service, itype, sum(usage) AS u, sum(cost) AS c FROM cur
               WHERE cost > 0 AND ts >= {DAY} - INTERVAL 6 MONTH GROUP BY 1, 2, 3),
         t AS (SELECT service, itype, avg(u) AS au, stddev_samp(u) AS sd, avg(c) AS ac, count(*) AS n
               FROM m GROUP BY 1, 2 HAVING count(*) >= 3),
         st AS (SELECT *, CASE WHEN sd / au < 0.2 THEN 'stable' WHEN sd / au < 0.5 THEN 'moderate'
                               ELSE 'volatile' END AS pattern
                FROM t WHERE au > 0),
         rk AS (SELECT *, CASE WHEN pattern = 'volatile' OR sd / au > 0.5 THEN 'high'
                               WHEN pattern = 'moderate' THEN 'medium' ELSE 'low' END AS risk FROM st)
"""


def _stability(s, d):
    return commit.usage_stability(cur(s, d, commit.usage_stability), AS_OF, limit=None)


register(
    "usage_stability",
    on_cur(commit.usage_stability, AS_OF),
    STABILITY + """
    SELECT service, itype AS instance_type, round(au, 5) AS avg_monthly_usage, round(sd, 5) AS usage_stddev,
           round(ac, 5) AS avg_monthly_cost, n AS months_of_data, pattern AS usage_pattern FROM st
    ORDER BY ac DESC, service, itype LIMIT 20
    """,
    digits=5,
)
FUTURE = STABILITY + """,
    f AS (SELECT service, itype, mo,
                 round(au * (1 + 0.1 * sin(mo * pi() / 6)) * pow(1.02, mo), 2) AS fu,
                 round(au * (1 + 0.1 * sin(mo * pi() / 6)) * pow(1.02, mo) * (ac / au), 2) AS fc
          FROM st, (SELECT CAST(range AS INTEGER) AS mo FROM range(1, 13)))
"""
register(
    "usage_forecast",
    lambda s, d: commit.usage_forecast(_stability(s, d)),
    FUTURE + """
    SELECT service, itype AS instance_type, mo AS month, fu AS forecasted_usage, fc AS forecasted_cost FROM f
    """,
)
register(
    "annual_usage_forecast",
    lambda s, d: commit.annual_usage_forecast(commit.usage_forecast(_stability(s, d))),
    FUTURE + """
    SELECT service, itype AS instance_type, round(sum(fu), 2) AS total_usage, round(sum(fc), 2) AS total_cost
    FROM f GROUP BY 1, 2
    """,
)
register(
    "commitment_recommendations",
    lambda s, d: commit.commitment_recommendations(_stability(s, d)),
    STABILITY + """
    SELECT service, itype AS instance_type, risk AS risk_score,
           CASE pattern WHEN 'stable' THEN 'Reserved Instance' ELSE 'Savings Plan' END AS recommendation,
           CASE pattern WHEN 'stable' THEN '3_year' ELSE '1_year' END AS term,
           CASE pattern WHEN 'stable' THEN 80 ELSE 60 END AS coverage,
           CASE pattern WHEN 'stable' THEN 'high' ELSE 'medium' END AS confidence,
           round(ac * 12 * CASE pattern WHEN 'stable' THEN 0.4 ELSE 0.15 END, 4) AS estimated_savings
    FROM rk WHERE ac * 12 >= 10000 AND ((pattern = 'stable' AND risk = 'low') OR pattern = 'moderate')
    """,
    digits=4,
)
register(
    "portfolio_risk",
    lambda s, d: commit.portfolio_risk(_stability(s, d)),
    STABILITY + """
    SELECT CASE WHEN count(*) FILTER (WHERE risk = 'high') > count(*) * 0.3 THEN 'high'
                WHEN count(*) FILTER (WHERE risk = 'high') > 0 THEN 'medium' ELSE 'low' END AS portfolio_risk_level,
           round(count(*) FILTER (WHERE pattern = 'stable') / CAST(count(*) AS DOUBLE) * 100, 1)
               AS stable_services_percentage,
           count(*) FILTER (WHERE risk = 'high') AS high_risk_services, count(*) AS total_services,
           round(least(100.0, count(DISTINCT service) / CAST(count(*) AS DOUBLE) * 100), 2) AS diversification_score,
           round(count(*) FILTER (WHERE pattern = 'stable') / CAST(count(*) AS DOUBLE) * 100, 1)
               AS overall_confidence
    FROM rk
    """,
)
register(
    "service_confidence",
    lambda s, d: commit.service_confidence(_stability(s, d)),
    STABILITY + """
    SELECT service, itype AS instance_type,
           CASE pattern WHEN 'stable' THEN 90 WHEN 'moderate' THEN 70 ELSE 40 END AS confidence FROM st
    """,
)
register(
    "annual_baseline",
    on_cur(commit.annual_baseline, AS_OF),
    f"SELECT round(sum(cost) * 12, 2) AS annual_spend FROM cur WHERE {MONTH}",
)
SCENARIOS = f"""
    WITH base AS (SELECT account, sum(cost) * 12 AS s FROM cur WHERE {MONTH} GROUP BY account),
         sc(id, n, kind, cover, off_pct) AS (VALUES ('scenario_1', 1, '1_year_ri', 70, 30),
             ('scenario_2', 2, '3_year_ri', 50, 45), ('scenario_3', 3, 'savings_plan', 80, 15)),
         x AS (SELECT account, s, id, n, kind, cover, off_pct, s * cover / 100 AS cov,
                      s * cover / 100 * (off_pct / 100.0) AS saved, s * cover / 100 * 0.1 AS up
               FROM base, sc),
         y AS (SELECT *, round((saved * 3 - up) / up * 100, 1) AS roi,
                      CASE WHEN kind LIKE '3_year%' OR cover > 80 THEN 3
                           WHEN kind LIKE '1_year%' OR cover > 60 THEN 2 ELSE 1 END AS risk FROM x)
"""


def _scenarios(s, d):
    account = "line_item_usage_account_id"
    return commit.commitment_scenarios(
        commit.annual_baseline(cur(s, d, commit.annual_baseline), AS_OF, account)
    )


register(
    "commitment_scenarios",
    _scenarios,
    SCENARIOS + """
    SELECT account AS line_item_usage_account_id, round(s, 4) AS annual_spend, id AS scenario_id,
           kind AS commitment_type, cover AS coverage_percentage, off_pct AS discount_percentage,
           round(cov, 4) AS covered_spend, round(saved, 4) AS annual_savings,
           round(cov * (1 - off_pct / 100.0) + s * (100 - cover) / 100, 4) AS net_annual_cost,
           round(up, 4) AS upfront_cost, roi AS three_year_roi,
           round(up / (saved / 12), 1) AS payback_period_months,
           CASE risk WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS risk_level
    FROM y
    """,
    digits=4,
)
register(
    "best_scenarios",
    lambda s, d: commit.best_scenarios(_scenarios(s, d), "line_item_usage_account_id"),
    SCENARIOS + """
    SELECT account AS line_item_usage_account_id,
           max(CASE WHEN r1 = 1 THEN id END) AS best_roi_scenario,
           max(CASE WHEN r2 = 1 THEN id END) AS lowest_risk_scenario,
           max(CASE WHEN r3 = 1 THEN id END) AS highest_savings_scenario
    FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY roi DESC, n) AS r1,
                 row_number() OVER (PARTITION BY account ORDER BY risk, n) AS r2,
                 row_number() OVER (PARTITION BY account ORDER BY saved DESC, n) AS r3 FROM y)
    GROUP BY account
    """,
)
