"""Price lists, plan rates, spot prices, price joins and enrichments."""

from datetime import date

from pyspark.sql import functions as F

from checks import price_tables as tables
from checks.base import cur, register
from costspark.operators import enrich, pricing
from costspark.plans.billing_view import table
from costspark.runtime import scratch_path
from costspark.sources import price_list, sinks

OD = "WHERE instance_type <> 'm5.micro'"
ONDEMAND = f"SELECT * FROM prices {OD}"
SPOT_NOW = """
    SELECT region_code, instance_type, price FROM (
        SELECT *, row_number() OVER (PARTITION BY region_code, instance_type ORDER BY ts DESC, zone DESC, price DESC) AS n
        FROM spot WHERE product = 'Linux/UNIX') WHERE n = 1
"""

register(
    "ondemand_rates",
    lambda s, d: price_list.ondemand_rates(tables.documents(s, d)),
    f"""
    SELECT region_code, instance_type, operating_system, tenancy, round(price, 6) AS price_per_hour_usd
    FROM prices {OD}
    """,
    digits=6,
    prices=tables.AWS_PRICING,
)
register(
    "reserved_rates",
    lambda s, d: price_list.reserved_rates(tables.documents(s, d)),
    """
    SELECT region_code, instance_type, operating_system, '1yr' AS term_length, 'No Upfront' AS payment_option,
           0.0::DOUBLE AS upfront_cost, round(price * 0.6, 6) AS hourly_cost FROM prices WHERE tenancy = 'Shared'
    UNION ALL
    SELECT region_code, instance_type, operating_system, '3yr', 'All Upfront', round(price * 10512, 6), 0.0
    FROM prices WHERE tenancy = 'Shared'
    """,
    digits=6,
    prices=tables.AWS_PRICING,
)
register(
    "instance_metadata",
    lambda s, d: price_list.instance_metadata(tables.documents(s, d)),
    """
    SELECT DISTINCT instance_type, CASE instance_type WHEN 'm5.large' THEN '2' ELSE '1' END AS vcpu,
           CASE instance_type WHEN 'm5.large' THEN '8 GiB' ELSE 'Unknown' END AS memory, 'EBS only' AS storage,
           'Unknown' AS network_performance, 'Unknown' AS instance_family, 'Unknown' AS processor_features,
           'Unknown' AS physical_processor, 'Unknown' AS clock_speed, 'Unknown' AS enhanced_networking,
           'Unknown' AS instance_sku
    FROM prices WHERE region_code = 'us-east-1' AND operating_system = 'Linux' AND tenancy = 'Shared'
    """,
    prices=tables.AWS_PRICING,
)
register(
    "decode_usage_type",
    lambda s, d: price_list.decode_usage_type(tables.offering_rates(s, d)),
    """--plain
    SELECT usage_type, round(rate, 4) AS rate, service_code, region_code AS parsed_region,
           instance_type AS parsed_instance_type
    FROM (""" + tables.OFFERINGS + ")",
    digits=4,
)
register(
    "savings_plan_rates",
    lambda s, d: price_list.savings_plan_rates(tables.offering_rates(s, d)),
    """--plain
    WITH offers AS (""" + tables.OFFERINGS + "), plan AS (" + tables.PLAN_PRICES + """)
    SELECT region_code, instance_type, round(rate, 4) AS rate FROM plan
    """,
    digits=4,
)
register(
    "region_display_name",
    lambda s, d: (
        cur(s, d, "product_region", "line_item_unblended_cost")
        .groupBy(price_list.region_display_name("product_region").alias("region_name"))
        .agg(F.count("*").alias("lines"))
    ),
    """
    SELECT CASE region WHEN 'af-south-1' THEN 'Africa (Cape Town)' WHEN 'us-east-1' THEN 'US East (N. Virginia)'
             WHEN 'ap-southeast-1' THEN 'Asia Pacific (Singapore)' WHEN 'eu-west-1' THEN 'Europe (Ireland)'
             WHEN 'me-south-1' THEN 'Middle East (Bahrain)' END AS region_name, count(*) AS lines
    FROM cur GROUP BY 1
    """,
)
register(
    "spot_history",
    lambda s, d: price_list.spot_history(tables.spot(s, d), date(2024, 1, 30)),
    """--plain
    SELECT ts AS timestamp, region_code || zone AS availability_zone, instance_type,
           product AS product_description, round(price, 2) AS spot_price
    FROM (""" + tables.SPOT + ") WHERE product = 'Linux/UNIX' AND ts >= DATE '2024-01-30' - INTERVAL 7 DAY",
)
register(
    "latest_spot",
    lambda s, d: price_list.latest_spot(tables.spot(s, d)),
    "--plain WITH spot AS (" + tables.SPOT + ") SELECT region_code, instance_type, round(price, 2) AS spot_price FROM ("
    + SPOT_NOW + ")",
)
register(
    "latest_spot_per_zone",
    lambda s, d: price_list.latest_spot(tables.spot(s, d), per_zone=True),
    "--plain WITH spot AS (" + tables.SPOT + """)
    SELECT region_code, instance_type, region_code || zone AS availability_zone, round(price, 2) AS spot_price FROM (
        SELECT *, row_number() OVER (PARTITION BY region_code, zone, instance_type ORDER BY ts DESC, price DESC) AS n
        FROM spot WHERE product = 'Linux/UNIX') WHERE n = 1
    """,
)


def _compared(s, d, keys=None):
    docs = tables.documents(s, d)
    return pricing.compare_pricing(
        price_list.ondemand_rates(docs),
        price_list.latest_spot(tables.spot(s, d)),
        price_list.reserved_rates(docs),
        price_list.savings_plan_rates(tables.offering_rates(s, d)),
        keys,
    )


PARTS = {
    "prices": tables.AWS_PRICING,
    "spot": tables.SPOT,
    "offers": tables.OFFERINGS,
    "od": "SELECT region_code, instance_type, price FROM prices WHERE operating_system = 'Linux' "
    "AND tenancy = 'Shared' AND instance_type <> 'm5.micro'",
    "sp": SPOT_NOW,
    "ri": "SELECT region_code, instance_type, price * 0.6 AS price FROM prices "
    "WHERE operating_system = 'Linux' AND tenancy = 'Shared'",
    "pl": tables.PLAN_PRICES,
    "wide": """SELECT od.region_code, od.instance_type, od.price AS o, sp.price AS s, ri.price AS r, pl.rate AS p
        FROM od LEFT JOIN sp ON sp.region_code = od.region_code AND sp.instance_type = od.instance_type
        LEFT JOIN ri ON ri.region_code = od.region_code AND ri.instance_type = od.instance_type
        LEFT JOIN pl ON pl.region_code = od.region_code AND pl.instance_type = od.instance_type""",
}
register(
    "compare_pricing",
    _compared,
    """
    SELECT region_code, instance_type,
           round(o, 6) AS ondemand_hourly, round(o * 720, 6) AS ondemand_monthly, round(o * 8760, 6) AS ondemand_annual,
           round(s, 6) AS spot_hourly, round(s * 720, 6) AS spot_monthly, round(s * 8760, 6) AS spot_annual,
           round((o - s) / o * 100, 6) AS spot_savings_pct,
           round(r, 6) AS reserved_1yr_hourly, round(r * 720, 6) AS reserved_1yr_monthly,
           round(r * 8760, 6) AS reserved_1yr_annual, CASE WHEN r IS NOT NULL THEN 0.0::DOUBLE END AS reserved_1yr_upfront,
           round((o - r) / o * 100, 6) AS reserved_1yr_savings_pct,
           round(p, 6) AS savings_plan_hourly, round(p * 720, 6) AS savings_plan_monthly,
           round(p * 8760, 6) AS savings_plan_annual, round((o - p) / o * 100, 6) AS savings_plan_savings_pct
    FROM wide
    """,
    digits=6,
    **PARTS,
)
register(
    "cheapest_option",
    lambda s, d: pricing.cheapest_option(_compared(s, d)),
    """
    WITH options AS (
        SELECT region_code, instance_type, 0 AS n, 'ondemand' AS opt, o AS price, 0.0 AS pct FROM wide UNION ALL
        SELECT region_code, instance_type, 1, 'spot', s, (o - s) / o * 100 FROM wide UNION ALL
        SELECT region_code, instance_type, 2, 'reserved_1yr', r, (o - r) / o * 100 FROM wide UNION ALL
        SELECT region_code, instance_type, 3, 'savings_plan', p, (o - p) / o * 100 FROM wide),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY region_code, instance_type ORDER BY price, n) AS k
               FROM options WHERE price IS NOT NULL)
    SELECT region_code, instance_type, round(price, 6) AS hourly_price, opt AS cheapest_option,
           round(price * 720, 6) AS monthly_price, round(price * 8760, 6) AS annual_price,
           round(pct, 6) AS savings_vs_ondemand_pct
    FROM ranked WHERE k = 1
    """,
    digits=6,
    **PARTS,
)


def _matrix(regions):
    def run(s, d):
        keys = pricing.matrix_keys(tables.aws_pricing(s, d), regions)
        metadata = price_list.instance_metadata(tables.documents(s, d))
        return pricing.pricing_matrix(keys, _compared(s, d, keys), metadata)

    return run


MATRIX_SQL = """
    WITH k AS ({regions}),
    t AS (SELECT DISTINCT itype FROM cur WHERE usage > 0 AND region IS NOT NULL),
    ks AS (SELECT region, itype FROM k, t)
    SELECT ks.region, ks.itype AS instance_type,
           CASE ks.itype WHEN 'm5.large' THEN '2' ELSE '1' END AS vcpu,
           CASE ks.itype WHEN 'm5.large' THEN '8 GiB' ELSE 'Unknown' END AS memory,
           'EBS only' AS storage, 'Unknown' AS network_performance,
           round(od.price, 6) AS ondemand_hourly, round(od.price * 720, 6) AS ondemand_monthly,
           round(sp.price, 6) AS spot_hourly, round((od.price - sp.price) / od.price * 100, 6) AS spot_savings_pct,
           round(ri.price, 6) AS reserved_1yr_hourly,
           round((od.price - ri.price) / od.price * 100, 6) AS reserved_1yr_savings_pct,
           round(pl.rate, 6) AS savings_plan_hourly,
           round((od.price - pl.rate) / od.price * 100, 6) AS savings_plan_savings_pct
    FROM ks LEFT JOIN od ON od.region_code = ks.region AND od.instance_type = ks.itype
    LEFT JOIN sp ON sp.region_code = ks.region AND sp.instance_type = ks.itype
    LEFT JOIN ri ON ri.region_code = ks.region AND ri.instance_type = ks.itype
    LEFT JOIN pl ON pl.region_code = ks.region AND pl.instance_type = ks.itype
    """
GIVEN = "SELECT unnest(['us-east-1', 'us-west-2', 'eu-west-1', 'ap-southeast-1']) AS region"
PRICED = "SELECT DISTINCT region_code AS region FROM prices WHERE price IS NOT NULL AND region_code IS NOT NULL"
register("pricing_matrix", _matrix(pricing.MATRIX_REGIONS), MATRIX_SQL.format(regions=GIVEN), digits=6, **PARTS)
register("pricing_matrix_all_regions", _matrix(None), MATRIX_SQL.format(regions=PRICED), digits=6, **PARTS)

# Billing rows beside price tables.
register(
    "cost_efficiency",
    lambda s, d: pricing.cost_efficiency(cur(s, d, pricing.cost_efficiency), tables.aws_pricing(s, d)),
    """
    WITH j AS (SELECT c.*, p.price FROM cur c LEFT JOIN prices p ON p.instance_type = c.itype
                 AND p.region_code = c.region AND p.operating_system = c.os AND p.tenancy = c.tenancy
               WHERE c.service = 'AmazonEC2' AND c.kind = 'Usage' AND p.price IS NOT NULL)
    SELECT service AS line_item_product_code, itype AS product_instance_type, region AS product_region,
           operation AS line_item_operation, round(sum(cost), 5) AS actual_cost,
           round(avg(price), 9) AS current_on_demand_rate, round(sum(usage), 5) AS usage_hours,
           round(sum(usage * price), 5) AS theoretical_on_demand_cost,
           round(sum(cost) - sum(usage * price), 5) AS savings_amount,
           CASE WHEN sum(usage * price) > 0 THEN round((1 - sum(cost) / sum(usage * price)) * 100, 5) ELSE 0 END
               AS savings_percentage
    FROM j GROUP BY 1, 2, 3, 4
    """,
    digits={"": 5, "current_on_demand_rate": 9},
    prices=tables.AWS_PRICING,
)
register(
    "savings_plan_coverage",
    lambda s, d: pricing.savings_plan_coverage(
        cur(s, d, pricing.savings_plan_coverage), tables.savings_plans(s, d)
    ),
    """
    SELECT CAST(month AS TIMESTAMP) AS bill_billing_period_start_date, itype AS product_instance_type,
           region AS product_region, commitment AS commitment_amount_hourly, plan_type AS savings_plan_type,
           payment AS payment_option, years AS term_duration_years, round(sum(cost), 2) AS total_cost,
           round(sum(CASE WHEN sp_arn IS NOT NULL THEN cost ELSE 0 END), 2) AS savings_plan_covered_cost,
           round(sum(CASE WHEN sp_arn IS NULL THEN cost ELSE 0 END), 2) AS on_demand_cost,
           round(sum(CASE WHEN sp_arn IS NOT NULL THEN cost ELSE 0 END) / sum(cost) * 100, 2) AS coverage_percentage
    FROM cur LEFT JOIN plans ON arn = sp_arn
    WHERE service = 'AmazonEC2' AND kind = 'Usage' GROUP BY 1, 2, 3, 4, 5, 6, 7
    """,
    digits={"": 2, "commitment_amount_hourly": 3},
    plans=tables.SAVINGS_PLANS,
)
register(
    "savings_plan_opportunities",
    lambda s, d: pricing.savings_plan_opportunities(
        cur(s, d, pricing.savings_plan_opportunities), tables.aws_pricing(s, d)
    ),
    """
    WITH j AS (SELECT itype, region, month, sum(usage) AS h, sum(cost) AS c FROM cur JOIN prices
                 ON instance_type = itype AND region_code = region
               WHERE service = 'AmazonEC2' AND kind = 'Usage' AND sp_arn IS NULL GROUP BY 1, 2, 3),
         u AS (SELECT itype, region, avg(h) AS ah, min(h) AS mh, stddev_samp(h) AS sd, avg(c) AS ac
               FROM j GROUP BY 1, 2 HAVING count(*) >= 3)
    SELECT itype AS product_instance_type, region AS product_region, round(ah, 4) AS avg_monthly_hours,
           round(mh, 4) AS min_monthly_hours, round(sd, 4) AS usage_stddev, round(ac * 12, 4) AS annual_cost,
           CASE WHEN sd / nullif(ah, 0) < 0.2 THEN 'Low Variability - Good SP Candidate'
                WHEN sd / nullif(ah, 0) < 0.5 THEN 'Medium Variability - Consider SP'
                ELSE 'High Variability - SP May Not Be Optimal' END AS savings_plan_recommendation,
           round(mh, 4) AS recommended_hourly_commitment
    FROM u WHERE ah > 50
    """,
    digits=4,
    prices=tables.AWS_PRICING,
)
register(
    "plan_rate_comparison",
    lambda s, d: pricing.plan_rate_comparison(
        tables.plan_rates(s, d), tables.aws_pricing(s, d), tables.savings_plans(s, d)
    ),
    """
    SELECT r.itype AS instance_type, r.region AS savings_plan_region, usage_type, operation,
           round(rate, 6) AS savings_plan_rate, round(price, 6) AS current_on_demand_rate,
           CASE WHEN price > 0 THEN round((1 - rate / price) * 100, 6) ELSE 0 END AS savings_percentage,
           commitment AS commitment_amount_hourly, payment AS payment_option, years AS term_duration_years
    FROM rates r LEFT JOIN prices p ON p.instance_type = r.itype AND p.region_code = r.region
    LEFT JOIN plans ON plans.plan_id = r.plan_id
    WHERE service_code = 'AmazonEC2' AND price IS NOT NULL AND rate > 0
    """,
    digits=6,
    prices=tables.AWS_PRICING,
    rates=tables.PLAN_RATES,
    plans=tables.SAVINGS_PLANS,
)
register(
    "rds_cost",
    lambda s, d: pricing.rds_cost(cur(s, d, pricing.rds_cost), tables.aws_rds_pricing(s, d)),
    """
    SELECT iclass AS product_instance_class, c.region AS product_region, c.engine AS product_database_engine,
           c.deployment AS product_deployment_option, round(sum(cost), 5) AS actual_cost,
           round(sum(usage), 5) AS usage_hours, round(avg(price), 9) AS current_on_demand_rate,
           round(sum(usage * price), 5) AS theoretical_cost,
           round(sum(cost) - sum(usage * price), 5) AS cost_difference
    FROM cur c JOIN rds ON iclass = 'db.' || c.itype AND rds.region = c.region AND rds.engine = c.engine
         AND rds.deployment = c.deployment
    WHERE service = 'AmazonRDS' AND kind = 'Usage' GROUP BY 1, 2, 3, 4
    """,
    digits={"": 5, "current_on_demand_rate": 9},
    rds=tables.RDS_PRICING,
)

# Declared joins.


def _by_invoice(facts, invoices):
    joined = enrich.enrich(facts, {"invoice_summaries": invoices}, "invoice_summaries", full_key=True)
    return joined.groupBy(
        F.col("invoice_summaries_BillingPeriod.Year").alias("year"),
        F.col("invoice_summaries_InvoiceType").alias("invoice_type"),
    ).agg(
        F.count("*").alias("lines"),
        F.sum("line_item_unblended_cost").alias("cost"),
        F.max("invoice_summaries_DueDate").alias("last_due"),
    )


INVOICED = ("bill_invoice_id", "line_item_usage_account_id", "line_item_unblended_cost")


def _bucketed_invoices(s, d):
    """Facts and invoices saved in the same buckets, opened as tables and joined where they lie."""
    pairs = {e.table_id: e.keys for e in enrich.ENRICHMENTS["CUR"]}["invoice_summaries"]
    parts = ((cur(s, d, *INVOICED), [k for k, _ in pairs]), (tables.invoices(s, d), [k for _, k in pairs]))
    opened = []
    for rows, keys in parts:
        path = scratch_path(s, "bucketed")
        name = path.rsplit("/", 1)[1].replace("-", "_")
        sinks.save_bucketed(rows, name, path, keys, 16)
        opened.append(sinks.open_bucketed(s, f"{name}_again", path, rows.schema, keys, 16))
    return _by_invoice(*opened)


INVOICE_SQL = """
    SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CASE o_orderstatus WHEN 'P' THEN 'CREDIT_MEMO' ELSE 'INVOICE' END AS invoice_type,
           count(*) AS lines, round(sum(cost), 2) AS cost, max(o_orderdate + INTERVAL 30 DAY) AS last_due
    FROM cur LEFT JOIN orders o ON o.o_orderkey = cur.l_orderkey AND o.o_custkey = cur.o_custkey GROUP BY 1, 2
    """
register("enrich_invoices", lambda s, d: _by_invoice(cur(s, d, *INVOICED), tables.invoices(s, d)), INVOICE_SQL)
register("enrich_invoices_bucketed", _bucketed_invoices, INVOICE_SQL)


def _prices(s, d):
    return tables.aws_pricing(s, d).selectExpr(
        "instance_type AS InstanceType", "region_code AS Region", "operating_system AS OperatingSystem",
        "tenancy AS Tenancy", "price_per_hour_usd AS OnDemandPrice",
    )


def _enriched_prices(s, d):
    columns = ("product_instance_type", "product_region", "product_operating_system", "product_tenancy")
    joined = enrich.enrich(cur(s, d, *columns), {"ec2_pricing": _prices(s, d)}, "ec2_pricing")
    return joined.groupBy("product_instance_type").agg(
        F.count("*").alias("rows"), F.sum("ec2_pricing_OnDemandPrice").alias("price_sum")
    )


register(
    "enrich_prices",
    _enriched_prices,
    """
    SELECT itype AS product_instance_type, count(*) AS rows, round(sum(price), 6) AS price_sum
    FROM cur c LEFT JOIN prices p ON p.instance_type = c.itype AND p.region_code = c.region AND p.operating_system = c.os
         AND p.tenancy = c.tenancy GROUP BY itype
    """,
    digits=6,
    prices=tables.AWS_PRICING,
)


def _enriched_prices_first_key(s, d):
    joined = enrich.enrich(
        cur(s, d, "product_instance_type"), {"ec2_pricing": _prices(s, d)}, "ec2_pricing", full_key=False
    )
    return joined.groupBy("product_instance_type").agg(
        F.count("*").alias("rows"), F.min("ec2_pricing_OnDemandPrice").alias("lowest_price")
    )


register(
    "enrich_prices_first_key",
    _enriched_prices_first_key,
    """
    SELECT itype AS product_instance_type, count(*) AS rows, round(min(price), 5) AS lowest_price
    FROM cur LEFT JOIN prices ON instance_type = itype GROUP BY itype
    """,
    digits=5,
    prices=tables.AWS_PRICING,
)


def _enriched_plans(s, d):
    """One plan per account and region of the customers; rate and coverage from their numbers."""
    columns = ("line_item_usage_account_id", "product_region", "line_item_usage_amount")
    facts = cur(s, d, *columns)
    plans = facts.select(
        F.col("line_item_usage_account_id").alias("AccountId"), F.col("product_region").alias("Region")
    ).distinct().withColumns(
        {
            "SavingsPlanId": F.concat_ws("-", F.lit("sp"), "AccountId", "Region"),
            "HourlyRate": F.pmod(F.col("AccountId").cast("long"), F.lit(7)).cast("double") / 10,
        }
    ).filter(F.pmod(F.col("AccountId").cast("long"), F.lit(3)) > 0)
    joined = enrich.enrich(facts, {"savings_plans": plans}, "savings_plans")
    usage = F.col("line_item_usage_amount") * F.col("savings_plans_HourlyRate")
    return joined.groupBy("product_region").agg(
        F.count("*").alias("rows"), F.count("savings_plans_SavingsPlanId").alias("covered"), F.sum(usage).alias("plan_cost")
    )


register(
    "enrich_savings_plans",
    _enriched_plans,
    """
    SELECT region AS product_region, count(*) AS rows,
           count(CASE WHEN region IS NOT NULL AND CAST(account AS BIGINT) % 3 > 0 THEN 1 END) AS covered,
           round(sum(CASE WHEN region IS NOT NULL AND CAST(account AS BIGINT) % 3 > 0
                     THEN usage * (CAST(account AS BIGINT) % 7) / 10.0 END), 2) AS plan_cost
    FROM cur GROUP BY region
    """,
)


def _enriched_focus(s, d):
    from costspark.plans.billing_view import focus_view

    invoices = tables.invoices(s, d).withColumn("BillingAccountId", F.col("AccountId"))
    joined = enrich.enrich(
        focus_view(s, d), {"invoice_summaries": invoices}, "invoice_summaries", base="FOCUS", full_key=False
    )
    return joined.groupBy("ServiceName").agg(
        F.count("invoice_summaries_InvoiceId").alias("matched"), F.sum("ListCost").alias("list_cost")
    )


register(
    "enrich_focus_invoices",
    _enriched_focus,
    """
    SELECT service AS ServiceName, count(o_orderkey) AS matched, round(sum(cost), 2) AS list_cost
    FROM cur LEFT JOIN orders ON orders.o_orderkey = cur.l_orderkey GROUP BY service
    """,
)


def _rollup(s, d):
    accounts = table(s, d, "customer").selectExpr(
        "lpad(CAST(c_custkey AS string), 12, '0') AS account_id", "c_name AS account_name"
    )
    columns = ("line_item_usage_account_id", "line_item_unblended_cost", "line_item_usage_amount")
    summary = cur(s, d, *columns).selectExpr(
        "line_item_usage_account_id AS linked_account_id",
        "line_item_unblended_cost AS unblended_cost",
        "line_item_usage_amount AS usage_quantity",
    )
    return enrich.account_rollup(accounts, summary, limit=None)


register(
    "account_rollup",
    _rollup,
    """
    SELECT lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS account_id, c_name AS account_name,
           round(sum(cost), 2) AS total_cost, count(*) AS total_line_items, sum(usage) AS total_usage
    FROM customer LEFT JOIN cur v ON v.account = lpad(CAST(c_custkey AS VARCHAR), 12, '0')
    GROUP BY 1, 2
    """,
)
