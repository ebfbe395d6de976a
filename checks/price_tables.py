"""Price, plan, invoice and spot tables derived from the test tables.

Each one is an aggregate or projection of the given tables, so it grows with
them; the SQL texts spell the same tables out for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.base import cur
from costspark.plans.billing_view import REGIONS, SIZES, _pick, table
from costspark.sources.price_list import region_display_name

# A thousandth of a line's cost stands for a price per hour.
UNIT_PRICE = "line_item_unblended_cost / 1000"


def _priced(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    rows = cur(spark, sf_dir, "line_item_unblended_cost", "line_item_usage_amount", *keys)
    return rows.filter("line_item_usage_amount > 0 AND product_region IS NOT NULL")


def aws_pricing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highest price seen per region, type, system and tenancy."""
    keys = {
        "product_region": "region_code",
        "product_instance_type": "instance_type",
        "product_operating_system": "operating_system",
        "product_tenancy": "tenancy",
    }
    named = [F.col(c).alias(n) for c, n in keys.items()]
    return _priced(spark, sf_dir, *keys).groupBy(*named).agg(F.max(F.expr(UNIT_PRICE)).alias("price_per_hour_usd"))


AWS_PRICING = """
    SELECT region AS region_code, itype AS instance_type, os AS operating_system, tenancy,
           max(cost / 1000) AS price
    FROM cur WHERE usage > 0 AND region IS NOT NULL GROUP BY 1, 2, 3, 4
"""


def aws_rds_pricing(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = {
        "product_region": "region_code",
        "product_instance_class": "instance_class",
        "product_database_engine": "database_engine",
        "product_deployment_option": "deployment_option",
    }
    named = [F.col(c).alias(n) for c, n in keys.items()]
    return _priced(spark, sf_dir, *keys).groupBy(*named).agg(F.max(F.expr(UNIT_PRICE)).alias("price_per_hour_usd"))


RDS_PRICING = """
    SELECT region, 'db.' || itype AS iclass, engine, deployment, max(cost / 1000) AS price
    FROM cur WHERE usage > 0 AND region IS NOT NULL GROUP BY 1, 2, 3, 4
"""


def savings_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One plan per supplier."""
    return table(spark, sf_dir, "supplier").selectExpr(
        "concat('sp-', s_suppkey) AS savings_plan_id",
        "concat('arn:sp/', s_suppkey) AS savings_plan_arn",
        "CASE WHEN s_nationkey % 2 = 0 THEN 'Compute' ELSE 'EC2Instance' END AS savings_plan_type",
        "round(abs(s_acctbal) / 1000, 3) AS commitment_amount_hourly",
        """CASE s_suppkey % 3 WHEN 0 THEN 'No Upfront' WHEN 1 THEN 'Partial Upfront'
           ELSE 'All Upfront' END AS payment_option""",
        "CASE WHEN s_suppkey % 2 = 0 THEN 1.0D ELSE 3.0D END AS term_duration_years",
    )


SAVINGS_PLANS = """
    SELECT 'sp-' || CAST(s_suppkey AS VARCHAR) AS plan_id, 'arn:sp/' || CAST(s_suppkey AS VARCHAR) AS arn,
           CASE WHEN s_nationkey % 2 = 0 THEN 'Compute' ELSE 'EC2Instance' END AS plan_type,
           round(abs(s_acctbal) / 1000, 3) AS commitment,
           CASE s_suppkey % 3 WHEN 0 THEN 'No Upfront' WHEN 1 THEN 'Partial Upfront' ELSE 'All Upfront' END AS payment,
           CASE WHEN s_suppkey % 2 = 0 THEN 1.0::DOUBLE ELSE 3.0::DOUBLE END AS years
    FROM supplier
"""


def plan_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lowest price per plan, type, region, usage type and operation."""
    keys = {
        "product_instance_type": "instance_type",
        "product_region": "region",
        "line_item_usage_type": "usage_type",
        "line_item_operation": "operation",
        "line_item_product_code": "service_code",
    }
    plan = F.replace("savings_plan_savings_plan_a_r_n", F.lit("arn:sp/"), F.lit("sp-"))
    rows = _priced(spark, sf_dir, *keys, "savings_plan_savings_plan_a_r_n")
    return (
        rows.filter("savings_plan_savings_plan_a_r_n IS NOT NULL")
        .groupBy(plan.alias("savings_plan_id"), *[F.col(c).alias(n) for c, n in keys.items()])
        .agg(F.min(F.expr(UNIT_PRICE)).alias("rate"))
    )


PLAN_RATES = """
    SELECT replace(sp_arn, 'arn:sp/', 'sp-') AS plan_id, itype, region, usage_type, operation,
           service AS service_code, min(cost / 1000) AS rate
    FROM cur WHERE usage > 0 AND region IS NOT NULL AND sp_arn IS NOT NULL GROUP BY 1, 2, 3, 4, 5, 6
"""


def offering_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchasable plan rates with prefixed usage types, one per supplier."""
    size = _pick("s_suppkey", SIZES)
    return table(spark, sf_dir, "supplier").selectExpr(
        f"""CASE WHEN s_suppkey % 11 = 10 THEN 'Requests' ELSE concat(
            CASE s_suppkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'APN1-' WHEN 2 THEN 'USE1-' WHEN 3 THEN 'USW2-'
                 WHEN 4 THEN 'EUW1-' ELSE 'XXX9-' END, 'BoxUsage:m5.', {size}) END AS usage_type""",
        "(abs(s_acctbal) + 1) / 10 AS rate",
        "CASE WHEN s_suppkey % 3 = 2 THEN 'AmazonSageMaker' ELSE 'AmazonEC2' END AS service_code",
    )


OFFERINGS = """
    SELECT CASE WHEN s_suppkey % 11 = 10 THEN 'Requests' ELSE
             CASE s_suppkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'APN1-' WHEN 2 THEN 'USE1-' WHEN 3 THEN 'USW2-'
                  WHEN 4 THEN 'EUW1-' ELSE 'XXX9-' END || 'BoxUsage:m5.' ||
             CASE s_suppkey % 5 WHEN 0 THEN 'micro' WHEN 1 THEN 'small' WHEN 2 THEN 'medium'
                  WHEN 3 THEN 'large' ELSE 'xlarge' END END AS usage_type,
           CASE WHEN s_suppkey % 11 = 10 THEN '' WHEN s_suppkey % 6 = 1 THEN 'ap-northeast-1'
                WHEN s_suppkey % 6 = 3 THEN 'us-west-2' WHEN s_suppkey % 6 = 4 THEN 'eu-west-1'
                ELSE 'us-east-1' END AS region_code,
           CASE WHEN s_suppkey % 11 = 10 THEN '' ELSE 'm5.' ||
             CASE s_suppkey % 5 WHEN 0 THEN 'micro' WHEN 1 THEN 'small' WHEN 2 THEN 'medium'
                  WHEN 3 THEN 'large' ELSE 'xlarge' END END AS instance_type,
           (abs(s_acctbal) + 1) / 10 AS rate,
           CASE WHEN s_suppkey % 3 = 2 THEN 'AmazonSageMaker' ELSE 'AmazonEC2' END AS service_code
    FROM supplier
"""
PLAN_PRICES = """
    SELECT region_code, instance_type, arg_min(rate, usage_type || lpad(CAST(rate AS VARCHAR), 20, '0')) AS rate
    FROM (SELECT region_code, instance_type, usage_type, min(rate) AS rate FROM offers
          WHERE service_code = 'AmazonEC2' GROUP BY 1, 2, 3) GROUP BY 1, 2
"""


def spot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spot prices from the event stream: type by event type, zone by user."""
    regions = _pick("user_id", tuple(REGIONS.values()))
    return table(spark, sf_dir, "events").selectExpr(
        "ts AS timestamp",
        f"concat({regions}, CASE event_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END) AS availability_zone",
        """concat('m5.', CASE event_type WHEN 'view' THEN 'micro' WHEN 'click' THEN 'small'
            WHEN 'error' THEN 'medium' WHEN 'purchase' THEN 'large' ELSE 'xlarge' END) AS instance_type""",
        "CASE WHEN event_id % 4 = 3 THEN 'Windows' ELSE 'Linux/UNIX' END AS product_description",
        "value AS spot_price",
    )


SPOT = """
    SELECT ts, CASE user_id % 5 WHEN 0 THEN 'af-south-1' WHEN 1 THEN 'us-east-1' WHEN 2 THEN 'ap-southeast-1'
               WHEN 3 THEN 'eu-west-1' ELSE 'me-south-1' END AS region_code,
           CASE event_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS zone,
           'm5.' || CASE event_type WHEN 'view' THEN 'micro' WHEN 'click' THEN 'small' WHEN 'error' THEN 'medium'
               WHEN 'purchase' THEN 'large' ELSE 'xlarge' END AS instance_type,
           CASE WHEN event_id % 4 = 3 THEN 'Windows' ELSE 'Linux/UNIX' END AS product, value AS price
    FROM events
"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One price-list document per row of ``aws_pricing``.

    The on-demand offer lists a zero price before the real one; reservations
    cost 60 % hourly (1 year) or 40 % of three years upfront, and a convertible
    offer must be skipped.
    """
    p = F.col("price_per_hour_usd")
    pair = lambda *kv: F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in kv])

    def price(unit: str, usd):
        usd = F.lit(usd) if isinstance(usd, str) else usd.cast("string")
        return F.struct(F.lit(unit).alias("unit"), pair("USD", usd).alias("pricePerUnit"))

    def offer(terms, *prices):
        dimensions = [x for i, c in enumerate(prices) for x in (f"d{i}", c)]
        return F.struct(terms.alias("termAttributes"), pair(*dimensions).alias("priceDimensions"))

    def reservation(length: str, option: str, kind: str):
        return pair("LeaseContractLength", length, "PurchaseOption", option, "OfferingClass", kind)

    terms = F.create_map(
        F.lit("OnDemand"),
        pair("o1", offer(pair("kind", "none"), price("Hrs", "0"), price("Hrs", p))),
        F.lit("Reserved"),
        pair(
            "r0", offer(reservation("1yr", "No Upfront", "convertible"), price("Hrs", p * 0.1)),
            "r1", offer(reservation("1yr", "No Upfront", "standard"), price("Hrs", p * 0.6)),
            "r2",
            offer(
                reservation("3yr", "All Upfront", "standard"),
                price("Quantity", p * 10512),
                price("Hrs", "0"),
            ),
        ),
    )
    attributes = F.create_map(
        F.lit("location"), region_display_name("region_code"),
        F.lit("instanceType"), F.col("instance_type"),
        F.lit("operatingSystem"), F.col("operating_system"),
        F.lit("tenancy"), F.col("tenancy"),
        F.lit("capacitystatus"), F.when(F.col("instance_type") == "m5.micro", "UnusedCapacity").otherwise("Used"),
        F.lit("preInstalledSw"), F.lit("NA"),
        F.lit("licenseModel"), F.lit("No License required"),
        F.lit("vcpu"), F.when(F.col("instance_type") == "m5.large", "2").otherwise("1"),
        F.lit("memory"), F.when(F.col("instance_type") == "m5.large", "8 GiB"),
    )
    sku = F.concat_ws("|", "region_code", "instance_type", "operating_system", "tenancy")
    return aws_pricing(spark, sf_dir).select(
        F.to_json(
            F.struct(
                F.struct(sku.alias("sku"), attributes.alias("attributes")).alias("product"),
                terms.alias("terms"),
            )
        ).alias("document")
    )


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice summaries from the orders."""
    return table(spark, sf_dir, "orders").selectExpr(
        "CAST(o_orderkey AS string) AS InvoiceId",
        "lpad(CAST(o_custkey AS string), 12, '0') AS AccountId",
        "CAST(CAST(o_totalprice AS decimal(18,2)) AS decimal(38,12)) AS TotalAmount",
        "named_struct('Month', month(o_orderdate), 'Year', year(o_orderdate)) AS BillingPeriod",
        "o_orderdate + INTERVAL 30 DAYS AS DueDate",
        "CASE o_orderstatus WHEN 'P' THEN 'CREDIT_MEMO' ELSE 'INVOICE' END AS InvoiceType",
    )
