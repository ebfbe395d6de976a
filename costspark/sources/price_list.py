"""Price-list documents, plan rates and spot history as rate tables.

A price-list document nests products and terms under keys that differ per
document, so the schema declares maps and the rows come from exploding them.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from costspark.functions.dates import since_days

# Region code -> display name in price lists.
REGION_NAMES = {
    "us-east-1": "US East (N. Virginia)",
    "us-east-2": "US East (Ohio)",
    "us-west-1": "US West (N. California)",
    "us-west-2": "US West (Oregon)",
    "eu-west-1": "Europe (Ireland)",
    "eu-west-2": "Europe (London)",
    "eu-west-3": "Europe (Paris)",
    "eu-central-1": "Europe (Frankfurt)",
    "eu-north-1": "Europe (Stockholm)",
    "eu-south-1": "Europe (Milan)",
    "ap-northeast-1": "Asia Pacific (Tokyo)",
    "ap-northeast-2": "Asia Pacific (Seoul)",
    "ap-northeast-3": "Asia Pacific (Osaka)",
    "ap-southeast-1": "Asia Pacific (Singapore)",
    "ap-southeast-2": "Asia Pacific (Sydney)",
    "ap-south-1": "Asia Pacific (Mumbai)",
    "ap-east-1": "Asia Pacific (Hong Kong)",
    "ca-central-1": "Canada (Central)",
    "sa-east-1": "South America (Sao Paulo)",
    "me-south-1": "Middle East (Bahrain)",
    "af-south-1": "Africa (Cape Town)",
}
# Usage-type prefix -> region; anything else is the default.
USAGE_PREFIXES = {
    "APN1": "ap-northeast-1",
    "USE1": "us-east-1",
    "USW2": "us-west-2",
    "EUW1": "eu-west-1",
    "NYC1": "us-east-1",
}
DEFAULT_REGION = "us-east-1"
# Metadata column -> (document attribute, value when missing).
METADATA = {
    "vcpu": ("vcpu", "Unknown"),
    "memory": ("memory", "Unknown"),
    "storage": ("storage", "EBS only"),
    "network_performance": ("networkPerformance", "Unknown"),
    "instance_family": ("instanceFamily", "Unknown"),
    "processor_features": ("processorFeatures", "Unknown"),
    "physical_processor": ("physicalProcessor", "Unknown"),
    "clock_speed": ("clockSpeed", "Unknown"),
    "enhanced_networking": ("enhancedNetworkingSupported", "Unknown"),
    "instance_sku": ("sku", "Unknown"),
}

DOCUMENT = """
    product struct<sku: string, attributes: map<string, string>>,
    terms map<string, map<string, struct<
        termAttributes: map<string, string>,
        priceDimensions: map<string, struct<unit: string, pricePerUnit: map<string, string>>>>>>
"""


def _lookup(key: Column, values: dict[str, str]) -> Column:
    pairs = [F.lit(x) for pair in values.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def region_display_name(code: str | Column) -> Column:
    """Display name of a region code; an unknown code names itself."""
    c = F.col(code) if isinstance(code, str) else code
    return F.coalesce(_lookup(c, REGION_NAMES), c)


def region_code(display_name: Column) -> Column:
    codes = {name: code for code, name in REGION_NAMES.items()}
    return F.coalesce(_lookup(display_name, codes), display_name)


def read_price_list(spark: SparkSession, path: str) -> DataFrame:
    """One document per line of the (possibly compressed) text files."""
    return spark.read.text(path).withColumnRenamed("value", "document")


def parse_documents(documents: DataFrame) -> DataFrame:
    """sku, attributes and terms of each parsable document."""
    parsed = documents.select(F.from_json("document", DOCUMENT).alias("d")).filter("d.product IS NOT NULL")
    attributes = F.col("d.product.attributes")
    get = lambda name: F.try_element_at(attributes, F.lit(name))
    return parsed.select(
        F.coalesce(F.col("d.product.sku"), get("sku")).alias("sku"),
        attributes.alias("attributes"),
        region_code(get("location")).alias("region_code"),
        get("instanceType").alias("instance_type"),
        get("operatingSystem").alias("operating_system"),
        get("tenancy").alias("tenancy"),
        F.col("d.terms").alias("terms"),
    )


def _has(name: str, value: str) -> Column:
    return F.try_element_at("attributes", F.lit(name)) == value


def _offers(parsed: DataFrame, kind: str) -> DataFrame:
    """One row per offer of a term kind, in document order."""
    keep = [c for c in parsed.columns if c != "terms"]
    return parsed.select(
        *keep,
        F.posexplode(F.try_element_at("terms", F.lit(kind))).alias("offer_no", "offer", "term"),
    )


def _dimensions(offers: DataFrame) -> DataFrame:
    keep = [c for c in offers.columns if c not in ("term", "attributes")]
    usd = F.try_element_at("d.pricePerUnit", F.lit("USD")).try_cast("double")
    return (
        offers.select(
            *keep,
            F.col("term.termAttributes").alias("term_attributes"),
            F.posexplode("term.priceDimensions").alias("dimension_no", "dimension", "d"),
        )
        .withColumn("usd", usd)
        .withColumn("unit", F.coalesce("d.unit", F.lit("")))
        .drop("d", "dimension")
    )


RATE_KEYS = ["region_code", "instance_type", "operating_system", "tenancy"]


def ondemand_rates(documents: DataFrame) -> DataFrame:
    """First non-zero hourly price per region, type, system and tenancy."""
    parsed = parse_documents(documents).filter(
        _has("capacitystatus", "Used")
        & _has("preInstalledSw", "NA")
        & _has("licenseModel", "No License required")
    )
    first = F.min_by("usd", F.struct("sku", "offer_no", "dimension_no"))
    return (
        _dimensions(_offers(parsed, "OnDemand"))
        .filter("usd <> 0")
        .groupBy(*RATE_KEYS)
        .agg(first.alias("price_per_hour_usd"))
    )


def reserved_rates(documents: DataFrame) -> DataFrame:
    """Upfront and hourly price of standard reservations per term and payment option."""
    term = lambda name: F.try_element_at("term_attributes", F.lit(name))
    offer = ["sku", "offer_no", "region_code", "instance_type", "operating_system"]
    upfront = F.col("unit").contains("Quantity")
    hourly = ~upfront & F.col("unit").contains("Hrs")
    rows = (
        _dimensions(_offers(parse_documents(documents).filter("tenancy = 'Shared'"), "Reserved"))
        .withColumn("term_length", term("LeaseContractLength"))
        .withColumn("payment_option", term("PurchaseOption"))
        .filter(term("OfferingClass") == "standard")
        .groupBy(*offer, "term_length", "payment_option")
        .agg(
            F.coalesce(F.max(F.when(upfront, F.col("usd"))), F.lit(0.0)).alias("upfront_cost"),
            F.coalesce(F.max(F.when(hourly, F.col("usd"))), F.lit(0.0)).alias("hourly_cost"),
        )
    )
    first = F.min_by(F.struct("upfront_cost", "hourly_cost"), F.struct("sku", "offer_no"))
    return (
        rows.groupBy("region_code", "instance_type", "operating_system", "term_length", "payment_option")
        .agg(first.alias("p"))
        .select("region_code", "instance_type", "operating_system", "term_length", "payment_option", "p.*")
    )


def instance_metadata(documents: DataFrame, location: str = DEFAULT_REGION) -> DataFrame:
    """One row per instance type, read from the Linux, shared-tenancy product."""
    rows = parse_documents(documents).filter(
        (F.col("region_code") == location)
        & (F.col("operating_system") == "Linux")
        & (F.col("tenancy") == "Shared")
    )
    one = rows.groupBy("instance_type").agg(F.min_by("attributes", "sku").alias("a"))
    return one.select(
        "instance_type",
        *[
            F.coalesce(F.try_element_at("a", F.lit(name)), F.lit(default)).alias(column)
            for column, (name, default) in METADATA.items()
        ],
    )


def decode_usage_type(df: DataFrame, column: str = "usage_type") -> DataFrame:
    """Add ``parsed_region`` and ``parsed_instance_type`` from a plan usage type.

    ``APN1-DedicatedUsage:c6i.large`` is Tokyo and c6i.large.  A prefix that is
    missing or unknown means the default region; without ':' both are empty.
    """
    c = F.col(column)
    prefix = F.split_part(c, F.lit(":"), F.lit(1))
    code = F.when(prefix.contains("-"), F.substring_index(prefix, "-", 1))
    region = F.coalesce(_lookup(code, USAGE_PREFIXES), F.lit(DEFAULT_REGION))
    split = c.contains(":")
    return df.withColumns(
        {
            "parsed_region": F.when(split, region).otherwise(""),
            "parsed_instance_type": F.when(split, F.split_part(c, F.lit(":"), F.lit(2))).otherwise(""),
        }
    )


def savings_plan_rates(offering_rates: DataFrame, service: str = "AmazonEC2") -> DataFrame:
    """One plan rate per region and instance type: that of the first usage type by name."""
    return (
        decode_usage_type(offering_rates.filter(F.col("service_code") == service))
        .groupBy(
            F.col("parsed_region").alias("region_code"),
            F.col("parsed_instance_type").alias("instance_type"),
        )
        .agg(F.min_by("rate", F.struct("usage_type", "rate")).alias("rate"))
    )


def spot_history(
    spot: DataFrame, as_of: date, days_back: int = 7, product: str = "Linux/UNIX"
) -> DataFrame:
    """Spot prices of the last days of one product description."""
    return spot.filter(
        since_days(as_of, days_back, "timestamp") & (F.col("product_description") == product)
    )


def latest_spot(spot: DataFrame, per_zone: bool = False, product: str = "Linux/UNIX") -> DataFrame:
    """Most recent price of a product per region (or zone) and instance type.

    Beside Windows on-demand prices belongs ``product="Windows"``.
    """
    keys = ["availability_zone"] if per_zone else []
    region = F.regexp_replace("availability_zone", "[a-z]$", "").alias("region_code")
    newest = F.max_by("spot_price", F.struct("timestamp", "availability_zone", "spot_price"))
    return (
        spot.filter(F.col("product_description") == product)
        .groupBy(region, "instance_type", *keys)
        .agg(newest.alias("spot_price"))
    )
