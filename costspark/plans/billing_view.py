"""The star-schema test tables in the shape of a billing export.

``lineitem`` is the fact; ``orders`` gives the account, ``customer`` the payer
and team, ``nation``/``region`` the place, ``part`` the service.  Each column
names the tables it needs, and only those are joined: the keys are foreign
keys, so a join that serves no requested column changes nothing but cost.
No join is hinted; sizes decide (the 25-row and 5-row tables broadcast).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Schemas of the test tables that are read here.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": """c_custkey bigint, c_name string, c_nationkey int, c_acctbal double,
        c_mktsegment string""",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": """p_partkey bigint, p_name string, p_brand string, p_type string, p_size int,
        p_retailprice double""",
    "orders": """o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,
        o_orderdate timestamp_ntz, o_orderpriority string""",
    "lineitem": """l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,
        l_quantity double, l_extendedprice double, l_discount double, l_tax double,
        l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz""",
    "events": """event_id bigint, ts timestamp_ntz, user_id bigint, event_type string,
        value double, props string""",
}

# Test-table values -> billing values.
SERVICES = {
    "ECONOMY": "AmazonEC2",
    "STANDARD": "AmazonRDS",
    "LARGE": "AmazonS3",
    "MEDIUM": "AWSLambda",
    "SMALL": "ElasticLoadBalancing",
    "PROMO": "AmazonAthena",
}
REGIONS = {
    "AFRICA": "af-south-1",
    "AMERICA": "us-east-1",
    "ASIA": "ap-southeast-1",
    "EUROPE": "eu-west-1",
    "MIDDLE EAST": "me-south-1",
}
ENVIRONMENTS = {"1-URGENT": "prod", "2-HIGH": "dev", "3-MEDIUM": "test"}
TEAMS = {"BUILDING": "platform", "MACHINERY": "data", "AUTOMOBILE": "product"}
SIZES = ("micro", "small", "medium", "large", "xlarge")
ENGINES = ("MySQL", "PostgreSQL", "Oracle")

# Table -> (join condition, table that must be joined before it).
JOINS = {
    "orders": ("l_orderkey = o_orderkey", None),
    "customer": ("o_custkey = c_custkey", "orders"),
    "nation": ("c_nationkey = n_nationkey", "customer"),
    "region": ("n_regionkey = r_regionkey", "nation"),
    "part": ("l_partkey = p_partkey", None),
}


def _case(column: str, values: dict) -> str:
    branches = " ".join(f"WHEN {old!r} THEN {new!r}" for old, new in values.items())
    return f"CASE {column} {branches} END"


def _pick(number: str, values: tuple[str, ...]) -> str:
    return _case(f"{number} % {len(values)}", dict(enumerate(values)))


_SIZE = f"concat('m5.', {_pick('l_suppkey', SIZES)})"
_SERVICE = _case("p_type", SERVICES)
_REGION = f"CASE WHEN n_nationkey % 10 <> 9 THEN {_case('r_name', REGIONS)} END"
_ENVIRONMENT = _case("o_orderpriority", ENVIRONMENTS)
_USAGE = "CASE WHEN l_linenumber = 7 THEN 0.0D WHEN l_linenumber <> 6 THEN l_quantity END"
_RESOURCE = """CASE WHEN NOT (l_returnflag = 'A' AND l_linestatus = 'F')
    THEN concat('r-', l_suppkey) END"""
_MONTH = "CAST(trunc(l_shipdate, 'month') AS timestamp_ntz)"
_PLAN = "CASE WHEN l_linenumber <= 2 THEN concat('arn:sp/', l_suppkey) END"
_GEO = ("orders", "customer", "nation", "region")

# Billing column -> (SQL expression, tables it needs besides lineitem).
COLUMNS = {
    "bill_payer_account_id": (
        "lpad(CAST(c_nationkey AS string), 12, '9')", ("orders", "customer")),
    "bill_invoice_id": ("CAST(l_orderkey AS string)", ()),
    "bill_billing_period_start_date": (_MONTH, ()),
    "bill_billing_period_end_date": (
        "CAST(add_months(trunc(l_shipdate, 'month'), 1) AS timestamp_ntz)", ()),
    "identity_line_item_id": ("concat_ws('-', l_orderkey, l_linenumber)", ()),
    "line_item_usage_account_id": ("lpad(CAST(o_custkey AS string), 12, '0')", ("orders",)),
    "line_item_product_code": (_SERVICE, ("part",)),
    "line_item_usage_type": (
        f"""CASE WHEN p_size <= 12 THEN concat('BoxUsage:', {_SIZE})
            WHEN p_size <= 18 THEN 'EBS:VolumeUsage.gp2'
            WHEN p_size <= 24 THEN 'EBS:VolumeUsage.gp3'
            WHEN p_size <= 32 THEN 'DataTransfer-Out-Bytes'
            WHEN p_size <= 38 THEN 'NatGateway-Hours'
            WHEN p_size <= 44 THEN concat('SpotUsage:', {_SIZE})
            ELSE 'EBS:SnapshotUsage' END""",
        ("part",)),
    "line_item_operation": (
        "CASE WHEN p_size <= 30 THEN 'RunInstances' ELSE 'CreateVolume' END", ("part",)),
    "line_item_usage_start_date": ("l_shipdate", ()),
    "line_item_usage_end_date": ("l_shipdate + INTERVAL 1 HOUR", ()),
    "line_item_usage_amount": (_USAGE, ()),
    "line_item_unblended_cost": ("l_extendedprice", ()),
    "line_item_net_unblended_cost": ("l_extendedprice * (1 - l_discount)", ()),
    "line_item_line_item_type": (
        """CASE WHEN l_returnflag = 'N' THEN 'Usage'
            WHEN l_returnflag = 'R' THEN 'SavingsPlanCoveredUsage'
            WHEN l_linestatus = 'O' THEN 'DiscountedUsage' ELSE 'RIFee' END""",
        ()),
    "line_item_resource_id": (_RESOURCE, ()),
    "product": (f"map('product_name', p_name, 'region', {_REGION})", (*_GEO, "part")),
    "product_servicecode": (_SERVICE, ("part",)),
    "product_instance_type": (_SIZE, ()),
    "product_region": (_REGION, _GEO),
    "product_region_code": (_REGION, _GEO),
    "product_location": ("n_name", ("orders", "customer", "nation")),
    "product_operating_system": (
        "CASE WHEN l_suppkey % 4 = 0 THEN 'Windows' ELSE 'Linux' END", ()),
    "product_tenancy": ("CASE WHEN l_suppkey % 7 = 0 THEN 'Dedicated' ELSE 'Shared' END", ()),
    "product_instance_class": (f"concat('db.', {_SIZE})", ()),
    "product_database_engine": (_pick("l_suppkey", ENGINES), ()),
    "product_deployment_option": (
        "CASE WHEN l_suppkey % 2 = 0 THEN 'Multi-AZ' ELSE 'Single-AZ' END", ()),
    "pricing_term": ("CASE WHEN l_returnflag = 'N' THEN 'OnDemand' ELSE 'Reserved' END", ()),
    "resource_tags": (
        f"""CASE WHEN o_orderpriority <> '5-LOW' THEN map_from_entries(filter(array(
            struct('user:Environment', {_ENVIRONMENT}),
            struct('user:Team', {_case("c_mktsegment", TEAMS)}),
            struct('user:Project', CASE WHEN {_ENVIRONMENT} IS NOT NULL THEN p_brand END),
            struct('user:Owner', CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'ops' END)
            ), e -> e.col2 IS NOT NULL)) END""",
        ("orders", "customer", "part")),
    "reservation_reservation_a_r_n": (
        "CASE WHEN l_linenumber = 3 THEN concat('arn:ri/', l_suppkey) END", ()),
    "savings_plan_savings_plan_a_r_n": (_PLAN, ()),
}

_NET = "CAST(l_extendedprice AS decimal(18,2)) * (1 - CAST(l_discount AS decimal(4,2)))"
FOCUS_COLUMNS = {
    "BillingAccountId": COLUMNS["bill_payer_account_id"][0],
    "BillingAccountName": "n_name",
    "SubAccountId": COLUMNS["line_item_usage_account_id"][0],
    "EffectiveCost": f"CAST({_NET} AS decimal(38,12))",
    "ListCost": "CAST(CAST(l_extendedprice AS decimal(18,2)) AS decimal(38,12))",
    "ConsumedQuantity": f"CAST(CAST({_USAGE} AS decimal(18,2)) AS decimal(38,12))",
    "ConsumedUnit": "CASE WHEN p_size <= 12 THEN 'Hrs' ELSE 'GB' END",
    "InvoiceId": "CAST(l_orderkey AS string)",
    "CommitmentDiscountId": _PLAN,
    "CommitmentDiscountType": f"CASE WHEN {_PLAN} IS NOT NULL THEN 'Savings Plan' END",
    "CommitmentDiscountCategory": "CASE l_linenumber WHEN 1 THEN 'Spend' WHEN 2 THEN 'Usage' END",
    "RegionName": "r_name",
    "ResourceId": _RESOURCE,
    "ResourceType": _SIZE,
    "ServiceCategory": f"""CASE WHEN {_SERVICE} = 'AmazonS3' THEN 'Storage'
        WHEN {_SERVICE} IN ('AmazonRDS', 'AmazonAthena') THEN 'Databases' ELSE 'Compute' END""",
    "ServiceName": _SERVICE,
    "BillingPeriodStart": _MONTH,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table under its declared schema, so no file is opened to infer one."""
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def _join(spark: SparkSession, sf_dir: str, wanted: set[str]) -> DataFrame:
    closed = set()
    for name in wanted:
        while name:
            closed.add(name)
            name = JOINS[name][1]
    df = table(spark, sf_dir, "lineitem")
    for name, (condition, _) in JOINS.items():
        if name in closed:
            left, right = (c.strip() for c in condition.split("="))
            other = table(spark, sf_dir, name)
            df = df.join(other, df[left] == other[right])
    return df


def billing_view(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Billing rows with the given columns (all of them when none is named)."""
    names = list(dict.fromkeys(columns)) or list(COLUMNS)
    unknown = [c for c in names if c not in COLUMNS]
    if unknown:
        raise ValueError(f"unknown billing columns: {unknown}")
    wanted = {t for c in names for t in COLUMNS[c][1]}
    return _join(spark, sf_dir, wanted).selectExpr(
        *[f"{COLUMNS[c][0]} AS {c}" for c in names]
    )


def focus_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows under FOCUS names, amounts as decimals."""
    return _join(spark, sf_dir, set(JOINS)).selectExpr(
        *[f"{text} AS {name}" for name, text in FOCUS_COLUMNS.items()]
    )
