"""Shared parts of the registered queries and their DuckDB counterparts.

``cur`` in the SQL is the billing view written out independently of
``costspark.plans.billing_view``: every table joined, every column spelled out.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from costspark.plans.billing_view import billing_view

AS_OF = date(2001, 10, 31)
DAY = "DATE '2001-10-31'"
MONTH = "ts >= DATE '2001-10-01' AND ts < DATE '2001-11-01'"

CUR = """
    SELECT lpad(CAST(c_nationkey AS VARCHAR), 12, '9') AS payer,
           lpad(CAST(o_custkey AS VARCHAR), 12, '0') AS account,
           CAST(l_orderkey AS VARCHAR) AS invoice,
           l_shipdate AS ts,
           CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
           l_extendedprice AS cost,
           l_extendedprice * (1 - l_discount) AS net_cost,
           CASE WHEN l_linenumber = 7 THEN 0 WHEN l_linenumber <> 6 THEN l_quantity END AS usage,
           CASE p_type WHEN 'ECONOMY' THEN 'AmazonEC2' WHEN 'STANDARD' THEN 'AmazonRDS'
                WHEN 'LARGE' THEN 'AmazonS3' WHEN 'MEDIUM' THEN 'AWSLambda'
                WHEN 'SMALL' THEN 'ElasticLoadBalancing' WHEN 'PROMO' THEN 'AmazonAthena' END AS service,
           CASE WHEN n_nationkey % 10 <> 9 THEN
                CASE r_name WHEN 'AFRICA' THEN 'af-south-1' WHEN 'AMERICA' THEN 'us-east-1'
                     WHEN 'ASIA' THEN 'ap-southeast-1' WHEN 'EUROPE' THEN 'eu-west-1'
                     WHEN 'MIDDLE EAST' THEN 'me-south-1' END END AS region,
           n_name AS location,
           CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN NULL
                ELSE 'r-' || CAST(l_suppkey AS VARCHAR) END AS resource,
           'm5.' || CASE l_suppkey % 5 WHEN 0 THEN 'micro' WHEN 1 THEN 'small' WHEN 2 THEN 'medium'
                WHEN 3 THEN 'large' ELSE 'xlarge' END AS itype,
           CASE WHEN l_suppkey % 4 = 0 THEN 'Windows' ELSE 'Linux' END AS os,
           CASE WHEN l_suppkey % 7 = 0 THEN 'Dedicated' ELSE 'Shared' END AS tenancy,
           CASE l_suppkey % 3 WHEN 0 THEN 'MySQL' WHEN 1 THEN 'PostgreSQL' ELSE 'Oracle' END AS engine,
           CASE WHEN l_suppkey % 2 = 0 THEN 'Multi-AZ' ELSE 'Single-AZ' END AS deployment,
           CASE WHEN p_size <= 30 THEN 'RunInstances' ELSE 'CreateVolume' END AS operation,
           CASE WHEN p_size <= 12 THEN 'BoxUsage:m5.' WHEN p_size <= 18 THEN 'EBS:VolumeUsage.gp2'
                WHEN p_size <= 24 THEN 'EBS:VolumeUsage.gp3' WHEN p_size <= 32 THEN 'DataTransfer-Out-Bytes'
                WHEN p_size <= 38 THEN 'NatGateway-Hours' WHEN p_size <= 44 THEN 'SpotUsage:m5.'
                ELSE 'EBS:SnapshotUsage' END
             || CASE WHEN p_size <= 12 OR p_size BETWEEN 39 AND 44 THEN
                CASE l_suppkey % 5 WHEN 0 THEN 'micro' WHEN 1 THEN 'small' WHEN 2 THEN 'medium'
                     WHEN 3 THEN 'large' ELSE 'xlarge' END ELSE '' END AS usage_type,
           CASE WHEN l_returnflag = 'N' THEN 'Usage' WHEN l_returnflag = 'R' THEN 'SavingsPlanCoveredUsage'
                WHEN l_linestatus = 'O' THEN 'DiscountedUsage' ELSE 'RIFee' END AS kind,
           CASE WHEN l_returnflag = 'N' THEN 'OnDemand' ELSE 'Reserved' END AS term,
           CASE WHEN l_linenumber = 3 THEN 'arn:ri/' || CAST(l_suppkey AS VARCHAR) END AS ri_arn,
           CASE WHEN l_linenumber <= 2 THEN 'arn:sp/' || CAST(l_suppkey AS VARCHAR) END AS sp_arn,
           CASE o_orderpriority WHEN '1-URGENT' THEN 'prod' WHEN '2-HIGH' THEN 'dev'
                WHEN '3-MEDIUM' THEN 'test' END AS env,
           CASE WHEN o_orderpriority = '5-LOW' THEN NULL
                WHEN c_mktsegment = 'BUILDING' THEN 'platform' WHEN c_mktsegment = 'MACHINERY' THEN 'data'
                WHEN c_mktsegment = 'AUTOMOBILE' THEN 'product' END AS team,
           CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN p_brand END AS project,
           CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'ops' END AS owner,
           l_suppkey, l_linenumber, l_quantity, l_discount, l_orderkey, p_name, p_size, r_name, o_custkey
    FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey
    JOIN part ON l_partkey = p_partkey
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def with_cur(body: str, **ctes: str) -> str:
    """``body`` (a SELECT or WITH ... SELECT) over ``cur`` and further named parts."""
    parts = {"cur": CUR, **ctes}
    head = ", ".join(f"{name} AS ({text})" for name, text in parts.items())
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {head}, {body[5:]}"
    return f"WITH {head} {body}"


def tidy(df: DataFrame, digits: int | dict[str, int]) -> DataFrame:
    """Round doubles and join text arrays, so that results compare as values.

    ``digits`` may differ by column ("" is the rest): an average of prices needs
    more places than a large sum holds, or it sits exactly between two values
    and rounds by the order in which rows were added.
    """
    places = digits if isinstance(digits, dict) else {"": digits}
    out = []
    for f in df.schema.fields:
        c = f"`{f.name}`"
        n = places.get(f.name, places[""])
        if isinstance(f.dataType, T.DoubleType):
            out.append(f"round({c}, {n}) AS {c}")
        elif isinstance(f.dataType, T.DecimalType) and f.dataType.scale > 4:
            out.append(f"round(CAST({c} AS double), {n}) AS {c}")
        elif isinstance(f.dataType, T.ArrayType):
            out.append(f"array_join({c}, '; ') AS {c}")
        else:
            out.append(c)
    return df.selectExpr(*out)


def register(
    name: str,
    query: Callable[[SparkSession, str], DataFrame],
    sql: str | None = None,
    digits: int | dict[str, int] = 2,
    **ctes: str,
) -> None:
    """Add a query; ``sql`` is written over ``cur`` unless it starts with '--plain'."""
    if name in QUERIES:
        raise ValueError(f"query {name} is registered twice")
    QUERIES[name] = lambda spark, sf_dir: tidy(query(spark, sf_dir), digits)
    if sql is not None:
        ORACLE[name] = sql.strip()[7:] if sql.strip().startswith("--plain") else with_cur(sql, **ctes)


def cur(spark: SparkSession, sf_dir: str, *sources) -> DataFrame:
    """The billing view with the columns of the given operators or column names."""
    columns = []
    for s in sources:
        columns += [s] if isinstance(s, str) else list(s.columns)
    return billing_view(spark, sf_dir, *columns)


def on_cur(fn, *args, **kwargs):
    """``fn(billing view, *args)`` as a registered query."""
    return lambda spark, sf_dir: fn(cur(spark, sf_dir, fn), *args, **kwargs)
