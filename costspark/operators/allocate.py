"""Cost by account, cost centre and tag."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costspark.functions.cases import first_match
from costspark.functions.dates import START, in_month, parse_period
from costspark.functions.filters import COST, positive_cost
from costspark.functions.needs import needs
from costspark.functions.ratios import percent
from costspark.functions.tags import TAGS, tag_value, tagging_status
from costspark.operators.spend import ACCOUNT, PAYER, RESOURCE, SERVICE, by_keys_and_ids

# Text in the tag value -> label, first match wins.
ENVIRONMENTS = (("prod", "Production"), ("dev", "Development"), ("test", "Testing"))
TEAMS = (("platform", "Platform"), ("data", "Data"), ("product", "Product"))


def account_size(cost: str) -> Column:
    c = F.col(cost)
    return F.when(c > 10000, "Large").when(c > 1000, "Medium").otherwise("Small")


@needs(PAYER, ACCOUNT, SERVICE, RESOURCE, COST, START)
def account_hierarchy(cur: DataFrame, as_of: date, exact: bool = False) -> DataFrame:
    """Month cost and resources per payer and account.

    A resource used under two services counts twice, as in the original;
    ``exact=True`` counts it once.
    """
    parts = by_keys_and_ids(
        cur.filter(positive_cost() & in_month(as_of)), [PAYER, ACCOUNT], [SERVICE, RESOURCE]
    )
    resources = F.countDistinct(RESOURCE) if exact else F.count(RESOURCE)
    return (
        parts.groupBy(
            F.col(PAYER).alias("payer_account_id"), F.col(ACCOUNT).alias("linked_account_id")
        )
        .agg(F.sum("cost").alias("account_total_cost"), resources.alias("total_resources"))
        .withColumn("account_size", account_size("account_total_cost"))
        .withColumn("cost_center", F.concat(F.lit("cost-center-"), F.right("linked_account_id", F.lit(4))))
        .orderBy(F.desc("account_total_cost"), "payer_account_id", "linked_account_id")
    )


def cost_centers(hierarchy: DataFrame) -> DataFrame:
    """``account_hierarchy`` rows by the last four characters of the account."""
    return hierarchy.groupBy(F.col("cost_center").alias("name")).agg(
        F.sum("account_total_cost").alias("total_cost"),
        F.count("*").alias("account_count"),
    )


@needs(RESOURCE, SERVICE, COST, TAGS, START)
def tagging_compliance(cur: DataFrame, as_of: date) -> DataFrame:
    """Resources and cost by tagging status and service, with shares of the month.

    A resource may appear under several statuses, so the overall count is taken
    over resources, not over these groups.  Facts shrink to one row per
    resource, status and service first; groups and overall figures both read
    that one shuffle.
    """
    rows = cur.filter(positive_cost() & F.col(RESOURCE).isNotNull() & in_month(as_of)).select(
        RESOURCE, SERVICE, COST, tagging_status().alias("tagging_status")
    )
    parts = rows.groupBy(RESOURCE, "tagging_status", SERVICE).agg(F.sum(COST).alias("cost"))
    overall = parts.groupBy(RESOURCE).agg(F.sum("cost").alias("cost"))
    total = overall.agg(
        F.struct(F.count("*").alias("resources"), F.sum("cost").alias("cost"))
    ).scalar()
    return (
        parts.groupBy("tagging_status", SERVICE)
        .agg(F.count("*").alias("resource_count"), F.sum("cost").alias("total_cost"))
        .withColumn("resource_percentage", percent("resource_count", total["resources"]))
        .withColumn("cost_percentage", percent("total_cost", total["cost"]))
        .orderBy(F.desc("total_cost"), "tagging_status", SERVICE)
    )


def _tagged_count() -> Column:
    tagged = F.when(F.col("tagging_status") != "untagged", F.col("resource_count"))
    return F.coalesce(F.sum(tagged), F.lit(0))


def compliance_score(compliance: DataFrame) -> DataFrame:
    """Tagged share of the group counts of ``tagging_compliance``; one row."""
    total, tagged = F.col("total_resources"), F.col("tagged_resources")
    return compliance.agg(
        F.coalesce(F.sum("resource_count"), F.lit(0)).alias("total_resources"),
        _tagged_count().alias("tagged_resources"),
    ).withColumn(
        "compliance_score", F.coalesce(F.round(F.try_divide(tagged, total) * 100, 1), F.lit(0.0))
    )


def tag_coverage(compliance: DataFrame) -> DataFrame:
    """Tagged share per service."""
    return (
        compliance.groupBy(SERVICE)
        .agg(
            _tagged_count().alias("tagged_resources"),
            F.sum("resource_count").alias("total_resources"),
        )
        .withColumn("coverage_percentage", percent("tagged_resources", "total_resources", 1))
    )


def untagged_services(compliance: DataFrame) -> DataFrame:
    return compliance.filter(F.col("tagging_status") == "untagged").select(
        F.col(SERVICE).alias("service"),
        "resource_count",
        F.col("total_cost").alias("cost_impact"),
        "cost_percentage",
    )


def _label(key: str, labels, default: str) -> Column:
    return first_match(((tag_value(key).contains(text), label) for text, label in labels), default)


@needs(RESOURCE, SERVICE, COST, TAGS, START)
def cost_center_breakdown(cur: DataFrame, as_of: date, period: str | None = None) -> DataFrame:
    """Cost by environment, team and project tag of the month (or of ``period``)."""
    keys = ["environment", "team", "project"]
    rows = cur.filter(positive_cost() & in_month(parse_period(period) if period else as_of)).select(
        RESOURCE,
        SERVICE,
        COST,
        _label("Environment", ENVIRONMENTS, "Unallocated").alias("environment"),
        _label("Team", TEAMS, "Shared").alias("team"),
        F.coalesce(tag_value("Project"), F.lit("General")).alias("project"),
    )
    return (
        by_keys_and_ids(rows, keys, [RESOURCE, SERVICE])
        .groupBy(*keys)
        .agg(
            F.countDistinct(RESOURCE).alias("resource_count"),
            F.sum("cost").alias("allocated_cost"),
            F.countDistinct(SERVICE).alias("service_count"),
        )
        .withColumn("cost_center_id", F.concat_ws("-", *keys))
        .orderBy(F.desc("allocated_cost"), *keys)
    )


def budget_variance(breakdown: DataFrame, budgets: DataFrame) -> DataFrame:
    """Environment totals against budgets (environment, amount); over when >10 % above."""
    actual = breakdown.groupBy("environment").agg(F.sum("allocated_cost").alias("actual"))
    over = F.col("actual") - F.col("budget")
    share = F.try_divide(over, "budget") * 100
    return (
        actual.join(budgets.select("environment", F.col("amount").alias("budget")), "environment")
        .filter("budget > 0")
        .select(
            F.col("environment").alias("cost_center"),
            "budget",
            "actual",
            over.alias("variance"),
            F.round(share, 2).alias("variance_percentage"),
            F.when(share > 10, "over_budget").otherwise("within_budget").alias("status"),
        )
    )


@needs(COST, TAGS)
def tag_allocation(cur: DataFrame) -> DataFrame:
    """All cost by environment and team tag, where an environment is set."""
    return (
        cur.select(
            tag_value("Environment").alias("environment"), tag_value("Team").alias("team"), COST
        )
        .filter("environment IS NOT NULL")
        .groupBy("environment", "team")
        .agg(F.sum(COST).alias("allocated_cost"))
    )


@needs(RESOURCE, SERVICE, TAGS, START)
def tag_rule_impact(cur: DataFrame, rules: DataFrame, as_of: date) -> DataFrame:
    """Resources of the month that each rule (service, tag_key, tag_value) would change.

    A rule changes a resource of its service on which the key is missing or has
    another value.  Facts shrink to distinct (service, resource, tags) before
    they meet the rules.
    """
    entries = F.array_sort(F.map_entries(F.coalesce(TAGS, F.create_map().cast("map<string,string>"))))
    tagged = (
        cur.filter(in_month(as_of) & F.col(RESOURCE).isNotNull())
        .select(F.col(SERVICE).alias("service"), RESOURCE, entries.alias("entries"))
        .distinct()
    )
    wanted = F.col("tag_key")
    current = F.filter(
        "entries", lambda e: (e["key"] == wanted) | (e["key"] == F.concat(F.lit("user:"), wanted))
    )
    same = F.exists(current, lambda e: e["value"].eqNullSafe(F.col("tag_value")))
    hits = (
        tagged.join(rules, "service")
        .filter(~same)
        .groupBy("service", "tag_key", "tag_value")
        .agg(F.countDistinct(RESOURCE).alias("affected"))
    )
    keys = ["service", "tag_key", "tag_value"]
    return rules.join(hits, keys, "left").select(
        *keys, F.coalesce("affected", F.lit(0)).alias("affected_resources")
    )
