"""Spend totals, breakdowns and month-over-month change."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costspark.functions.dates import (
    START,
    day_of,
    in_month,
    in_range,
    month_of,
    month_start,
    shift_months,
    since_months,
)
from costspark.functions.filters import COST, base_filter, date_filter, positive_cost
from costspark.functions.needs import needs
from costspark.functions.ratios import cents, change_percent, percent, with_share
from costspark.functions.top import first_rows, in_order

SERVICE = "product_servicecode"
REGION = "product_region"
RESOURCE = "line_item_resource_id"
ACCOUNT = "line_item_usage_account_id"
PAYER = "bill_payer_account_id"
USAGE = "line_item_usage_amount"
PERIOD = "bill_billing_period_start_date"
USAGE_TYPE = "line_item_usage_type"

# Breakdown dimension -> billing column.
DIMENSIONS = {"region": REGION, "service": SERVICE}


def cost_sum(name: str) -> Column:
    return F.sum(COST).alias(name)


def monthly_cost(cur: DataFrame, *keys: str, cost: str = "monthly_cost") -> DataFrame:
    """Cost per month and ``keys``: the roll-up that the trend operators start from."""
    return cur.groupBy(month_of().alias("month"), *keys).agg(cost_sum(cost))


def by_keys_and_ids(cur: DataFrame, keys: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """Cost and line count per ``keys`` + ``ids``.

    Several distinct counts in one aggregate make Spark copy every input row
    once per count; on this roll-up the copies are of groups, not of facts, and
    the first shuffle is spread by id, so one heavy key does not fill one task.
    """
    return cur.groupBy(*dict.fromkeys([*keys, *ids])).agg(
        F.sum(COST).alias("cost"), F.count(F.lit(1)).alias("lines")
    )


@needs(START, COST)
def invoice_summary(
    cur: DataFrame, as_of: date, months_back: int = 12, calendar: bool = False
) -> DataFrame:
    """Monthly spend with change against the previous row and the row 12 back.

    The look-back counts rows, as the original does, so a missing month shifts
    it; ``calendar=True`` looks up the calendar month instead.  The windows run
    over one row per month of the look-back.
    """
    monthly = monthly_cost(
        cur.filter(positive_cost() & since_months(as_of, months_back)), cost="total_spend"
    )
    if calendar:
        index = F.year("month") * 12 + F.month("month")
        frame = Window.orderBy(index)
        before = lambda n: F.max("total_spend").over(frame.rangeBetween(-n, -n))
    else:
        before = lambda n: F.lag("total_spend", n).over(Window.orderBy("month"))
    return (
        monthly.withColumns({"before": before(1), "year_before": before(12)})
        .select(
            "month",
            "total_spend",
            change_percent("total_spend", "before").alias("mom_change"),
            change_percent("total_spend", "year_before").alias("yoy_change"),
        )
        .orderBy(F.desc("month"))
    )


def next_month_forecast(summary: DataFrame) -> DataFrame:
    """Latest month grown by its own change over the month before; one row.

    Input: month and total_spend, as ``invoice_summary`` gives.  Fewer than two
    months give 0 with confidence 0.
    """
    latest = F.max_by("total_spend", "month")
    pairs = summary.select(
        "month",
        "total_spend",
        F.lag("total_spend").over(Window.orderBy("month")).alias("before"),
    )
    one = pairs.agg(
        latest.alias("now"),
        F.max_by("before", "month").alias("before"),
        F.count(F.lit(1)).alias("months"),
    )
    change = F.when(F.col("before") > 0, F.try_divide(F.col("now") - F.col("before"), "before"))
    grown = cents(F.col("now") * (1 + F.coalesce(change, F.lit(0.0))))
    enough = F.col("months") >= 2
    return one.select(
        F.when(enough, grown).otherwise(F.lit(0.0)).alias("next_month"),
        F.when(enough, 75).otherwise(0).alias("confidence"),
    )


@needs(START, COST, REGION)
def top_regions(cur: DataFrame, as_of: date, limit: int | None = 10) -> DataFrame:
    """Regions of the month by spend, with share and change against last month.

    Both months come from one scan; share is of all spend, unnamed regions too.
    """
    this = month_start(as_of)
    both = cur.filter(positive_cost() & in_range(START, shift_months(this, -1), shift_months(this, 1)))
    groups = both.groupBy(REGION).agg(
        F.sum(F.when(F.col(START) >= F.lit(this), F.col(COST))).alias("spend"),
        F.sum(F.when(F.col(START) < F.lit(this), F.col(COST))).alias("before"),
    )
    return (
        with_share(groups.filter("spend IS NOT NULL"), "spend", "percentage")
        .filter(F.col(REGION).isNotNull())
        .select(
            F.col(REGION).alias("region_name"),
            "spend",
            "percentage",
            change_percent("spend", "before").alias("mom_change"),
        )
        .orderBy(F.desc("spend"), "region_name")
        .transform(first_rows, limit)
    )


@needs(START, COST, SERVICE, RESOURCE)
def top_services(cur: DataFrame, as_of: date, limit: int | None = 10) -> DataFrame:
    """Services of the month by spend, with share of all spend and resources used."""
    groups = (
        cur.filter(positive_cost() & in_month(as_of))
        .groupBy(F.col(SERVICE).alias("service_name"))
        .agg(cost_sum("spend"), F.countDistinct(RESOURCE).alias("resource_count"))
    )
    return (
        with_share(groups, "spend", "percentage")
        .filter("service_name IS NOT NULL")
        .select("service_name", "spend", "percentage", "resource_count")
        .orderBy(F.desc("spend"), "service_name")
        .transform(first_rows, limit)
    )


@needs(START, COST, SERVICE, REGION, RESOURCE)
def spend_breakdown(
    cur: DataFrame,
    as_of: date,
    dimensions: Sequence[str] = ("region", "service"),
    limit: int | None = 50,
    cube: bool = False,
) -> DataFrame:
    """Month spend by any of region and service; no dimension gives the total.

    ``cube=True`` adds the sub-totals over every subset of the dimensions.
    """
    names = [d for d in DIMENSIONS if d in dimensions]
    month = cur.filter(positive_cost() & in_month(as_of))
    keys = [F.col(DIMENSIONS[d]).alias(d) for d in names]
    measures = (cost_sum("spend"), F.countDistinct(RESOURCE).alias("resource_count"))
    if not keys:
        return month.agg(*measures).select(F.lit("All").alias("dimension"), "spend", "resource_count")
    grouped = month.cube(*keys) if cube else month.groupBy(*keys)
    return grouped.agg(*measures).orderBy(F.desc("spend"), *names).transform(first_rows, limit)


@needs(START, COST, SERVICE, REGION, RESOURCE)
def spend_extract(
    cur: DataFrame,
    start: date | datetime | None = None,
    end: date | datetime | None = None,
    limit: int | None = 10000,
) -> DataFrame:
    """The newest ``limit`` priced line items, five columns, dates inclusive.

    A sort with a large limit keeps ``limit`` rows per task and merges them in
    one.  Counting rows per day first tells from which day on the newest
    ``limit`` rows must lie; only those days are read and sorted.  Without a
    limit all lines come back unsorted.
    """
    kept = cur.filter(positive_cost() & date_filter(start, end))
    if limit is None:
        return kept.select(START, SERVICE, REGION, COST, RESOURCE)
    newer = Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, 0)
    days = kept.groupBy(day_of().alias("day")).agg(F.count("*").alias("n"))
    totals = days.select("day", F.sum("n").over(newer).alias("total"))
    enough = F.max(F.when(F.col("total") >= limit, F.col("day")))
    first_day = totals.agg(F.coalesce(enough, F.min("day"))).scalar()
    return (
        kept.filter(F.col(START) >= first_day)
        .select(START, SERVICE, REGION, COST, RESOURCE)
        .orderBy(F.desc(START), F.desc(COST), SERVICE, REGION, RESOURCE)
        .transform(first_rows, limit)
    )


@needs(START, COST, RESOURCE)
def monthly_aggregation(cur: DataFrame, by: Sequence[str] = (), where: Column | None = None) -> DataFrame:
    """Month x extra dimensions: cost and distinct resources."""
    rows = cur.filter(positive_cost() if where is None else positive_cost() & where)
    return (
        rows.groupBy(month_of().alias("billing_month"), *by)
        .agg(cost_sum("total_cost"), F.countDistinct(RESOURCE).alias("resource_count"))
        .orderBy(F.desc("billing_month"), F.desc("total_cost"))
    )


@needs(START, COST, SERVICE, RESOURCE)
def service_summary(cur: DataFrame, billing_period: str | None = None, limit: int | None = 20) -> DataFrame:
    return (
        cur.filter(base_filter(billing_period=billing_period))
        .groupBy(F.col(SERVICE).alias("service"))
        .agg(
            cost_sum("total_cost"),
            F.countDistinct(RESOURCE).alias("resource_count"),
            F.count(F.lit(1)).alias("line_item_count"),
            F.avg(COST).alias("avg_cost_per_line_item"),
        )
        .orderBy(F.desc("total_cost"), "service")
        .transform(first_rows, limit)
    )


@needs(START, COST, SERVICE, RESOURCE, ACCOUNT, PAYER)
def account_summary(
    cur: DataFrame, billing_period: str | None = None, ordered: bool = True
) -> DataFrame:
    """Per account and payer: cost, distinct services, distinct resources.

    Facts shrink to one row per resource and service, in a shuffle that one heavy account does
    not fill a task of; what is counted distinct per account are those rows.
    """
    rows = cur.filter(base_filter(billing_period=billing_period))
    return (
        rows.groupBy(ACCOUNT, PAYER, RESOURCE, SERVICE)
        .agg(F.sum(COST).alias("cost"))
        .groupBy(F.col(ACCOUNT).alias("account_id"), F.col(PAYER).alias("payer_account_id"))
        .agg(
            F.sum("cost").alias("total_cost"),
            F.countDistinct(SERVICE).alias("service_count"),
            F.countDistinct(RESOURCE).alias("resource_count"),
        )
        .transform(in_order, ordered, F.desc("total_cost"), "account_id", "payer_account_id")
    )


@needs(START, COST, SERVICE)
def cost_trend(
    cur: DataFrame, as_of: date, service: str | None = None, months_back: int = 6
) -> DataFrame:
    """Monthly cost per service with the month before and the change in percent."""
    rows = cur.filter(positive_cost() & since_months(as_of, months_back))
    if service:
        rows = rows.filter(F.col(SERVICE) == service)
    before = F.lag("monthly_cost").over(Window.partitionBy(SERVICE).orderBy("month"))
    now, prior = F.col("monthly_cost"), F.col("previous_month_cost")
    out = (
        monthly_cost(rows, SERVICE)
        .withColumn("previous_month_cost", before)
        .withColumn("month_over_month_change_pct", F.try_divide(now - prior, prior) * 100)
    )
    return out.drop(SERVICE).orderBy(F.desc("month")) if service else out.select(
        "month", SERVICE, "monthly_cost", "previous_month_cost", "month_over_month_change_pct"
    ).orderBy(SERVICE, F.desc("month"))


@needs(COST, SERVICE, START, ACCOUNT)
def overall_totals(cur: DataFrame) -> DataFrame:
    """One row over the whole table.

    The distinct counts copy rows of (service, start, account), not facts.
    """
    groups = cur.groupBy(SERVICE, START, ACCOUNT).agg(
        F.sum(COST).alias("cost"), F.count(COST).alias("priced"), F.count(F.lit(1)).alias("lines")
    )
    return groups.agg(
        F.sum("lines").alias("total_line_items"),
        F.sum("cost").alias("total_cost"),
        F.countDistinct(SERVICE).alias("unique_services"),
        F.countDistinct(START).alias("unique_days"),
        F.countDistinct(ACCOUNT).alias("unique_accounts"),
        F.try_divide(F.sum("cost"), F.sum("priced")).alias("avg_line_item_cost"),
        F.min(START).alias("earliest_date"),
        F.max(START).alias("latest_date"),
    )


@needs(COST, SERVICE, START)
def daily_costs(cur: DataFrame, limit: int | None = 30) -> DataFrame:
    """The first ``limit`` usage dates: cost, lines, distinct services."""
    return (
        cur.groupBy(F.col(START).alias("date"))
        .agg(
            cost_sum("daily_cost"),
            F.count(F.lit(1)).alias("line_items"),
            F.countDistinct(SERVICE).alias("unique_services"),
        )
        .orderBy("date")
        .transform(first_rows, limit)
    )


@needs(COST, PERIOD, ACCOUNT)
def billing_period_summary(cur: DataFrame) -> DataFrame:
    return (
        cur.groupBy(F.col(PERIOD).alias("billing_period"))
        .agg(
            cost_sum("monthly_cost"),
            F.countDistinct(ACCOUNT).alias("unique_accounts"),
            F.count(F.lit(1)).alias("total_line_items"),
        )
        .orderBy("billing_period")
    )


@needs(COST, REGION, SERVICE)
def region_service_usage(cur: DataFrame, limit: int | None = 10) -> DataFrame:
    return (
        cur.filter(positive_cost() & F.col(REGION).isNotNull() & (F.col(REGION) != ""))
        .groupBy(F.col(REGION).alias("region"), SERVICE)
        .agg(cost_sum("cost"), F.count(F.lit(1)).alias("usage_records"))
        .orderBy(F.desc("cost"), "region", SERVICE)
        .transform(first_rows, limit)
    )


@needs(COST, PERIOD, SERVICE)
def billing_period_trend(cur: DataFrame, limit: int | None = 20) -> DataFrame:
    """Cost per billing period and service against the service's period before."""
    before = F.lag("current_cost").over(Window.partitionBy(SERVICE).orderBy("billing_period"))
    out = (
        cur.filter(positive_cost())
        .groupBy(F.col(PERIOD).alias("billing_period"), SERVICE)
        .agg(cost_sum("current_cost"))
        .withColumn("previous_cost", before)
        .withColumn(
            "cost_change_percent",
            percent(F.col("current_cost") - F.col("previous_cost"), "previous_cost"),
        )
        .orderBy("billing_period", F.desc("current_cost"), SERVICE)
    )
    return first_rows(out, limit)


@needs(COST, ACCOUNT)
def account_distribution(cur: DataFrame, ordered: bool = True) -> DataFrame:
    """Each account's share of all cost and its rank.

    Accounts may be many, so neither the total nor the rank passes them through
    one task: the total is a scalar subquery and the rank is counted per value
    band (see ``rank_by_value``).  Costs add up as decimals here because the
    rank looks values up again: a double sum can differ in its last bit when
    the rows arrive in another order, a decimal sum cannot.
    """
    exact = F.sum(F.col(COST).cast("decimal(38,20)")).alias("exact_cost")
    costs = cur.filter(positive_cost()).groupBy(ACCOUNT).agg(exact)
    total = costs.agg(F.sum("exact_cost").cast("double")).scalar()
    cost = F.col("exact_cost").cast("double")
    return (
        rank_by_value(costs, "exact_cost", "cost_rank")
        .select(
            ACCOUNT,
            cost.alias("total_cost"),
            percent(cost, total).alias("cost_percentage"),
            "cost_rank",
        )
        .transform(in_order, ordered, "cost_rank", ACCOUNT)
    )


def rank_by_value(
    df: DataFrame, value: str, name: str, bands_per_doubling: int = 64, steps: int = 1024
) -> DataFrame:
    """``RANK() OVER (ORDER BY value DESC)`` of decimals from 0 on without one big sort.

    Equal values are counted first, so a value that many rows share is one row.
    Values fall into bands by their logarithm (about 1 % wide) and into ``steps``
    equal parts of a band, so that flat fees with small differences spread too; a
    part's rows rank inside it and add the number of rows in higher parts and
    bands.  The number of bands depends on the spread of the values, not on the
    number of rows.  0 has a band of its own below all others; a NULL has no rank.
    """
    number = F.col(value).cast("double")
    band = F.when(number > 0, F.floor(F.log2(number) * bands_per_doubling)).otherwise(F.lit(-(10**9)))
    low = F.pow(F.lit(2.0), F.col("band") / bands_per_doubling)
    width = low * (2 ** (1 / bands_per_doubling) - 1)
    part = F.when(number > 0, F.floor((number - low) / width * steps)).otherwise(F.lit(0))
    values = (
        df.filter(F.col(value).isNotNull())
        .groupBy(value)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("band", band)
        .withColumn("part", part)
    )
    parts = values.groupBy("band", "part").agg(F.sum("n").alias("part_rows"))
    bands = parts.groupBy("band").agg(F.sum("part_rows").alias("band_rows"))
    higher = bands.select(
        "band", _rows_before(Window.orderBy(F.desc("band")), "band_rows").alias("higher_bands")
    )
    beside = Window.partitionBy("band").orderBy(F.desc("part"))
    above = parts.select("band", "part", _rows_before(beside, "part_rows").alias("higher_parts"))
    inside = _rows_before(Window.partitionBy("band", "part").orderBy(F.desc(value)), "n")
    before = F.col("higher_bands") + F.col("higher_parts") + F.col("inside")
    ranks = (
        values.withColumn("inside", inside)
        .join(above, ["band", "part"])
        .join(higher, "band")
        .select(value, (before + 1).alias(name))
    )
    return df.join(ranks, value, "left")


def _rows_before(window, count: str) -> Column:
    frame = window.rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(count).over(frame), F.lit(0))


@needs("bill_invoice_id", USAGE)
def invoice_usage(cur: DataFrame, limit: int | None = None) -> DataFrame:
    """Usage per invoice, added up as decimal(18,2)."""
    out = cur.groupBy("bill_invoice_id").agg(
        F.sum(F.col(USAGE).cast("decimal(18,2)")).cast("decimal(38,2)").alias("total_usage_amount")
    )
    return out if limit is None else out.orderBy("bill_invoice_id").limit(limit)


@needs(START, COST, "line_item_net_unblended_cost", SERVICE)
def monthly_gross_net(cur: DataFrame, since: date) -> DataFrame:
    return (
        cur.filter(F.col(START) >= F.lit(since))
        .groupBy(month_of().alias("month"))
        .agg(
            cost_sum("monthly_cost"),
            F.sum("line_item_net_unblended_cost").alias("net_cost"),
            F.countDistinct(SERVICE).alias("services_used"),
        )
        .orderBy("month")
    )


@needs(START, COST)
def monthly_cost_text(cur: DataFrame, as_of: date, months_back: int = 12) -> DataFrame:
    """Month as ``yyyy-MM`` text with cost to two places."""
    return (
        monthly_cost(cur.filter(since_months(as_of, months_back)))
        .select(
            F.date_format("month", "yyyy-MM").alias("month"),
            cents("monthly_cost").alias("cost"),
        )
        .orderBy("month")
    )


@needs(START, COST, SERVICE)
def service_growth(
    cur: DataFrame, as_of: date, months_back: int = 6, min_cost: float = 100.0
) -> DataFrame:
    """Last full month per service against the month before it."""
    before = F.lag("monthly_cost").over(Window.partitionBy(SERVICE).orderBy("month"))
    target = month_start(shift_months(as_of, -1))
    return (
        monthly_cost(cur.filter(since_months(as_of, months_back)), SERVICE)
        .withColumn("prev_month_cost", before)
        .filter((F.col("month") == F.lit(target)) & (F.col("monthly_cost") > min_cost))
        .select(
            SERVICE,
            F.col("monthly_cost").alias("current_cost"),
            "prev_month_cost",
            change_percent("monthly_cost", "prev_month_cost").alias("growth_percentage"),
        )
        .orderBy(F.desc_nulls_last("growth_percentage"), SERVICE)
    )
