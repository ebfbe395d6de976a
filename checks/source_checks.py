"""Exports read, listed and copied; sinks; SQL; catalogue; quality."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.base import AS_OF, cur, register
from costspark import schemas
from costspark.functions.ratios import clean_floats
from costspark.normalize import normalize_cur
from costspark.operators import allocate, enrich, quality, spend
from costspark.plans import dashboard, views
from costspark.plans.billing_view import COLUMNS, billing_view, table
from costspark.runtime import materialise, scratch_path
from costspark.sources import exports, sinks

SLIM = (
    "bill_invoice_id", "line_item_usage_account_id", "line_item_usage_start_date", "line_item_usage_amount",
    "line_item_unblended_cost", "line_item_resource_id", "product_servicecode",
)


def _periods(s, d, *columns):
    month = F.date_format("line_item_usage_start_date", "yyyy-MM")
    return cur(s, d, *(columns or SLIM)).withColumn("BILLING_PERIOD", month)


def _joined(s, d):
    """The periods' rows joined once and kept as a table, for exports that are written part by part."""
    return materialise(_periods(s, d), scratch_path(s, "joined"))


def _export(s, d):
    """The billing view written once as a partitioned export."""
    path = scratch_path(s, "export")
    df = exports.write_export(_periods(s, d), path)
    return path, df.schema


def _by_period(df, column="BILLING_PERIOD"):
    return df.groupBy(F.col(column).alias("period")).agg(
        F.count("*").alias("lines"), F.sum("line_item_unblended_cost").alias("cost")
    )


BY_PERIOD = """
    SELECT strftime(month, '%Y-%m') AS period, count(*) AS lines, round(sum(cost), 2) AS cost
    FROM cur {where} GROUP BY 1
"""


def _read_range(s, d):
    path, _ = _export(s, d)
    return _by_period(exports.read_export(s, path, date_start="2000-03", date_end="2001-02"))


register(
    "read_export_range",
    _read_range,
    BY_PERIOD.format(where="WHERE month BETWEEN DATE '2000-03-01' AND DATE '2001-02-01'"),
)


def _read_gzip(s, d):
    path = scratch_path(s, "gzip")
    sinks.flat(_periods(s, d)).write.partitionBy("BILLING_PERIOD").csv(
        path, header=True, compression="gzip"
    )
    schema = T.StructType([f for f in _periods(s, d).schema.fields if f.name != "BILLING_PERIOD"])
    return _by_period(exports.read_export(s, path, schema=schema, file_format="auto", date_start="2001-01"))


register("read_gzip_export", _read_gzip, BY_PERIOD.format(where="WHERE month >= DATE '2001-01-01'"))


def _read_daily(s, d):
    day = F.date_format("line_item_usage_start_date", "yyyy-MM-dd")
    bad = F.col("line_item_resource_id").isNull()
    rows = cur(s, d, *SLIM).withColumn("date", F.when(bad, "undated").otherwise(day))
    return _by_period(rows.filter(exports.period_filter("COH", "2001-10-05", "2001-10-20")), "date")


register(
    "partition_filter_daily",
    _read_daily,
    """
    SELECT strftime(ts, '%Y-%m-%d') AS period, count(*) AS lines, round(sum(cost), 2) AS cost FROM cur
    WHERE ts BETWEEN DATE '2001-10-05' AND DATE '2001-10-20' AND resource IS NOT NULL GROUP BY 1
    """,
)


def _partitions(s, d):
    path, _ = _export(s, d)
    return exports.list_partitions(exports.export_files(s, path))


register(
    "list_partitions",
    _partitions,
    "SELECT DISTINCT 'BILLING_PERIOD=' || strftime(month, '%Y-%m') AS partition FROM cur",
)


def _inventory(s, d):
    """Each period written as one file for each invoice number modulo 3."""
    path = scratch_path(s, "inventory")
    third = F.pmod(F.col("bill_invoice_id").cast("long"), F.lit(3))
    for k in range(3):
        rows = _periods(s, d).filter(third == k).repartition(4, "BILLING_PERIOD")
        rows.write.mode("append").partitionBy("BILLING_PERIOD").parquet(path)
    return exports.partition_inventory(exports.export_files(s, path)).select("partition", "files")


register(
    "partition_inventory",
    _inventory,
    """
    SELECT strftime(month, '%Y-%m') AS partition, count(DISTINCT CAST(invoice AS BIGINT) % 3) AS files
    FROM cur GROUP BY 1
    """,
)


def _copied(s, d):
    """Copy one range, add gzip files to every period and a NULL period, copy twice: every row is there once."""
    path, target = scratch_path(s, "grown"), scratch_path(s, "copy")
    service = F.col("product_servicecode")
    athena, lambda_ = service == "AmazonAthena", service == "AWSLambda"
    every = _joined(s, d)
    every.filter(~athena & ~lambda_).write.partitionBy("BILLING_PERIOD").parquet(path)
    exports.materialise_export(s, path, target, every.schema, date_end="1999-01")
    late = every.filter(athena | lambda_).withColumn(
        "BILLING_PERIOD", F.when(~lambda_, F.col("BILLING_PERIOD"))
    )
    flat = sinks.flat(late).write.mode("append").partitionBy("BILLING_PERIOD")
    flat.csv(path, header=True, compression="gzip")
    exports.materialise_export(s, path, target, every.schema)
    return _by_period(exports.materialise_export(s, path, target, every.schema))


register(
    "materialise_export_new_files",
    _copied,
    """
    SELECT CASE WHEN service <> 'AWSLambda' THEN strftime(month, '%Y-%m') END AS period,
           count(*) AS lines, round(sum(cost), 2) AS cost
    FROM cur GROUP BY 1
    """,
)


def _streamed(s, d):
    """Parquet files of some services, then gzip files in another order of columns; copied as they come, and once more."""
    path, target = scratch_path(s, "arriving"), scratch_path(s, "arrived")
    every = _joined(s, d)
    early = F.coalesce(F.col("product_servicecode") < "AmazonR", F.lit(False))
    every.filter(early).write.partitionBy("BILLING_PERIOD").parquet(path)
    exports.stream_export(s, path, target, every.schema)
    late = sinks.flat(every.filter(~early)).select(*every.columns[::-1]).write.mode("append").partitionBy("BILLING_PERIOD")
    late.csv(path, header=True, compression="gzip")
    exports.stream_export(s, path, target, every.schema)
    return _by_period(exports.stream_export(s, path, target, every.schema))


register("stream_export_new_files", _streamed, BY_PERIOD.format(where=""))


def _read_mixed(s, d):
    """A folder with Parquet files of some periods and gzip files of the others."""
    path = scratch_path(s, "mixed")
    rows = _periods(s, d)
    early = F.col("BILLING_PERIOD") < "1999-01"
    rows.filter(early).write.partitionBy("BILLING_PERIOD").parquet(path)
    flat = sinks.flat(rows.filter(~early)).write.mode("append").partitionBy("BILLING_PERIOD")
    flat.csv(path, header=True, compression="gzip")
    return _by_period(exports.read_export(s, path, schema=rows.schema, file_format="auto"))


register("read_mixed_export", _read_mixed, BY_PERIOD.format(where=""))


def _moving(s, d):
    """The billing view in three layouts: as it is; turned round, without resources; with a new column, cost as text."""
    rows = _joined(s, d)
    names = [c for c in SLIM if c != "line_item_resource_id"]
    first = rows.filter("BILLING_PERIOD < '1996-01'")
    second = rows.filter("BILLING_PERIOD >= '1996-01' AND BILLING_PERIOD < '1999-01'").select(*names[::-1], "BILLING_PERIOD")
    third = rows.filter("BILLING_PERIOD >= '1999-01'").withColumn("line_item_unblended_cost", F.col("line_item_unblended_cost").cast("string"))
    third = third.select(F.lit("new").alias("line_item_extra"), *[c for c in third.columns[::-1]])
    return rows.schema, (first, second, third)


def _by_place(df):
    return df.groupBy(F.col("BILLING_PERIOD").alias("period"), F.col("product_servicecode").alias("service")).agg(
        F.count("*").alias("lines"),
        F.count("line_item_resource_id").alias("resources"),
        F.sum("line_item_unblended_cost").alias("cost"),
        F.sum("line_item_usage_amount").alias("usage"),
    )


def _moved_gzip(s, d):
    """Gzip files of three layouts, copied twice: columns are found by name."""
    path, target = scratch_path(s, "moved"), scratch_path(s, "moved-copy")
    schema, parts = _moving(s, d)
    for part in parts:
        sinks.flat(part).write.mode("append").partitionBy("BILLING_PERIOD").csv(path, header=True, compression="gzip")
    exports.materialise_export(s, path, target, schema)
    return _by_place(exports.materialise_export(s, path, target, schema))


def _moved_parquet(s, d):
    """Parquet files of three layouts, one of which has another type."""
    path = scratch_path(s, "layouts")
    schema, parts = _moving(s, d)
    for part in parts:
        part.write.mode("append").partitionBy("BILLING_PERIOD").parquet(path)
    return _by_place(exports.read_layouts(s, path, schema))


BY_PLACE = """
    SELECT strftime(month, '%Y-%m') AS period, service, count(*) AS lines,
           count(resource) FILTER (WHERE month < DATE '1996-01-01' OR month >= DATE '1999-01-01') AS resources,
           round(sum(cost), 2) AS cost, round(sum(usage), 2) AS usage
    FROM cur GROUP BY 1, 2
"""
register("copy_gzip_moved_columns", _moved_gzip, BY_PLACE)
register("read_parquet_layouts", _moved_parquet, BY_PLACE)
register(
    "adhoc_parquet_query",
    lambda s, d: exports.query_files(
        s,
        f"""SELECT l_returnflag, count(*) AS lines, sum(l_extendedprice) AS total
            FROM parquet.`{d}/lineitem.parquet` WHERE l_discount >= :least GROUP BY l_returnflag""",
        args={"least": 0.05},
    ),
    """--plain
    SELECT l_returnflag, count(*) AS lines, round(sum(l_extendedprice), 2) AS total
    FROM lineitem WHERE l_discount >= 0.05 GROUP BY l_returnflag
    """,
)


def _sql_file(s, d):
    path = scratch_path(s, "sql") + ".sql"
    text = """SELECT product_servicecode AS service, count(*) AS lines, sum(line_item_unblended_cost) AS cost
              FROM CUR WHERE line_item_unblended_cost > 1000 GROUP BY 1;"""
    s.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return exports.query_files(s, path, {"CUR": cur(s, d, *SLIM)})


register(
    "sql_file_query",
    _sql_file,
    "SELECT service, count(*) AS lines, round(sum(cost), 2) AS cost FROM cur WHERE cost > 1000 GROUP BY service",
)


def _alias(s, d):
    exports.alias_table(cur(s, d, *SLIM), "billing_alias")
    return s.sql("SELECT product_servicecode AS service, count(*) AS lines FROM billing_alias GROUP BY 1")


register("table_alias", _alias, "SELECT service, count(*) AS lines FROM cur GROUP BY service")


def _written(writer, reader):
    def run(s, d):
        path = scratch_path(s, "sink")
        df = spend.monthly_aggregation(
            cur(s, d, spend.monthly_aggregation, "product_servicecode"), ["product_servicecode"]
        )
        writer(df, path)
        return reader(s.read.schema(df.schema), path)

    return run


MONTHLY = """
    SELECT month AS billing_month, service AS product_servicecode, round(sum(cost), 2) AS total_cost,
           count(DISTINCT resource) AS resource_count FROM cur WHERE cost > 0 GROUP BY month, service
"""
register("write_csv", _written(sinks.write_csv, lambda r, p: r.csv(p, header=True)), MONTHLY)
register("write_json", _written(sinks.write_json, lambda r, p: r.json(p)), MONTHLY)


def _reference_tables(s, d):
    path = scratch_path(s, "dims")
    names = ("supplier", "customer", "part")
    sinks.write_reference_tables({n: table(s, d, n) for n in names}, path)
    counts = []
    for n in names:
        rows = s.read.parquet(f"{path}/{n}.parquet").agg(F.count("*").alias("parquet_rows"))
        text = s.read.csv(f"{path}/{n}.csv", header=True).agg(F.count("*")).scalar()
        counts.append(rows.select(F.lit(n).alias("table_name"), "parquet_rows", text.alias("csv_rows")))
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


register(
    "write_reference_tables",
    _reference_tables,
    """--plain
    SELECT 'supplier' AS table_name, count(*) AS parquet_rows, count(*) AS csv_rows FROM supplier UNION ALL
    SELECT 'customer', count(*), count(*) FROM customer UNION ALL
    SELECT 'part', count(*), count(*) FROM part
    """,
)


def _views(s, d):
    base = cur(s, d, *SLIM)
    layers = [
        {
            "account_map": lambda spark: table(spark, d, "customer").selectExpr(
                "lpad(CAST(c_custkey AS string), 12, '0') AS account_id", "c_name AS account_name"
            ),
            "summary_view": lambda spark: base.selectExpr(
                "line_item_usage_account_id AS linked_account_id", "line_item_unblended_cost AS unblended_cost",
                "line_item_usage_amount AS usage_quantity",
            ),
        },
        {
            "account_costs": """SELECT linked_account_id, sum(unblended_cost) AS cost, count(*) AS lines
                                FROM summary_view GROUP BY 1""",
        },
        {
            "account_report": """SELECT account_id, account_name, cost, lines FROM account_map
                                 JOIN account_costs ON linked_account_id = account_id""",
        },
    ]
    return views.build_views(s, layers, scratch_path(s, "views"))["account_report"]


register(
    "view_layers",
    _views,
    """
    SELECT account AS account_id, 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS account_name,
           round(sum(cost), 2) AS cost, count(*) AS lines FROM cur GROUP BY 1, 2
    """,
)


def _views_in_any_order(s, d):
    """The reports first, what they read after them: joins, a subquery and a WITH part tell the order."""
    base = cur(s, d, *SLIM)
    unordered = {
        "heavy_report": """WITH mean AS (SELECT avg(cost) AS c FROM ordered_costs)
            SELECT account, cost, lines FROM ordered_costs WHERE cost > (SELECT c FROM mean) AND account IN (SELECT account FROM used)""",
        "ordered_costs": "SELECT account, sum(cost) AS cost, count(*) AS lines FROM ordered_lines GROUP BY account",
        "used": "SELECT account FROM ordered_lines GROUP BY account HAVING sum(usage) > 1000",
        "ordered_lines": lambda spark: base.selectExpr(
            "line_item_usage_account_id AS account", "line_item_unblended_cost AS cost", "line_item_usage_amount AS usage"
        ),
    }
    return views.build_views(s, unordered, scratch_path(s, "ordered-views"))["heavy_report"]


register(
    "views_in_any_order",
    _views_in_any_order,
    """
    WITH g AS (SELECT account, sum(cost) AS cost, count(*) AS lines, sum(usage) AS u FROM cur GROUP BY account)
    SELECT account, round(cost, 2) AS cost, lines FROM g WHERE cost > (SELECT avg(cost) FROM g) AND u > 1000
    """,
)


def _dashboard(s, d):
    wanted = [c for c in dashboard.dashboard_columns() if c in COLUMNS]
    patterns = (("DiscountedUsage", "Reserved Instance"), ("SavingsPlan", "Savings Plan"))
    tables = dashboard.run_dashboard(
        billing_view(s, d, *wanted), AS_OF, scratch_path(s, "dashboard"),
        discount_agreements={"patterns": patterns},
    )
    return dashboard.dashboard_overview(tables)


register(
    "dashboard",
    _dashboard,
    """
    WITH m AS (SELECT * FROM cur WHERE ts >= DATE '2001-10-01' AND ts < DATE '2001-11-01' AND cost > 0)
    SELECT 'kpi_summary' AS component, CAST(1 AS BIGINT) AS rows UNION ALL
    SELECT 'spend_summary', count(DISTINCT month) FROM cur WHERE ts >= DATE '2001-10-31' - INTERVAL 12 MONTH UNION ALL
    SELECT 'top_services', least(10, count(DISTINCT service)) FROM m UNION ALL
    SELECT 'top_regions', least(10, count(DISTINCT region)) FROM m UNION ALL
    SELECT 'optimization_opportunities', least(50, count(*)) FROM (
        SELECT 1 FROM m WHERE service IN ('AmazonEC2', 'AmazonRDS', 'ElasticLoadBalancing')
        GROUP BY resource, service, itype HAVING avg(CASE WHEN usage > 0 THEN usage ELSE 0 END) < 10) UNION ALL
    SELECT 'tagging_compliance', count(*) FROM (
        SELECT DISTINCT service, CASE WHEN coalesce(env, team, project, owner) IS NULL THEN 1
            WHEN env IS NOT NULL AND team IS NOT NULL THEN 2 WHEN env IS NOT NULL OR team IS NOT NULL THEN 3
            ELSE 4 END FROM m WHERE resource IS NOT NULL) UNION ALL
    SELECT 'discount_agreements', count(*) FROM (
        SELECT DISTINCT service, kind FROM m WHERE kind IN ('DiscountedUsage', 'SavingsPlanCoveredUsage')) UNION ALL
    SELECT 'ai_insights', count(*) FROM (
        SELECT service FROM (SELECT service, month, sum(cost) AS c FROM cur
                             WHERE ts >= DATE '2001-10-31' - INTERVAL 6 MONTH GROUP BY 1, 2)
        GROUP BY service HAVING count(*) >= 3 AND avg(c) > 1000)
    """,
)

# Cleaning, normalising, catalogue, quality.


def _dirty(s, d):
    rows = table(s, d, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber",
        """CASE WHEN l_linenumber = 1 THEN double('NaN') WHEN l_linenumber = 2 THEN double('Infinity')
           WHEN l_linenumber = 3 THEN double('-Infinity') ELSE l_quantity END AS quantity""",
    )
    return clean_floats(rows).groupBy("l_linenumber").agg(
        F.count("*").alias("lines"), F.count("quantity").alias("kept"), F.sum("quantity").alias("total")
    )


register(
    "clean_floats",
    _dirty,
    """--plain
    SELECT l_linenumber, count(*) AS lines, count(CASE WHEN l_linenumber > 3 THEN 1 END) AS kept,
           sum(CASE WHEN l_linenumber > 3 THEN l_quantity END) AS total
    FROM lineitem GROUP BY l_linenumber
    """,
)


def _normalised(s, d):
    raw = cur(s, d, "line_item_usage_account_id", "bill_payer_account_id", "product_region",
              "line_item_unblended_cost", "resource_tags").select(
        F.col("line_item_usage_account_id").alias("linked_account_id"),
        F.col("bill_payer_account_id").alias("payer_account_id"),
        F.col("product_region").alias("product_region_code"),
        F.col("line_item_unblended_cost").alias("unblended_cost"),
        F.to_json("resource_tags").alias("resource_tags"),
    )
    return normalize_cur(raw).groupBy(
        "bill_payer_account_id", "product_region", allocate.tagging_status().alias("status")
    ).agg(F.sum("line_item_unblended_cost").alias("cost"))


register(
    "normalize_cur",
    _normalised,
    """
    SELECT payer AS bill_payer_account_id, region AS product_region,
           CASE WHEN coalesce(env, team, project, owner) IS NULL THEN 'untagged'
                WHEN env IS NOT NULL AND team IS NOT NULL THEN 'fully_tagged'
                WHEN env IS NOT NULL OR team IS NOT NULL THEN 'partially_tagged' ELSE 'custom_tagged' END AS status,
           round(sum(cost), 2) AS cost
    FROM cur GROUP BY 1, 2, 3
    """,
)
register(
    "sample_rows",
    lambda s, d: exports.sample(cur(s, d, *SLIM), 100, SLIM),
    """
    SELECT invoice AS bill_invoice_id, account AS line_item_usage_account_id, ts AS line_item_usage_start_date,
           usage AS line_item_usage_amount, round(cost, 2) AS line_item_unblended_cost,
           resource AS line_item_resource_id, service AS product_servicecode
    FROM cur ORDER BY invoice, account, ts, usage NULLS FIRST, cost, resource NULLS FIRST, service LIMIT 100
    """,
)
register(
    "capped_rows",
    lambda s, d: exports.cap_rows(
        cur(s, d, "product_servicecode", "line_item_unblended_cost").groupBy("product_servicecode")
        .agg(F.sum("line_item_unblended_cost").alias("cost")).orderBy(F.desc("cost")), 2
    ),
    "SELECT service AS product_servicecode, round(sum(cost), 2) AS cost FROM cur GROUP BY 1 ORDER BY 2 DESC LIMIT 2",
)
register(
    "table_overview",
    lambda s, d: exports.table_overview(
        cur(s, d, *SLIM), "line_item_usage_start_date", ["product_servicecode"]
    ),
    """
    SELECT count(*) AS record_count, min(ts) AS earliest_date, max(ts) AS latest_date,
           count(DISTINCT service) AS distinct_product_servicecode FROM cur
    """,
)


GROUPED = {
    "bill_payer_account_id": "payer", "bill_invoice_id": "invoice", "line_item_usage_account_id": "account",
    "line_item_usage_amount": "usage", "line_item_unblended_cost": "cost", "line_item_resource_id": "resource",
    "product_servicecode": "service", "product_region": "region", "pricing_term": "term",
    "reservation_reservation_a_r_n": "ri_arn", "savings_plan_savings_plan_a_r_n": "sp_arn",
}


def _group_fill(s, d):
    """Values that each group of billing columns holds."""
    counts = schemas.filled(cur(s, d, *GROUPED), list(GROUPED))
    return schemas.column_groups(s).join(counts, "name").groupBy("category").agg(
        F.count("*").alias("columns"), F.sum("filled_rows").alias("filled_values")
    )


register(
    "column_groups",
    _group_fill,
    """
    SELECT 'Bill' AS category, CAST(2 AS BIGINT) AS columns, count(payer) + count(invoice) AS filled_values FROM cur UNION ALL
    SELECT 'Line item', 4, count(account) + count(usage) + count(cost) + count(resource) FROM cur UNION ALL
    SELECT 'Product', 2, count(service) + count(region) FROM cur UNION ALL
    SELECT 'Pricing', 1, count(term) FROM cur UNION ALL
    SELECT 'Reservation', 1, count(ri_arn) FROM cur UNION ALL
    SELECT 'Savings plan', 1, count(sp_arn) FROM cur
    """,
)
def _doubled(s, d):
    """The billing view with the rows of one service twice."""
    return cur(s, d, *SLIM).unionByName(cur(s, d, *SLIM).filter("product_servicecode = 'AmazonS3'"))


def _observed(s, d):
    """The same report, counted while the rows are copied."""
    rows, seen = quality.observe_quality(_doubled(s, d))
    copy = materialise(rows, scratch_path(s, "observed"))
    return quality.observed_report(seen, copy, AS_OF)


QUALITY = """
    WITH t AS (SELECT *, 1 AS copy FROM cur UNION ALL SELECT *, 2 FROM cur WHERE service = 'AmazonS3'),
         n AS (SELECT count(*) AS total, count(*) - (SELECT count(*) FROM (SELECT DISTINCT invoice, account, ts,
                   usage, cost, resource, service FROM t)) AS dup FROM t)
    SELECT total AS total_rows, 7 AS total_columns, CAST(0 AS BIGINT) AS negative_costs,
           0.0::DOUBLE AS null_pct_line_item_unblended_cost, 0.0::DOUBLE AS null_pct_product_servicecode,
           -4 AS days_old, dup AS duplicate_rows, '' AS issues,
           'Found ' || CAST(dup AS VARCHAR) || ' duplicate rows (' || printf('%.1f', dup * 100.0 / total) || '%)'
               AS warnings,
           true AS valid, 95.0::DOUBLE AS data_quality_score
    FROM n
    """
register("quality_report", lambda s, d: quality.quality_report(_doubled(s, d), AS_OF), QUALITY)
register("quality_report_while_copying", _observed, QUALITY)


def _periods_checked(s, d):
    odd = F.col("product_servicecode") == "AmazonAthena"
    rows = _periods(s, d).withColumn(
        "BILLING_PERIOD", F.when(odd, F.concat("BILLING_PERIOD", F.lit("-01"))).otherwise(F.col("BILLING_PERIOD"))
    )
    return quality.check_periods(rows, "BILLING_PERIOD")


register(
    "check_periods",
    _periods_checked,
    """
    SELECT strftime(month, '%Y-%m') || CASE WHEN service = 'AmazonAthena' THEN '-01' ELSE '' END AS period,
           count(*) AS rows, service <> 'AmazonAthena' AS valid
    FROM cur GROUP BY 1, 3
    """,
)


def _catalog(s, d):
    """Declared joins of both bases with how many rows carry each join column."""
    from costspark.plans.billing_view import FOCUS_COLUMNS, focus_view

    joins = enrich.enrichment_catalog(s)
    parts = []
    for base in enrich.ENRICHMENTS:
        names = sorted({source for e in enrich.ENRICHMENTS[base] for source, _ in e.keys})
        facts = focus_view(s, d) if base == "FOCUS" else cur(s, d, *names)
        counts = schemas.filled(facts, [n for n in names if base == "CUR" or n in FOCUS_COLUMNS])
        own = joins.filter(F.col("base_table") == base)
        parts.append(own.drop("name").join(counts, F.col("source_column") == F.col("name")))
    columns = ("base_table", "table_id", "priority", "source_column", "target_column", "confidence", "filled_rows")
    return parts[0].select(*columns).unionByName(parts[1].select(*columns))


register(
    "enrichment_catalog",
    _catalog,
    """
    WITH k(base_table, table_id, priority, source_column, target_column, confidence) AS (VALUES
        ('CUR', 'invoice_summaries', 1, 'bill_invoice_id', 'InvoiceId', 'high'),
        ('CUR', 'invoice_summaries', 2, 'line_item_usage_account_id', 'AccountId', 'high'),
        ('CUR', 'ec2_pricing', 1, 'product_instance_type', 'InstanceType', 'high'),
        ('CUR', 'ec2_pricing', 2, 'product_region', 'Region', 'high'),
        ('CUR', 'ec2_pricing', 3, 'product_operating_system', 'OperatingSystem', 'high'),
        ('CUR', 'ec2_pricing', 4, 'product_tenancy', 'Tenancy', 'high'),
        ('CUR', 'savings_plans', 1, 'line_item_usage_account_id', 'AccountId', 'medium'),
        ('CUR', 'savings_plans', 2, 'product_region', 'Region', 'medium'),
        ('FOCUS', 'invoice_summaries', 1, 'InvoiceId', 'InvoiceId', 'high'),
        ('FOCUS', 'invoice_summaries', 2, 'BillingAccountId', 'BillingAccountId', 'high'))
    SELECT k.*, CASE WHEN source_column IN ('bill_invoice_id', 'InvoiceId') THEN (SELECT count(invoice) FROM cur)
        WHEN source_column = 'line_item_usage_account_id' THEN (SELECT count(account) FROM cur)
        WHEN source_column = 'BillingAccountId' THEN (SELECT count(payer) FROM cur)
        WHEN source_column = 'product_instance_type' THEN (SELECT count(itype) FROM cur)
        WHEN source_column = 'product_operating_system' THEN (SELECT count(os) FROM cur)
        WHEN source_column = 'product_tenancy' THEN (SELECT count(tenancy) FROM cur)
        ELSE (SELECT count(region) FROM cur) END AS filled_rows
    FROM k
    """,
)


def _focus_dictionary(s, d):
    """Values that the FOCUS view holds in each group of the dictionary's columns."""
    from costspark.plans.billing_view import FOCUS_COLUMNS, focus_view

    counts = schemas.filled(focus_view(s, d), list(FOCUS_COLUMNS))
    return schemas.focus_dictionary(s).join(counts, "name").groupBy("category").agg(
        F.count("*").alias("columns"), F.sum("filled_rows").alias("filled_values")
    )


register(
    "focus_dictionary",
    _focus_dictionary,
    """
    SELECT 'Account' AS category, CAST(3 AS BIGINT) AS columns,
           count(payer) + count(location) + count(account) AS filled_values FROM cur UNION ALL
    SELECT 'Billing', 4, count(net_cost) + count(cost) + count(usage) + count(*) FROM cur UNION ALL
    SELECT 'Charge Origination', 1, count(invoice) FROM cur UNION ALL
    SELECT 'Commitment Discount', 3, 2 * count(sp_arn) + count(CASE WHEN l_linenumber IN (1, 2) THEN 1 END) FROM cur UNION ALL
    SELECT 'Location', 1, count(r_name) FROM cur UNION ALL
    SELECT 'Resource', 2, count(resource) + count(itype) FROM cur UNION ALL
    SELECT 'Service', 2, count(*) + count(service) FROM cur UNION ALL
    SELECT 'Timeframe', 1, count(month) FROM cur
    """,
)
