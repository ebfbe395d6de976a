"""Structured Streaming jobs, run to completion over the test tables.

A service here is an event type, a region a user group, the cost the event's
value.  ``scheduled`` mode reads what is there and stops.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.base import DAY, register
from checks.trend_checks import FORECAST
from costspark.plans.billing_view import TABLES, billing_view
from costspark.runtime import materialise, scratch_path
from costspark.streaming import alerts, baselines, closed_days, updates

RENAMED = """ts AS line_item_usage_start_date|event_type AS product_servicecode|
    concat('group-', user_id % 3) AS product_region|value AS line_item_unblended_cost""".split("|")


def _lines(spark: SparkSession, sf_dir: str, stream: bool) -> DataFrame:
    reader = (spark.readStream if stream else spark.read).schema(TABLES["events"])
    files = reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    # Event time must be a TIMESTAMP for the watermark.
    return files.withColumn("ts", F.col("ts").cast("timestamp")).selectExpr(*RENAMED)


def _finish(events: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    path = scratch_path(spark, name)
    alerts.start_sink(events, path, f"{path}-checkpoint", "scheduled").awaitTermination()
    return spark.read.schema(events.schema).parquet(path)


# A day is final when it ends before the newest event minus two days.
EVENTS = """
    WITH e AS (SELECT CAST(ts AS DATE) AS day, event_type AS service,
                      'group-' || CAST(user_id % 3 AS VARCHAR) AS region, value AS cost FROM events),
         closed AS (SELECT * FROM e WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 DAY FROM events))
"""
BUDGETS = [("view", 600.0), ("click", 3000.0), ("error", 900.0), ("purchase", 12.0)]
BUDGET_SQL = """b(service, threshold) AS (VALUES ('view', 600.0::DOUBLE), ('click', 3000.0::DOUBLE),
    ('error', 900.0::DOUBLE), ('purchase', 12.0::DOUBLE))"""

register(
    "stream_daily_cost",
    lambda s, d: _finish(
        alerts.daily_cost_stream(_lines(s, d, True), "product_servicecode", "product_region"), s, "daily"
    ),
    "--plain" + EVENTS + """
    SELECT day AS usage_date, service AS product_servicecode, region AS product_region,
           round(sum(cost), 2) AS current_cost FROM closed GROUP BY 1, 2, 3
    """,
)
register(
    "stream_budget_alerts",
    lambda s, d: _finish(
        alerts.budget_alerts(
            alerts.daily_cost_stream(_lines(s, d, True)),
            s.createDataFrame(BUDGETS, "service string, threshold double"),
        ),
        s,
        "budget",
    ),
    "--plain" + EVENTS + f""", {BUDGET_SQL},
    g AS (SELECT day, c.service, sum(cost) AS v, threshold, sum(cost) / threshold AS share
          FROM closed c JOIN b ON b.service = c.service GROUP BY day, c.service, threshold)
    SELECT 'budget-' || CAST(day AS VARCHAR) || '-' || service AS alert_id,
           CASE WHEN share > 1 THEN 'budget_exceeded' ELSE 'threshold_reached' END AS alert_type, service,
           round(v, 2) AS current_cost, threshold,
           CASE WHEN share > 1.5 THEN 'critical' WHEN share > 1.2 THEN 'high' WHEN share > 1 THEN 'medium'
                ELSE 'low' END AS severity, day AS usage_date
    FROM g WHERE share >= 0.8
    """,
)


def _anomalies(s, d):
    keys = ("product_servicecode", "product_region")
    history = (
        _lines(s, d, False)
        .groupBy(F.to_date("line_item_usage_start_date").alias("day"), *keys)
        .agg(F.sum("line_item_unblended_cost").alias("daily_cost"))
    )
    daily = alerts.daily_cost_stream(_lines(s, d, True), *keys)
    baseline = materialise(alerts.anomaly_baseline(history), scratch_path(s, "baseline"))
    return _finish(alerts.anomaly_alerts(daily, baseline), s, "anomaly")


register(
    "stream_anomalies",
    _anomalies,
    "--plain" + EVENTS + """,
    h AS (SELECT day, service, region, sum(cost) AS c FROM e GROUP BY 1, 2, 3),
    st AS (SELECT service, region, avg(c) AS a, stddev_samp(c) AS sd FROM h GROUP BY 1, 2 HAVING count(*) >= 7),
    g AS (SELECT day, service, region, sum(cost) AS c FROM closed GROUP BY 1, 2, 3)
    SELECT 'unusual_spike' AS alert_type, g.service, g.region, round(c, 4) AS current_cost,
           round(a + sd * 2, 4) AS threshold,
           CASE WHEN c > a THEN 'high_spend_anomaly' ELSE 'low_spend_anomaly' END AS anomaly_type,
           CASE WHEN abs(c - a) / sd > 3 THEN 'high' WHEN abs(c - a) / sd > 2.5 THEN 'medium' ELSE 'low' END AS severity,
           day AS usage_date
    FROM g JOIN st ON st.service = g.service AND st.region = g.region
    WHERE c > a + sd * 2 OR (c < a - sd * 2 AND c > 0)
    """,
    digits=4,
)

LANDED = (
    "line_item_usage_start_date", "product_servicecode", "line_item_unblended_cost",
    "line_item_usage_amount", "line_item_resource_id", "product_instance_type",
)


def _updated(update, months=12):
    """Billing rows that arrive in three runs, the oldest months last, and the result they leave."""

    def run(s, d):
        source, path = scratch_path(s, "lines"), scratch_path(s, "updates")
        rows = billing_view(s, d, *LANDED)
        late = F.col("line_item_usage_start_date") < "2000-01-01"
        third = F.pmod(F.xxhash64("line_item_resource_id"), F.lit(2)) == 0
        for part in (rows.filter(~late & third), rows.filter(~late & ~third), rows.filter(late)):
            part.write.mode("append").parquet(source)
            stream = s.readStream.schema(rows.schema).parquet(source)
            updates.start_updates(stream, update, path, "scheduled", months=months, fan=2).awaitTermination()
        return updates.latest_result(s, path)

    return run


register(
    "stream_optimization_opportunities",
    _updated(updates.opportunities(min_records=1), months=0),
    """
    WITH m AS (SELECT * FROM cur WHERE cost > 0 AND month = (SELECT max(month) FROM cur)),
    i AS (SELECT resource, service, sum(cost) AS c, avg(CASE WHEN usage > 0 THEN usage ELSE 0 END) AS u FROM m
          WHERE service IN ('AmazonEC2', 'AmazonRDS', 'ElasticLoadBalancing') GROUP BY resource, service, itype
          HAVING u < 10),
    g AS (SELECT resource, itype, sum(cost) AS c, avg(usage) AS u FROM m
          WHERE service = 'AmazonEC2' GROUP BY resource, itype HAVING count(*) > 1),
    z AS (SELECT resource, u, c * 0.5 AS saved FROM g
          WHERE u < 60 AND ((itype LIKE '%xlarge%' AND u < 50) OR (itype LIKE '%large%' AND u < 30)
                            OR (itype LIKE '%medium%' AND u < 20)))
    SELECT concat_ws('-', 'idle', resource, service) AS opportunity_id, 'idle_resource' AS type,
           round(c * CASE WHEN u < 5 THEN 0.9 ELSE 0.3 END, 4) AS potential_savings, 90 AS confidence,
           u < 5 AS action_required
    FROM i UNION ALL
    SELECT 'rightsizing_' || resource, 'rightsizing', CAST(round(CAST(saved AS DECIMAL(28,6)), 2) AS DOUBLE),
           CASE WHEN u < 20 THEN 95 WHEN u < 40 THEN 85 ELSE 70 END, true
    FROM z
    """,
    digits=4,
)
register(
    "stream_next_month_forecast",
    _updated(updates.next_month()),
    f"""
    WITH m AS (SELECT month, sum(cost) AS s FROM cur
               WHERE cost > 0 AND ts >= (SELECT CAST(max(ts) AS DATE) FROM cur) - INTERVAL 12 MONTH GROUP BY month),
         r AS (SELECT s, row_number() OVER (ORDER BY month DESC) AS n FROM m),
         v AS (SELECT max(CASE WHEN n = 1 THEN s END) AS m0, max(CASE WHEN n = 2 THEN s END) AS m1 FROM r)
    SELECT round(m0 * (1 + (m0 - m1) / m1), 2) AS next_month, 75 AS confidence FROM v
    """,
)
register(
    "stream_service_forecasts",
    _updated(updates.service_forecasts()),
    FORECAST.replace(f"{DAY} -", "(SELECT CAST(max(ts) AS DATE) FROM cur) -") + """
    SELECT service, mo AS month, round(greatest(0, v), 6) AS forecasted_cost,
           round(greatest(0, v * 0.85), 6) AS lower, round(v * 1.15, 6) AS upper, conf AS confidence, trend FROM f
    """,
    digits=6,
)


def _closed_days(s, d):
    """Events of three groups of users, one run each: the later groups come after their days were closed."""
    source, path = scratch_path(s, "events"), scratch_path(s, "closed")
    lines = _lines(s, d, False)
    for k in range(3):
        lines.filter(F.col("product_region") == f"group-{k}").write.mode("append").parquet(source)
        stream = s.readStream.schema(lines.schema).parquet(source)
        closed_days.start_closed_days(stream, path, mode="scheduled", fan=2).awaitTermination()
    return s.read.parquet(f"{path}/served").drop("month")


register(
    "stream_closed_days_with_late_rows",
    _closed_days,
    """--plain
    WITH e AS (SELECT ts, CAST(ts AS DATE) AS day, event_type AS service, user_id % 3 AS k, value AS cost FROM events),
         m AS (SELECT k, max(max(ts)) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest
               FROM e GROUP BY k)
    SELECT day AS usage_date, service AS product_servicecode, 'group-' || e.k AS product_region,
           round(sum(cost), 2) AS current_cost, count(*) AS lines,
           count(*) FILTER (WHERE day < CAST(newest - INTERVAL 2 DAY AS DATE)) AS late_lines
    FROM e JOIN m ON m.k = e.k
    WHERE day < (SELECT CAST(max(ts) - INTERVAL 2 DAY AS DATE) FROM e) GROUP BY 1, 2, 3
    """,
)


def _month_alerts(s, d):
    """Billing rows up to three dates inside months, one run each; the budget is a service's mean month."""
    source, path = scratch_path(s, "lines"), scratch_path(s, "month-alerts")
    view = billing_view(s, d, "line_item_usage_start_date", "product_servicecode", "line_item_unblended_cost")
    lines = view.withColumn("line_item_usage_start_date", F.col("line_item_usage_start_date").cast("timestamp"))
    months = lines.groupBy("product_servicecode", F.date_trunc("month", "line_item_usage_start_date").alias("m")).agg(
        F.sum("line_item_unblended_cost").alias("cost")
    )
    budgets = months.groupBy(F.col("product_servicecode").alias("service")).agg((F.sum("cost") / F.count("*")).alias("budget"))
    budgets = materialise(budgets, scratch_path(s, "month-budgets"))
    since = ""
    for until in ("1995-03-12", "1997-08-20", "9999"):
        day = F.date_format("line_item_usage_start_date", "yyyy-MM-dd")
        lines.filter((day >= since) & (day < until)).write.mode("append").parquet(source)
        stream = s.readStream.schema(lines.schema).parquet(source)
        alerts.start_month_alerts(stream, budgets, path, mode="scheduled").awaitTermination()
        since = until
    return alerts.month_alerts(s, path)


register(
    "stream_month_to_date_alerts",
    _month_alerts,
    """
    WITH g AS (SELECT CAST(ts AS DATE) AS day, month, service, sum(cost) AS c FROM cur WHERE service IS NOT NULL GROUP BY 1, 2, 3),
    b AS (SELECT service, sum(c) / count(DISTINCT month) AS budget FROM g GROUP BY service),
    r AS (SELECT day, month, service, sum(c) OVER (PARTITION BY service, month ORDER BY day) AS so_far FROM g
          WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) FROM cur) - INTERVAL 2 DAY),
    x AS (SELECT r.service, month, level, day, so_far, budget,
                 row_number() OVER (PARTITION BY r.service, month, level ORDER BY day) AS n
          FROM r JOIN b ON b.service = r.service, (VALUES (0.8::DOUBLE), (1.0::DOUBLE), (1.2::DOUBLE), (1.5::DOUBLE)) l(level)
          WHERE so_far >= level * budget)
    SELECT concat_ws('-', 'month', strftime(month, '%Y-%m'), service, CAST(level AS VARCHAR)) AS alert_id,
           CASE WHEN level >= 1 THEN 'budget_exceeded' ELSE 'threshold_reached' END AS alert_type, service, month, level,
           day AS crossed_on, round(so_far, 2) AS month_to_date, round(budget, 2) AS budget,
           CASE WHEN so_far / budget > 1.5 THEN 'critical' WHEN so_far / budget > 1.2 THEN 'high'
                WHEN so_far / budget > 1 THEN 'medium' ELSE 'low' END AS severity
    FROM x WHERE n = 1
    """,
)


def _following(s, d):
    """Events up to two dates and to the end, one run each; the baseline that has followed them."""
    source, path = scratch_path(s, "dated"), scratch_path(s, "following")
    lines, since = _lines(s, d, False), "0"
    for until in ("2024-01-09", "2024-01-17", "9"):
        day = F.date_format("line_item_usage_start_date", "yyyy-MM-dd")
        lines.filter((day >= since) & (day < until)).write.mode("append").parquet(source)
        stream = s.readStream.schema(lines.schema).parquet(source)
        baselines.start_following_alerts(stream, path, mode="scheduled").awaitTermination()
        since = until
    told = s.read.option("recursiveFileLookup", True).parquet(f"{path}/alerts")
    told = told.groupBy("service", "region").agg(F.count("*").alias("alerts"))
    kept = baselines.following_baseline(s, path).withColumnsRenamed({"product_servicecode": "service", "product_region": "region"})
    return kept.join(told, ["service", "region"], "left").fillna({"alerts": 0})


# A batch's days: those that close when the newest event of a run has come.
register(
    "stream_following_baseline",
    _following,
    "--plain" + EVENTS + """,
    g AS (SELECT day, service, region, sum(cost) AS c FROM closed GROUP BY 1, 2, 3),
    runs AS (SELECT CAST(max(ts) - INTERVAL 2 DAY AS DATE) AS bound FROM events WHERE ts < '2024-01-09'
             UNION ALL SELECT CAST(max(ts) - INTERVAL 2 DAY AS DATE) FROM events WHERE ts < '2024-01-17'),
    seen AS (SELECT g.day, g.service, g.region, g.c, max(r.bound) AS bound FROM g JOIN runs r ON r.bound <= g.day GROUP BY ALL),
    st AS (SELECT s.day, s.service, s.region, s.c, avg(h.c) AS a, stddev_samp(h.c) AS sd FROM seen s
           JOIN g h ON h.service = s.service AND h.region = s.region AND h.day < s.bound
           GROUP BY ALL HAVING count(*) >= 7),
    told AS (SELECT service, region, count(*) AS n FROM st
             WHERE c > a + 2 * sd OR (c < a - 2 * sd AND c > 0) GROUP BY 1, 2)
    SELECT g.service, g.region, round(avg(c), 6) AS avg_daily_cost, round(stddev_samp(c), 6) AS sd,
           coalesce(any_value(n), 0) AS alerts
    FROM g LEFT JOIN told t ON t.service = g.service AND t.region = g.region GROUP BY 1, 2 HAVING count(*) >= 7
    """,
    digits=6,
)
