from __future__ import annotations

from datetime import datetime

import pytest
from costspark.streaming import alerts, updates
from tests.conftest import rows

SCHEMA = """line_item_usage_start_date timestamp, product_servicecode string, product_region string,
    line_item_unblended_cost double"""


def land(spark, path, name, *lines):
    data = [(datetime.fromisoformat(t), s, "r", c) for t, s, c in lines]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.parquet(f"{path}/{name}")


def run(spark, path, out, *keys):
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(str(path))
    daily = alerts.daily_cost_stream(stream, *keys)
    alerts.start_sink(daily, f"{out}/table", f"{out}/checkpoint", "scheduled").awaitTermination()
    return spark.read.schema(daily.schema).parquet(f"{out}/table")


def test_stream_equals_batch_and_drops_late_rows(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    land(spark, source, "a", ("2024-03-01 01:00", "s", 1.0), ("2024-03-01 02:00", "s", 2.0), ("2024-03-02 01:00", "s", 5.0))
    run(spark, source, out)
    land(spark, source, "b", ("2024-03-10 01:00", "s", 7.0))
    got = run(spark, source, out)
    assert sorted(str(d) + f" {c}" for d, _, c in rows(got)) == ["2024-03-01 3.0", "2024-03-02 5.0"]
    # 1 March closed when the watermark passed it: a late row changes nothing.
    land(spark, source, "c", ("2024-03-01 09:00", "s", 100.0), ("2024-03-20 01:00", "s", 1.0))
    got = run(spark, source, out)
    assert sorted(c for _, _, c in rows(got)) == [3.0, 5.0, 7.0]


def test_budget_alert_levels(spark):
    days = [(datetime(2024, 3, 1).date(), s, c) for s, c in
            (("a", 79.0), ("b", 80.0), ("c", 100.0), ("d", 101.0), ("e", 121.0), ("f", 151.0), ("z", 999.0))]
    daily = spark.createDataFrame(days, "usage_date date, product_servicecode string, current_cost double")
    budgets = spark.createDataFrame([(s, 100.0) for s in "abcdef"], "service string, threshold double")
    got = {r["service"]: (r["alert_type"], r["severity"]) for r in alerts.budget_alerts(daily, budgets).collect()}
    assert got == {
        "b": ("threshold_reached", "low"), "c": ("threshold_reached", "low"), "d": ("budget_exceeded", "medium"),
        "e": ("budget_exceeded", "high"), "f": ("budget_exceeded", "critical"),
    }


def test_updates_add_up_and_never_go_back(spark, tmp_path, bill):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")

    def send(name, *lines):
        bill(*lines).coalesce(1).write.parquet(f"{source}/{name}")

    def step():
        stream = spark.readStream.schema(bill().schema).option("recursiveFileLookup", True).parquet(source)
        updates.start_updates(stream, updates.opportunities(), path, "scheduled").awaitTermination()
        found = updates.latest_result(spark, path).collect()
        return {r["opportunity_id"]: round(r["potential_savings"], 4) for r in found}

    line = dict(start="2024-03-05", cost=10.0, usage=1.0, resource="a", service="AmazonEC2", itype="m")
    send("one", line)
    assert step() == {"idle-a-AmazonEC2": 9.0}
    send("two", {**line, "start": "2024-03-06"}, {**line, "resource": "b"})
    both = {"idle-a-AmazonEC2": 18.0, "idle-b-AmazonEC2": 9.0}
    assert step() == both
    send("late", {**line, "start": "2024-01-05", "resource": "c"})
    assert step() == both
    send("again", {**line, "start": "2024-01-06", "resource": "c"}, {**line, "start": "2024-03-01", "resource": "b"})
    assert step() == {"idle-a-AmazonEC2": 18.0, "idle-b-AmazonEC2": 18.0}
    assert updates.latest_result(spark, str(tmp_path / "nothing")) is None


def test_modes():
    assert alerts.trigger("scheduled") == {"availableNow": True}
    assert alerts.trigger("batched", 3) == {"processingTime": "3 minutes"}
    with pytest.raises(ValueError):
        alerts.trigger("sometimes")


def test_updates_write_what_the_batch_brings(spark, tmp_path, bill):
    """A batch of one line in a month of many resources writes one row of sums, but for a merge now and then."""
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    line = dict(start="2024-03-05", cost=1.0, usage=1.0, service="AmazonEC2", itype="m")
    written = []
    for n in range(7):
        batch = [{**line, "resource": f"r{i}"} for i in range(300)] if n == 0 else [{**line, "resource": "r0"}]
        bill(*batch).coalesce(1).write.parquet(f"{source}/{n}")
        stream = spark.readStream.schema(bill().schema).option("recursiveFileLookup", True).parquet(source)
        updates.start_updates(stream, updates.opportunities(), path, "scheduled", fan=4).awaitTermination()
        parts = [p for p in (tmp_path / "out/sums").iterdir() if p.name.split("=")[1].split("-")[0] == str(n)]
        written.append({p.name: spark.read.parquet(str(p)).count() for p in parts})
    assert written[0] == {"part=0": 300} and written[1] == {"part=1": 1} and written[2] == {"part=2": 1}
    assert written[3]["part=3-1"] == 300 and written[4] == {"part=4": 1} and written[6] == {"part=6": 1}
    found = {r["opportunity_id"]: r["potential_savings"] for r in updates.latest_result(spark, path).collect()}
    assert len(found) == 300 and found["idle-r0-AmazonEC2"] == pytest.approx(7 * 0.9) and found["idle-r9-AmazonEC2"] == pytest.approx(0.9)


def test_a_repeated_batch_is_not_doubled(spark, tmp_path):
    from costspark.streaming.sum_log import SumLog

    frame = lambda *data: spark.createDataFrame(list(data), "k string, month string, v double")
    log = lambda entries: SumLog(str(tmp_path / "log"), ("k",), frame().schema, list(entries), 3)
    one = log([])
    assert one.append(frame(("a", "2024-01", 1.0), ("b", "2024-02", 5.0)), 0) == ["2024-01", "2024-02"]
    for _ in range(2):  # the second time as after a failure
        two = log(one.entries)
        two.append(frame(("a", "2024-01", 2.0)), 1)
    three = log(two.entries)
    three.append(frame(("a", "2024-01", 4.0)), 2)
    three.sweep(spark, two.entries)
    assert sorted(three.entries) == [("2024-01", "2-1", 1), ("2024-02", "0", 0)]
    assert sorted(rows(three.sums(spark))) == [("a", "2024-01", 7.0), ("b", "2024-02", 5.0)]
    assert rows(three.sums(spark, since="2024-02")) == [("b", "2024-02", 5.0)]
    assert sorted(rows(two.sums(spark, months=["2024-01"]))) == [("a", "2024-01", 3.0)]  # its parts are still there


def test_month_to_date_crossings_between_batches(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "out")
    budgets = spark.createDataFrame([("a", 100.0), ("b", 10.0), ("none", 0.0)], "service string, budget double")
    told = []
    batches = [
        [("2024-03-01 01:00", "a", 50.0), ("2024-03-02 01:00", "a", 20.0)],
        [("2024-03-06 01:00", "a", 15.0), ("2024-03-06 02:00", "b", 40.0), ("2024-03-06 02:00", "none", 9.0)],
        [("2024-03-09 01:00", "a", 20.0), ("2024-03-31 23:00", "a", 40.0)],
        [("2024-04-03 01:00", "a", 79.0), ("2024-04-20 01:00", "a", 1.0), ("2024-05-20 01:00", "z", 1.0)],
    ]
    for n, lines in enumerate(batches):
        land(spark, source, str(n), *lines)
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(str(source))
        alerts.start_month_alerts(stream, budgets, path, mode="scheduled").awaitTermination()
        found = [p for p in (tmp_path / "out").glob("alerts/*/*.parquet")]
        told.append(alerts.month_alerts(spark, path).count() if found else 0)
    got = {(r["service"], str(r["crossed_on"]), r["level"], r["severity"]) for r in alerts.month_alerts(spark, path).collect()}
    assert got == {
        ("a", "2024-03-06", 0.8, "low"), ("a", "2024-03-09", 1.0, "medium"), ("a", "2024-03-31", 1.2, "high"),
        ("b", "2024-03-06", 0.8, "critical"), ("b", "2024-03-06", 1.0, "critical"), ("b", "2024-03-06", 1.2, "critical"),
        ("b", "2024-03-06", 1.5, "critical"), ("a", "2024-04-20", 0.8, "low"),
    }
    assert told[-1] == len(got) and told == sorted(told)


def test_closed_days_are_corrected_by_late_rows(spark, tmp_path):
    from costspark.streaming.closed_days import start_closed_days

    source, path = tmp_path / "in", str(tmp_path / "out")
    batches = [
        [("2024-03-30 01:00", "s", 1.0), ("2024-03-31 02:00", "s", 2.0), ("2024-04-04 01:00", "s", 5.0)],
        [("2024-03-30 05:00", "s", 10.0), ("2024-04-05 01:00", "s", 7.0), ("2024-04-04 02:00", "s", 3.0)],
        [("2024-04-20 00:00", "s", 1.0)],
        [("2024-01-15 00:00", "t", 4.0), ("2024-04-04 23:00", "t", 8.0)],
    ]
    served = []
    for n, lines in enumerate(batches):
        land(spark, source, str(n), *lines)
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(str(source))
        start_closed_days(stream, path, ("product_servicecode",), mode="scheduled", fan=2).awaitTermination()
        table = spark.read.parquet(f"{path}/served")
        served.append({(str(r["usage_date"]), r["product_servicecode"]): (r["current_cost"], r["late_lines"]) for r in table.collect()})
    assert served[0] == {("2024-03-30", "s"): (1.0, 0), ("2024-03-31", "s"): (2.0, 0)}
    assert served[1] == {("2024-03-30", "s"): (11.0, 1), ("2024-03-31", "s"): (2.0, 0)}
    april = {("2024-04-04", "s"): (8.0, 0), ("2024-04-05", "s"): (7.0, 0)}
    assert served[2] == {**served[1], **april}
    assert served[3] == {**served[2], ("2024-01-15", "t"): (4.0, 1), ("2024-04-04", "t"): (8.0, 1)}
    late = spark.read.option("recursiveFileLookup", True).schema(SCHEMA).parquet(f"{path}/late")
    assert sorted(r["line_item_unblended_cost"] for r in late.collect()) == [4.0, 8.0, 10.0]


def test_moments_merge_without_cancelling(spark):
    import random
    import statistics

    from costspark.functions.moments import merge_moments, moments, spread

    rng = random.Random(4)
    values = [1e9 + rng.random() for _ in range(200)] + [None]
    data = [(i % 7, "k" if v is None or i % 2 else "m", v) for i, v in enumerate(values)]
    df = spark.createDataFrame([*data, (0, "empty", None), (1, "one", 3.0)], "part int, key string, v double")
    parts = df.groupBy("part", "key").agg(*moments("v"))
    got = {r["key"]: (r["n"], r["mean"], r["sd"]) for r in merge_moments(parts, ["key"]).withColumn("sd", spread()).collect()}
    for key in "km":
        own = [v for _, k, v in data if k == key and v is not None]
        n, mean, sd = got[key]
        assert n == len(own) and mean == pytest.approx(statistics.fmean(own)) and sd == pytest.approx(statistics.stdev(own), rel=1e-4)
    assert got["empty"] == (0, 0.0, None) and got["one"] == (1, 3.0, None)
