from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from costspark import schemas
from costspark.functions.ratios import clean_floats
from costspark.normalize import normalize_cur
from costspark.operators import enrich, pricing, quality
from costspark.plans.views import build_views
from costspark.sources import exports, price_list, sinks
from tests.conftest import AS_OF, rows


def test_export_round_trip_prunes_and_keeps_text(spark, tmp_path):
    df = spark.createDataFrame([("2024-01", 1), ("2024-02", 2), ("2024-03", 3)], "BILLING_PERIOD string, v int")
    path = str(tmp_path / "export")
    exports.write_export(df, path)
    got = exports.read_export(spark, path, date_start="2024-02")
    assert sorted(rows(got, "BILLING_PERIOD", "v")) == [("2024-02", 2), ("2024-03", 3)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(BILLING_PERIOD" in plan
    files = exports.export_files(spark, path)
    assert "content" not in files._jdf.queryExecution().executedPlan().toString()  # listed, not opened
    listed = [("BILLING_PERIOD=2024-01",), ("BILLING_PERIOD=2024-02",), ("BILLING_PERIOD=2024-03",)]
    assert rows(exports.list_partitions(files)) == listed
    inventory = rows(exports.partition_inventory(files), "partition", "files", "total_size_mb")
    assert [p for p, _, _ in inventory] == ["2024-01", "2024-02", "2024-03"] and all(n >= 1 for _, n, _ in inventory)


def test_materialise_copies_new_files_only(spark, tmp_path):
    source, target = str(tmp_path / "source"), str(tmp_path / "copy")
    schema = "BILLING_PERIOD string, v int"
    add = lambda *data: spark.createDataFrame(list(data), schema).coalesce(1).write.mode("append").partitionBy("BILLING_PERIOD").parquet(source)
    copy = lambda **o: sorted(rows(exports.materialise_export(spark, source, target, spark.createDataFrame([], schema).schema, **o), "BILLING_PERIOD", "v"), key=str)
    add(("2024-01", 1))
    assert copy() == [("2024-01", 1)]
    add(("2024-01", 2), ("2024-02", 3), (None, 4))
    both = [("2024-01", 1), ("2024-01", 2), ("2024-02", 3), (None, 4)]
    assert copy() == both == copy() == copy(overwrite=True)
    assert rows(exports.list_partitions(exports.export_files(spark, target)))[-1] == ("BILLING_PERIOD=__HIVE_DEFAULT_PARTITION__",)


def test_materialise_copies_gzip_files_and_ranges(spark, tmp_path):
    source, gz = str(tmp_path / "source"), str(tmp_path / "gz")
    df = lambda *data: spark.createDataFrame(list(data), "v int, BILLING_PERIOD string").coalesce(1)
    zipped = lambda path, *data: df(*data).write.mode("append").partitionBy("BILLING_PERIOD").csv(path, header=True, compression="gzip")
    copy = lambda path, to, **o: sorted(rows(exports.materialise_export(spark, path, str(tmp_path / to), df().schema, **o), "BILLING_PERIOD", "v"), key=str)
    df((1, "2024-01"), (2, "2024-02")).write.partitionBy("BILLING_PERIOD").parquet(source)
    zipped(source, (3, "2024-02"), (4, "2024-03"), (5, None))
    assert copy(source, "none", date_start="2025-01") == []
    assert copy(source, "mixed", date_start="2024-02", date_end="2024-02") == [("2024-02", 2), ("2024-02", 3)]
    assert copy(source, "mixed", date_start="2024-03") == [("2024-03", 4)]
    every = [("2024-01", 1), ("2024-02", 2), ("2024-02", 3), ("2024-03", 4), (None, 5)]
    assert copy(source, "mixed") == every == copy(source, "mixed", overwrite=True)
    zipped(gz, (6, "2024-01"))
    assert copy(gz, "zipped") == [("2024-01", 6)] == copy(gz, "zipped")


def test_months_with_different_columns_merge(spark, tmp_path):
    path = str(tmp_path / "merge")
    spark.createDataFrame([(1,)], "a int").write.parquet(f"{path}/BILLING_PERIOD=2024-01")
    spark.createDataFrame([(2, "x")], "a int, b string").write.parquet(f"{path}/BILLING_PERIOD=2024-02")
    assert sorted(rows(exports.read_export(spark, path), "a", "b")) == [(1, None), (2, "x")]


def test_daily_filter_drops_unparsable(spark):
    df = spark.createDataFrame([("2024-03-01",), ("nope",), ("2024-03-09",)], "date string")
    assert rows(df.filter(exports.period_filter("COH", "2024-03-01", "2024-03-05"))) == [("2024-03-01",)]
    assert df.filter(exports.period_filter("COH")).count() == 3


def test_csv_needs_schema(spark):
    with pytest.raises(ValueError):
        exports.read_export(spark, "/nowhere", file_format="csv")


def test_normalise_names_and_tags(spark):
    df = spark.createDataFrame(
        [("a", None, "us", '{"Team":"x"}'), ("b", "c", "eu", ""), ("d", None, None, "{broken")],
        "linked_account_id string, line_item_usage_account_id string, product_region_code string, resource_tags string",
    )
    got = rows(normalize_cur(df), "line_item_usage_account_id", "product_region", "resource_tags")
    assert got == [("a", "us", {"Team": "x"}), ("c", "eu", None), ("d", None, None)]


def test_clean_floats(spark):
    df = spark.createDataFrame([(float("nan"), 1), (float("inf"), 2), (1.5, 3)], "x double, y int")
    assert rows(clean_floats(df)) == [(None, 1), (None, 2), (1.5, 3)]


def test_sql_file_and_views(spark, tmp_path):
    path = tmp_path / "q.sql"
    path.write_text("SELECT v + :add AS w FROM CUR;")
    df = spark.createDataFrame([(1,)], "v int")
    assert rows(exports.query_files(spark, str(path), {"CUR": df}, {"add": 2})) == [(3,)]
    built = build_views(spark, [{"one": lambda s: df}, {"two": "SELECT v * 2 AS v FROM one"}], str(tmp_path / "views"))
    assert rows(built["two"]) == [(2,)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, {"a": "b"}, [1, 2])], "x int, m map<string,string>, l array<int>")
    sinks.write_csv(df, str(tmp_path / "c"))
    assert rows(spark.read.csv(str(tmp_path / "c"), header=True)) == [("1", '{"a":"b"}', "[1,2]")]
    sinks.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1
    where = sinks.write_reference_tables({"t": df}, str(tmp_path / "dims"))
    assert spark.read.parquet(where["t"]).count() == 1


def test_schemas(spark):
    assert schemas.focus_dictionary(spark).count() == 57
    assert schemas.focus_column(spark, "effectivecost").first()["name"] == "EffectiveCost"
    assert schemas.focus_column(spark, "nothing").count() == 0
    assert set(schemas.CUR_CORE) <= {f.name for f in schemas.CUR.fields}
    assert schemas.missing_columns(spark.createDataFrame([], schemas.CUR)) == []


def document(**attributes):
    terms = attributes.pop("terms")
    base = dict(location="US East (N. Virginia)", instanceType="t3.micro", operatingSystem="Linux", tenancy="Shared",
                capacitystatus="Used", preInstalledSw="NA", licenseModel="No License required")
    return json.dumps({"product": {"sku": attributes.pop("sku", "s"), "attributes": {**base, **attributes}}, "terms": terms})


def dimension(unit, usd):
    return {"unit": unit, "pricePerUnit": {"USD": usd}}


def test_price_list(spark):
    od = {"OnDemand": {"o": {"priceDimensions": {"d0": dimension("Hrs", "0.0000"), "d1": dimension("Hrs", "0.01")}}}}
    ri = {"Reserved": {
        "a": {"termAttributes": {"LeaseContractLength": "1yr", "PurchaseOption": "Partial Upfront", "OfferingClass": "standard"},
              "priceDimensions": {"x": dimension("Quantity", "30"), "y": dimension("Hrs", "0.004")}},
        "b": {"termAttributes": {"LeaseContractLength": "1yr", "PurchaseOption": "No Upfront", "OfferingClass": "convertible"},
              "priceDimensions": {"y": dimension("Hrs", "0.001")}}}}
    docs = spark.createDataFrame([
        (document(terms={**od, **ri}, vcpu="2"),), (document(terms=od, capacitystatus="Unused", instanceType="x"),),
        (document(terms=od, location="Mars", instanceType="y"),), ("not json",), (document(terms={}, instanceType="z"),),
    ], "document string")
    got = {(r[0], r[1]): r[4] for r in rows(price_list.ondemand_rates(docs))}
    assert got == {("us-east-1", "t3.micro"): 0.01, ("Mars", "y"): 0.01}
    assert rows(price_list.reserved_rates(docs), "payment_option", "upfront_cost", "hourly_cost") == [("Partial Upfront", 30.0, 0.004)]
    meta = {r["instance_type"]: (r["vcpu"], r["storage"]) for r in price_list.instance_metadata(docs).collect()}
    assert meta == {"t3.micro": ("2", "EBS only"), "x": ("Unknown", "EBS only"), "z": ("Unknown", "EBS only")}


def test_usage_type_decoding(spark):
    texts = ["BoxUsage:c5.large", "APN1-DedicatedUsage:c6i.large", "ZZZ9-BoxUsage:m5.large", "Requests", "EUW1-X:a:b"]
    df = spark.createDataFrame([(t,) for t in texts], "usage_type string")
    got = rows(price_list.decode_usage_type(df), "parsed_region", "parsed_instance_type")
    assert got == [("us-east-1", "c5.large"), ("ap-northeast-1", "c6i.large"), ("us-east-1", "m5.large"), ("", ""), ("eu-west-1", "a")]


def test_latest_spot_takes_newest_linux(spark):
    t = lambda h: datetime(2024, 3, 1, h)
    df = spark.createDataFrame([
        (t(1), "us-east-1a", "m", "Linux/UNIX", 1.0), (t(3), "us-east-1b", "m", "Linux/UNIX", 3.0), (t(9), "us-east-1b", "m", "Windows", 9.0),
    ], schemas.SPOT_HISTORY)
    assert rows(price_list.latest_spot(df)) == [("us-east-1", "m", 3.0)]
    assert rows(price_list.latest_spot(df, product="Windows")) == [("us-east-1", "m", 9.0)]
    assert len(rows(price_list.latest_spot(df, per_zone=True))) == 2


def test_compare_and_cheapest_with_gaps(spark):
    od = spark.createDataFrame([("r", "a", "Linux", "Shared", 1.0), ("r", "z", "Linux", "Shared", 0.0)], schemas.AWS_PRICING)
    sp = spark.createDataFrame([("r", "a", 0.25), ("r", "only", 0.1)], "region_code string, instance_type string, spot_price double")
    ri = spark.createDataFrame([("r", "a", "Linux", "1yr", "No Upfront", 0.0, 0.25)],
                               "region_code string, instance_type string, operating_system string, term_length string, payment_option string, upfront_cost double, hourly_cost double")
    pl = spark.createDataFrame([], "region_code string, instance_type string, rate double")
    keys = spark.createDataFrame([("r", "a"), ("r", "z"), ("r", "only"), ("r", "none")], "region_code string, instance_type string")
    got = {r["instance_type"]: r for r in pricing.compare_pricing(od, sp, ri, pl, keys).collect()}
    assert (got["a"]["spot_savings_pct"], got["a"]["ondemand_monthly"], got["a"]["savings_plan_hourly"]) == (75.0, 720.0, None)
    assert got["z"]["ondemand_monthly"] is None and got["z"]["ondemand_hourly"] == 0.0
    assert got["only"]["spot_savings_pct"] is None
    best = {r["instance_type"]: (r["cheapest_option"], r["savings_vs_ondemand_pct"]) for r in
            pricing.cheapest_option(pricing.compare_pricing(od, sp, ri, pl, keys)).collect()}
    assert best == {"a": ("spot", 75.0), "z": ("ondemand", 0.0), "only": ("spot", None)}


def test_price_join_keeps_fan_out(bill, spark):
    line = dict(start="2024-03-01", cost=10.0, usage=4.0, product_code="AmazonEC2", kind="Usage", itype="m", region="r",
                os="Linux", tenancy="Shared", operation="o")
    df = bill(line, {**line, "usage": None}, {**line, "itype": "unpriced"})
    prices = spark.createDataFrame([("r", "m", "Linux", "Shared", 1.0), ("r", "m", "Linux", "Shared", 2.0)], schemas.AWS_PRICING)
    naive = df.join(prices, (df.product_instance_type == prices.instance_type)).agg(
        F.sum("line_item_unblended_cost"), F.avg("price_per_hour_usd"), F.sum(F.col("line_item_usage_amount") * F.col("price_per_hour_usd")))
    got = rows(pricing.cost_efficiency(df, prices), "actual_cost", "current_on_demand_rate", "theoretical_on_demand_cost")
    assert got == rows(naive) == [(40.0, 1.5, 12.0)]


def test_enrich_first_key_fans_out_full_key_does_not(bill, spark):
    line = dict(start="2024-03-01", itype="m", region="r", os="Linux", tenancy="Shared")
    df = bill(line, {**line, "itype": None}, {**line, "os": "Windows"})
    prices = spark.createDataFrame(
        [("m", "r", "Linux", "Shared", 1.0), ("m", "r", "Windows", "Shared", 3.0), ("m", "q", "Linux", "Shared", 2.0)],
        "InstanceType string, Region string, OperatingSystem string, Tenancy string, OnDemandPrice double",
    )
    assert enrich.repeated_keys(prices, "ec2_pricing").count() == 0
    assert enrich.repeated_keys(prices.unionByName(prices), "ec2_pricing").count() == 3
    full = enrich.enrich(df, {"ec2_pricing": prices}, "ec2_pricing")
    assert sorted(rows(full, "ec2_pricing_OnDemandPrice"), key=str) == [(1.0,), (3.0,), (None,)]
    assert enrich.enrich(df, {"ec2_pricing": prices}, "ec2_pricing", full_key=False).count() == 7
    with pytest.raises(ValueError):
        enrich.enrich(df, {}, "nothing")


def test_account_rollup_counts_unmatched_as_one(spark):
    accounts = spark.createDataFrame([("a", "A"), ("b", "B")], "account_id string, account_name string")
    lines = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, None)], "linked_account_id string, unblended_cost double, usage_quantity double")
    assert rows(enrich.account_rollup(accounts, lines)) == [("a", "A", 4.0, 2, 2.0), ("b", "B", None, 1, None)]


def test_quality_report(bill, spark):
    one = dict(start="2024-03-01", cost=1.0, service="s", tags={"a": "1", "b": "2"})
    r = quality.quality_report(bill(one, one, {**one, "cost": -1.0}, {**one, "service": None}), AS_OF).first()
    assert r["duplicate_rows"] == 1 and r["negative_costs"] == 1 and r["days_old"] == 30
    assert len(r["issues"]) == 1 and len(r["warnings"]) == 3
    assert (r["valid"], r["data_quality_score"]) == (False, 65.0)
    empty = quality.quality_report(bill(), AS_OF).first()
    assert (empty["valid"], empty["data_quality_score"]) == (False, 0.0)
    no_cost = quality.quality_report(spark.createDataFrame([(1,)], "x int"), AS_OF).first()
    assert no_cost["issues"] == ["Missing required column: line_item_unblended_cost"]


def test_date_range_check():
    assert quality.check_date_range("2024-01", "2024-02") == []
    assert len(quality.check_date_range("2024-1", "2024-12-01")) == 2
    assert quality.check_date_range("2024-03-02", "2024-03-01", "COH") == ["start_date cannot be after end_date"]


def test_partition_check(spark):
    df = spark.createDataFrame([("2024-01",), ("2024-1",), (None,)], "p string")
    assert {r[0]: r[2] for r in rows(quality.check_periods(df, "p"))} == {"2024-01": True, "2024-1": False, None: False}


def test_mixed_formats_are_read_each_by_its_reader(spark, tmp_path):
    path, df = str(tmp_path / "mix"), spark.range(10)
    df.filter("id < 4").write.parquet(f"{path}/BILLING_PERIOD=2024-01")
    df.filter("id >= 4").write.csv(f"{path}/BILLING_PERIOD=2024-02", compression="gzip", header=True)
    found = exports.detect_formats(spark, path)
    assert found["parquet"] >= 1 and found["csv"] >= 1
    read = lambda kind: sorted(rows(exports.read_export(spark, path, schema=df.schema, file_format=kind), "id"))
    assert read("auto") == [(i,) for i in range(10)]
    assert read("parquet") == [(i,) for i in range(4)] and read("csv") == [(i,) for i in range(4, 10)]
    with pytest.raises(ValueError):
        exports.read_export(spark, path, file_format="auto")


def test_sql_folder_is_read_whole(spark, tmp_path):
    folder = tmp_path / "q.sql"
    folder.mkdir()
    (folder / "part-0").write_text("SELECT 1 AS v")
    (folder / "part-1").write_text("UNION ALL SELECT 2")
    assert rows(exports.query_files(spark, str(folder))) == [(1,), (2,)]


def test_shared_folder(spark, monkeypatch):
    from costspark import runtime

    class Session:
        class conf:
            get = staticmethod(lambda key, default: None)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError):
        runtime.shared_dir(Session)
    assert runtime.shared_dir(Session, "/shared/") == "/shared"
    Session.sparkContext.getCheckpointDir = staticmethod(lambda: "hdfs:///points/")
    assert runtime.shared_dir(Session) == "hdfs:///points"
    assert runtime.shared_dir(spark)


def layouts(spark, path, kind):
    """Three periods: the columns move, one is missing and a new one comes, a type differs."""
    months = [
        ("2024-01", "service string, cost double, note string", [("s3", 1.5, 'a,"b"'), ("ec2", 2.0, None)]),
        ("2024-02", "cost double, extra string, service string", [(2.5, "x", "s3")]),
        ("2024-03", "note string, cost string, service string", [("n\nm", "4.25", "rds"), ("", None, "s3")]),
    ]
    for month, schema, data in months:
        df = spark.createDataFrame(data, schema).coalesce(1)
        if kind == "csv":
            df.write.csv(f"{path}/BILLING_PERIOD={month}", header=True, compression="gzip")
        else:
            df.write.parquet(f"{path}/BILLING_PERIOD={month}")


EVERY = [
    ("2024-01", "ec2", 2.0, None), ("2024-01", "s3", 1.5, 'a,"b"'), ("2024-02", "s3", 2.5, None),
    ("2024-03", "rds", 4.25, "n\nm"), ("2024-03", "s3", None, ""),
]
NAMES = ("BILLING_PERIOD", "service", "cost", "note")


def test_gzip_columns_are_found_by_name(spark, tmp_path):
    path = str(tmp_path / "moved")
    layouts(spark, path, "csv")
    schema = spark.createDataFrame([], "service string, cost double, note string, BILLING_PERIOD string").schema
    read = lambda **o: sorted(rows(exports.read_export(spark, path, schema=schema, file_format="csv", **o), *NAMES), key=str)
    assert read() == sorted(EVERY, key=str)
    assert read(date_start="2024-02", date_end="2024-02") == [EVERY[2]]
    copy = lambda: sorted(rows(exports.materialise_export(spark, path, str(tmp_path / "copy"), schema), *NAMES), key=str)
    assert copy() == sorted(EVERY, key=str) == copy()


def test_gzip_header_of_other_case_and_wrong_values(spark, tmp_path):
    import gzip

    folder = tmp_path / "odd" / "BILLING_PERIOD=2024-01"
    folder.mkdir(parents=True)
    with gzip.open(folder / "a.csv.gz", "wt") as f:
        f.write('﻿COST,"Service",tags,cost\n1.5,"a ""b""","{""k"":""v""}",9\n\n,"line\nend",,\n')
    with gzip.open(folder / "empty.csv.gz", "wt") as f:
        f.write("service,cost\n")
    schema = spark.createDataFrame([], "service string, cost double, tags map<string,string>").schema
    got = rows(exports.read_export(spark, str(tmp_path / "odd"), schema=schema, file_format="csv"), "service", "cost", "tags")
    assert sorted(got, key=str) == [('a "b"', 1.5, {"k": "v"}), ("line\nend", None, None)]
    with gzip.open(folder / "bad.csv.gz", "wt") as f:
        f.write("service,cost\ns3,much\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        exports.read_export(spark, str(tmp_path / "odd"), schema=schema, file_format="csv").select("cost").collect()


def test_gzip_values_keep_their_empty_lines(spark, tmp_path):
    import gzip

    folder = tmp_path / "blank" / "BILLING_PERIOD=2024-01"
    folder.mkdir(parents=True)
    with gzip.open(folder / "a.csv.gz", "wt") as f:
        f.write('service,note\ns3,"a\n\nb \\" c"\n\nec2,d\n')
    schema = spark.createDataFrame([], "service string, note string").schema
    got = rows(exports.read_export(spark, str(tmp_path / "blank"), schema=schema, file_format="csv"), "service", "note")
    assert sorted(got) == [("ec2", "d"), ("s3", 'a\n\nb " c')]


def test_parquet_layouts(spark, tmp_path):
    path = str(tmp_path / "layouts")
    layouts(spark, path, "parquet")
    schema = spark.createDataFrame([], "service string, cost double, note string").schema
    assert [len(f) for _, f in exports.period_layouts(spark, path)] == [1, 1, 1]
    assert sorted(rows(exports.read_layouts(spark, path, schema), *NAMES), key=str) == sorted(EVERY, key=str)
    assert rows(exports.read_layouts(spark, path, schema, date_start="2024-03", date_end="2024-03"), "cost").count((4.25,)) == 1


def test_views_are_ordered_by_what_they_read(spark):
    from costspark.plans.views import build_views, order_views

    texts = {
        "c": "SELECT * FROM b JOIN (SELECT max(v) AS m FROM A) ON v = m",
        "b": "WITH x AS (SELECT v FROM a) SELECT v FROM x WHERE EXISTS (SELECT 1 FROM outside)",
        "a": lambda s: s.table("base"),
        "base": "SELECT 1 AS v UNION ALL SELECT 2",
    }
    order = order_views(spark, texts, {"a": ["base"]})
    assert order == ["base", "a", "b", "c"]
    spark.range(1).createOrReplaceTempView("outside")
    assert rows(build_views(spark, texts, needs={"a": ["base"]})["c"]) == [(2, 2)]
    with pytest.raises(ValueError, match="need each other: .*(p|q)"):
        order_views(spark, {"p": "SELECT * FROM q", "q": "SELECT * FROM p"})


def test_quality_observed_while_copying(bill, spark, tmp_path):
    from costspark.operators import quality

    lines = [dict(cost=1.0, service="s", start="2024-03-01"), dict(cost=1.0, service="s", start="2024-03-01"), dict(cost=-2.0, service=None, start="2024-03-20")]
    for df in (bill(*lines), bill(*lines).drop("line_item_unblended_cost"), bill()):
        rows_, seen = quality.observe_quality(df)
        path = str(tmp_path / f"copy{len(df.columns)}-{df.count()}")
        rows_.write.parquet(path)
        copy = spark.read.schema(df.schema).parquet(path)
        assert rows(quality.observed_report(seen, copy, AS_OF)) == rows(quality.quality_report(df, AS_OF))


def test_stream_export_copies_what_has_come(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    layouts(spark, str(source), "csv")
    schema = spark.createDataFrame([], "service string, cost double, note string, BILLING_PERIOD string").schema
    copy = lambda: sorted(rows(exports.stream_export(spark, str(source), str(target), schema, files_a_period=2), *NAMES), key=str)
    assert copy() == sorted(EVERY, key=str) == copy()
    many = spark.range(100).selectExpr("'ec2' AS service", "cast(id AS double) AS cost", "cast(null AS string) AS note")
    many.repartition(20).write.parquet(f"{source}/BILLING_PERIOD=2024-04")
    assert len(copy()) == len(EVERY) + 100 == len(copy())
    assert 1 <= len(list(target.glob("BILLING_PERIOD=2024-04/*.parquet"))) <= 2
