"""Billing exports: partitioned Parquet or gzip CSV, read, listed and copied."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costspark.sources.named_csv import read_named_csv


@dataclass(frozen=True)
class Export:
    """Partition key (case matters) and date format of an export kind."""

    partition: str
    date_format: str
    pattern: str
    daily: bool = False


# Export kinds.
MONTHLY = ("YYYY-MM", r"^\d{4}-\d{2}$")
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"
SUFFIXES = {"parquet": "*.parquet", "csv": "*.gz"}
# Folder of copied files: which file of the source they come from.
SOURCE_FILE = "source_file"
EXPORTS = {
    "CUR2.0": Export("BILLING_PERIOD", *MONTHLY),
    "FOCUS1.0": Export("billing_period", *MONTHLY),
    "COH": Export("date", "YYYY-MM-DD", r"^\d{4}-\d{2}-\d{2}$", daily=True),
    "CARBON_EMISSION": Export("BILLING_PERIOD", *MONTHLY),
}


def period_filter(export_type: str, start: str | None = None, end: str | None = None) -> Column:
    """Inclusive range on the partition column, which Spark prunes by.

    Months compare as text.  Days are parsed first; a value that is no date is
    left out as soon as a bound is given.
    """
    kind = EXPORTS[export_type]
    value = F.col(kind.partition)
    bound = F.lit
    if kind.daily:
        value = F.try_to_date(value, "yyyy-MM-dd")
        bound = lambda text: F.to_date(F.lit(text), "yyyy-MM-dd")
    out = F.lit(True)
    if start:
        out = out & (value >= bound(start))
    if end:
        out = out & (value <= bound(end))
    return out


def read_export(
    spark: SparkSession,
    path: str,
    export_type: str = "CUR2.0",
    date_start: str | None = None,
    date_end: str | None = None,
    schema: T.StructType | None = None,
    file_format: str = "parquet",
) -> DataFrame:
    """All files of an export as one table, restricted to a range of partitions.

    The partition column stays text: inference would turn ``2024-01`` into a
    date.  Without ``schema`` the footers of all months are merged, which reads
    every file's footer; give a schema for large exports.  ``file_format`` is
    parquet or csv (gzip), which take the files of that suffix, or auto: the files
    are listed and those of both kinds read, each by its reader.  Columns are found by
    name in both: periods may order them differently, lack some or have more.  Where a
    column changes its type between periods, use ``read_layouts``.
    """
    kind = EXPORTS[export_type]
    if file_format == "auto":
        formats = [name for name, n in detect_formats(spark, path).items() if n] or ["parquet"]
    else:
        formats = [file_format]
    if "csv" in formats and schema is None:
        raise ValueError("gzip CSV exports need a schema")
    found = schema or spark.read.option("mergeSchema", True).option("pathGlobFilter", SUFFIXES["parquet"]).parquet(path).schema
    within = period_filter(export_type, date_start, date_end)
    fields = [f for f in found.fields if f.name not in (kind.partition, SOURCE_FILE)]
    full = T.StructType([*fields, T.StructField(kind.partition, T.StringType())])
    out = None
    for name in formats:
        if name == "csv":
            part = read_named_csv(spark, path, full, kind.partition, within=within)
        else:
            part = spark.read.schema(full).option("pathGlobFilter", SUFFIXES[name]).parquet(path)
        part = part.select(*full.names)
        out = part if out is None else out.unionByName(part)
    return out.filter(within)


def period_layouts(spark: SparkSession, path: str, export_type: str = "CUR2.0") -> list[tuple[T.StructType, list[str]]]:
    """The schemas of a Parquet export's periods, each with the folders that have it.

    One footer a period is read; there are as many periods as months or days.
    """
    files = export_files(spark, path, export_type).filter(F.col("name").endswith(".parquet"))
    folder = F.regexp_extract("path", f"^(.*/{EXPORTS[export_type].partition}=[^/]*)/", 1)
    folders = [r[0] for r in files.select(folder.alias("f")).filter("f <> ''").distinct().orderBy("f").collect()]
    found: dict[str, tuple[T.StructType, list[str]]] = {}
    for f in folders:
        schema = spark.read.option("recursiveFileLookup", True).parquet(f).schema
        found.setdefault(schema.json(), (schema, []))[1].append(f)
    return list(found.values())


def read_layouts(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    export_type: str = "CUR2.0",
    date_start: str | None = None,
    date_end: str | None = None,
) -> DataFrame:
    """A Parquet export whose columns move, come, go or change their type between periods, as ``schema``.

    Periods of one layout are read together under their own schema, then cast by name (a cast that
    fails is an error under ANSI rules); what a layout lacks is null.
    """
    key = EXPORTS[export_type].partition
    full = _with_text(schema, key)
    out = spark.createDataFrame([], full)
    for own, folders in period_layouts(spark, path, export_type):
        names = {f.name.lower(): f.name for f in own.fields}
        held = T.StructType([f for f in own.fields if f.name != key] + [T.StructField(key, T.StringType())])
        rows = spark.read.schema(held).option("basePath", path).parquet(*folders)
        column = lambda f: F.col(names[f.name.lower()]) if f.name.lower() in names else F.lit(None)  # noqa: B023, E731
        columns = [column(f).cast(f.dataType).alias(f.name) for f in full.fields if f.name != key]
        out = out.unionByName(rows.select(*columns, key))
    return out.filter(period_filter(export_type, date_start, date_end))


def export_files(spark: SparkSession, path: str, export_type: str = "CUR2.0") -> DataFrame:
    """The files of an export: path, name (from the partition folder on), partition, size, modified.

    A listing: no file is opened.  Files outside a partition folder have a null
    partition and their file name as name; so has the partition of NULL.
    """
    key = EXPORTS[export_type].partition
    whole = F.col("path")
    inside = F.regexp_extract(whole, f"({key}=[^/]*/.*)$", 1)
    value = F.url_decode(F.regexp_extract(whole, f"/{key}=([^/]*)/", 1))
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(path)
        .filter("length > 0")
        .select(
            "path",
            F.when(inside != "", inside).otherwise(F.substring_index(whole, "/", -1)).alias("name"),
            F.when((value != "") & (value != NULL_PARTITION), value).alias("partition"),
            F.col("length").alias("size"),
            F.col("modificationTime").alias("modified"),
        )
    )


def detect_formats(spark: SparkSession, path: str) -> dict[str, int]:
    """How many files of each format lie under ``path``: parquet, and csv for gzip files."""
    name = F.col("name")
    one = export_files(spark, path).agg(
        F.count_if(name.endswith(".parquet")).alias("parquet"), F.count_if(name.endswith(".gz")).alias("csv")
    )
    return one.first().asDict()


def list_partitions(files: DataFrame, export_type: str = "CUR2.0") -> DataFrame:
    """Partition names of ``export_files`` in order; the NULL partition under its folder name."""
    key = EXPORTS[export_type].partition
    name = F.concat(F.lit(f"{key}="), F.coalesce("partition", F.lit(NULL_PARTITION)))
    return files.select(name.alias("partition")).distinct().orderBy("partition")


def partition_inventory(files: DataFrame) -> DataFrame:
    """Files, megabytes and newest change per partition of ``export_files``."""
    return (
        files.groupBy("partition")
        .agg(
            F.count("*").alias("files"),
            F.round(F.sum("size") / (1024 * 1024), 2).alias("total_size_mb"),
            F.max("modified").alias("last_updated"),
        )
        .orderBy("partition")
    )


def query_files(
    spark: SparkSession,
    text: str,
    views: Mapping[str, DataFrame] | None = None,
    args: Mapping[str, object] | None = None,
) -> DataFrame:
    """Run SQL text, or the text of a ``.sql`` file, over named views.

    The name may be that of a folder: its files are one text, in the order of their names.

    Parquet files need no view: ``SELECT ... FROM parquet.`/path` ``.
    """
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(name)
    if text.strip().endswith(".sql"):
        parts = spark.read.text(text.strip(), wholetext=True).select("value", "_metadata.file_name").orderBy("file_name")
        text = "\n".join(r["value"] for r in parts.collect())
    return spark.sql(text.strip().rstrip(";"), args=dict(args or {}))


def alias_table(df: DataFrame, name: str = "CUR") -> DataFrame:
    """Bind ``name`` to another table for SQL users."""
    df.createOrReplaceTempView(name)
    return df


def write_export(df: DataFrame, path: str, export_type: str = "CUR2.0") -> DataFrame:
    """Write ``df`` as an export, one folder a period, and return it read back."""
    df.write.mode("overwrite").partitionBy(EXPORTS[export_type].partition).parquet(path)
    return read_export(df.sparkSession, path, export_type, schema=df.schema)


def materialise_export(
    spark: SparkSession,
    source: str,
    target: str,
    schema: T.StructType,
    export_type: str = "CUR2.0",
    overwrite: bool = False,
    date_start: str | None = None,
    date_end: str | None = None,
) -> DataFrame:
    """Copy the files of an export that ``target`` doesn't have yet; the copy is returned.

    Parquet and gzip CSV files are copied, both to Parquet.  A range of partitions selects as in
    ``read_export``, what is copied and what is returned; other periods of the copy stay.

    A file is known by its name below the export and its size; what is copied from it lies in a
    folder of its own inside its period, so a copy that is repeated replaces itself.  A file
    that has grown is copied anew and its earlier copy goes.  Periods gain files, and the NULL
    period is copied like any other.  Only new files are opened; nothing is shuffled.
    """
    key = EXPORTS[export_type].partition
    full = _with_text(schema, key)
    mark = F.concat_ws("-", F.md5("name"), F.col("size").cast("string"))
    kind = F.when(F.col("name").endswith(".parquet"), "parquet").when(F.col("name").endswith(".gz"), "csv")
    files = export_files(spark, source, export_type).withColumnRenamed("partition", key)
    files = files.filter(period_filter(export_type, date_start, date_end))
    listed = files.select("path", mark.alias("mark"), kind.alias("kind")).filter("kind IS NOT NULL")
    have = _copied_marks(spark, target)
    # Two lists of file names: as long as the listings that Spark itself keeps on the driver.
    new = listed.collect() if overwrite or not have else [r for r in listed.collect() if r["mark"] not in have]
    if new:
        path, size = F.col("_metadata.file_path"), F.col("_metadata.file_size")
        # As in export_files, but plain searches: these run once a row.
        inside = F.expr(f"substr(_metadata.file_path, locate('{key}=', _metadata.file_path))")
        name = F.when(path.contains(f"{key}=") & inside.contains("/"), inside).otherwise(F.substring_index(path, "/", -1))
        marked = None
        for form in reversed(SUFFIXES):  # gzip files are the longer tasks, so they begin
            paths = [r["path"] for r in new if r["kind"] == form]
            if not paths:
                continue
            origin = F.concat_ws("-", F.md5(name), size.cast("string"))
            if form == "csv":
                part = read_named_csv(spark, paths, full, key, origin, SOURCE_FILE, source).select(*full.names, SOURCE_FILE)
            else:
                part = spark.read.schema(full).option("basePath", source).parquet(*paths).select(*full.names, origin.alias(SOURCE_FILE))
            marked = part if marked is None else marked.unionByName(part)
        (
            marked.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(key, SOURCE_FILE)
            .parquet(target)
        )
        fresh = {r["mark"].split("-")[0]: r["mark"] for r in new}
        stale = [folder for m, folder in have.items() if fresh.get(m.split("-")[0], m) != m]
        _delete_folders(spark, stale)
    elif not have:  # no file in the range, none copied before
        return spark.createDataFrame([], full)
    return read_export(spark, target, export_type, date_start, date_end, schema)


def stream_export(
    spark: SparkSession,
    source: str,
    target: str,
    schema: T.StructType,
    export_type: str = "CUR2.0",
    files_a_period: int = 8,
    checkpoint: str | None = None,
) -> DataFrame:
    """Copy the files that have come since the last call, Parquet and gzip CSV; the copy is returned.

    For exports that add files and never rewrite them (``materialise_export`` compares sizes too).  The
    stream's own log knows which files are done, so no list of files or marks is gathered; a call
    takes what is there and stops, and a call that fails goes on where it was.  A call writes at most
    ``files_a_period`` files into a period, dealt by a hash, so one large period is no single task.
    """
    key = EXPORTS[export_type].partition
    full = _with_text(schema, key)
    flat = spark.readStream.schema(full).option("pathGlobFilter", SUFFIXES["parquet"]).parquet(source).select(*full.names)
    rows = flat.unionByName(read_named_csv(spark, source, full, key, stream=True).select(*full.names))
    plain = [f.name for f in full.fields if not isinstance(f.dataType, T.MapType)]
    dealt = rows.withColumn("dealt", F.pmod(F.xxhash64(*plain), F.lit(files_a_period)))
    query = (
        dealt.repartition(key, "dealt").drop("dealt")
        .writeStream.format("parquet").outputMode("append").partitionBy(key)
        .option("path", target).option("checkpointLocation", checkpoint or f"{target}/_checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return read_export(spark, target, export_type, schema=schema)


def _with_text(schema: T.StructType, key: str) -> T.StructType:
    return T.StructType([f for f in schema.fields if f.name != key] + [T.StructField(key, T.StringType())])


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def _copied_marks(spark: SparkSession, target: str) -> dict[str, str]:
    """Marks of the files that were copied to ``target``, with the folder of each."""
    root, fs = _file_system(spark, target)
    if not fs.exists(root):
        return {}
    folders = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(root, f"*/{SOURCE_FILE}=*"))
    paths = [f.getPath().toString() for f in folders]
    return {p.rsplit(f"{SOURCE_FILE}=", 1)[1]: p for p in paths}


def _delete_folders(spark: SparkSession, paths: Sequence[str]) -> None:
    for path in paths:
        folder, fs = _file_system(spark, path)
        fs.delete(folder, True)


def sample(df: DataFrame, n: int = 100, order_by: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows, in an order if columns are given."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)


def cap_rows(df: DataFrame, limit: int | None) -> DataFrame:
    return df.limit(limit) if limit else df


def table_overview(
    df: DataFrame, start_column: str, extra: Sequence[str] = ()
) -> DataFrame:
    """Rows and date range of a table."""
    return df.agg(
        F.count("*").alias("record_count"),
        F.min(start_column).alias("earliest_date"),
        F.max(start_column).alias("latest_date"),
        *[F.countDistinct(c).alias(f"distinct_{c}") for c in extra],
    )
