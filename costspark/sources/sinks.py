"""Results and reference tables as files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text, for formats without nesting."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(
        [
            F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def write_csv(df: DataFrame, path: str, header: bool = True, compression: str = "none") -> None:
    flat(df).write.mode("overwrite").csv(path, header=header, compression=compression)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_reference_tables(tables: Mapping[str, DataFrame], path: str) -> dict[str, str]:
    """Each table as Parquet and CSV below ``path``; returns where."""
    written = {}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
        write_csv(df, f"{path}/{name}.csv")
        written[name] = f"{path}/{name}.parquet"
    return written


def save_view(df: DataFrame, name: str, path: str) -> DataFrame:
    """Write a result and bind ``name`` to the written table."""
    df.write.mode("overwrite").parquet(path)
    saved = df.sparkSession.read.parquet(path)
    saved.createOrReplaceTempView(name)
    return saved


def save_bucketed(df: DataFrame, name: str, path: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """Write ``df`` as the table ``name`` at ``path``, dealt into ``buckets`` by ``keys`` and sorted by them.

    One file a bucket.  Tables of the same buckets join on these keys, and group by them, without a
    shuffle: for facts that meet the same tables every day.  Choose so many buckets that one fits a task.
    """
    dealt = df.repartition(buckets, *keys)
    writer = dealt.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys)
    writer.option("path", path).format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def open_bucketed(
    spark: SparkSession, name: str, path: str, schema: T.StructType, keys: Sequence[str], buckets: int
) -> DataFrame:
    """The table of ``save_bucketed`` in a session whose catalogue doesn't know it; no file is read."""
    listed = ", ".join(f"`{k}`" for k in keys)
    spark.sql(
        f"CREATE TABLE `{name}` ({schema.toDDL()}) USING parquet CLUSTERED BY ({listed}) SORTED BY ({listed}) "
        f"INTO {int(buckets)} BUCKETS LOCATION '{path}'"
    )
    return spark.table(name)
