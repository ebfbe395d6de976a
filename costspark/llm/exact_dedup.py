"""Equal texts found by their recipes of content-defined chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costspark.runtime import materialise, scratch_path


def chunks_of(text: Column, smallest: int = 512, largest: int = 4096) -> Column:
    """``text`` cut after a sentence or line end, so that a cut depends on what stands beside it.

    A chunk has at least ``smallest`` code points before its cut and at most ``largest``;
    chunks joined give the text back, and an empty text has none.
    """
    pattern = rf"(?s).{{{smallest},{largest - 2}}}?(?:[.!?;:,][ \n]|\n)|.{{1,{largest}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def chunk_hash(chunk: Column) -> Column:
    return F.unhex(F.md5(chunk))


def _recipes(rows: DataFrame, hashed: Callable[[Column], Column], **sizes: int) -> DataFrame:
    """``rows`` (id, text, sha) with ``recipe``, the ordered identifiers of the chunks, without the text.

    A hash names a chunk once it is known that no two different chunks share it; where
    they do, the chunks of that hash are numbered and the number becomes part of the name.
    """
    spark = rows.sparkSession
    pieces = rows.select("id", "sha", F.posexplode(chunks_of(F.col("text"), **sizes)).alias("at", "chunk")).withColumn(
        "hash", hashed(F.col("chunk"))
    )
    contents = pieces.select("hash", "chunk").distinct()
    shared = materialise(
        contents.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"),
        scratch_path(spark, "shared-hashes"),
    )
    if shared.isEmpty():
        named = F.transform(chunks_of(F.col("text"), **sizes), hashed)
        return rows.select("id", "sha", named.alias("recipe"))
    in_hash = Window.partitionBy("hash").orderBy("chunk")
    numbers = materialise(
        contents.join(shared, "hash").withColumn("number", F.row_number().over(in_hash)),
        scratch_path(spark, "chunk-numbers"),
    )
    name = F.concat("hash", F.encode(F.coalesce(F.col("number"), F.lit(1)).cast("string"), "utf-8"))
    listed = (
        pieces.join(numbers, ["hash", "chunk"], "left")
        .groupBy("sha")
        .agg(F.array_sort(F.collect_set(F.struct("at", name.alias("name")))).alias("list"))
        .select(F.col("sha").alias("of"), F.col("list.name").alias("recipe"))
    )
    empty = F.array().cast("array<binary>")
    return rows.join(listed, F.col("sha") == F.col("of"), "left").select(
        "id", "sha", F.coalesce("recipe", empty).alias("recipe")
    )


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    hashed: Callable[[Column], Column] = chunk_hash,
    **sizes: int,
) -> DataFrame:
    """Mark one row of every group of equal texts.

    Returns ``id_col``, ``keep_id`` (the largest id of the group), ``group_size`` (rows),
    ``kept`` and ``text_sha256``, one row per row of ``docs``.  A null text equals an empty
    one.  Rows that repeat the kept id are one document and are all kept; in a group
    without any id all rows are kept.

    The text moves once, cut into chunks, to find out that each chunk hash stands for one
    content; after that only recipes move (16 bytes a chunk).  Groups are counted map-side
    first and only those of two and more are joined back, from a table, so that Spark can
    split a group with a third of all rows.  ``hashed`` may be weak: shared hashes are resolved.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn(
        "sha", F.sha2("text", 256)
    )
    recipes = _recipes(rows, hashed, **sizes)
    groups = materialise(
        recipes.groupBy("recipe").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1"),
        scratch_path(docs.sparkSession, "copy-groups"),
    ).withColumnRenamed("recipe", "group")
    return recipes.join(groups, F.col("recipe") == F.col("group"), "left").select(
        F.col("id").alias(id_col),
        F.coalesce("keep_id", "id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.col("id").eqNullSafe(F.coalesce("keep_id", "id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
