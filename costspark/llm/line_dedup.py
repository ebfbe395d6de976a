"""Lines that occur in many documents, dropped from all of them."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costspark.runtime import materialise, scratch_path

# The characters stripped at both ends of a line before it is compared.
STRIPPED = " \t\n\x0b\f\r"


def line_key(line):
    """A line as it is compared: ends stripped, A-Z in lower case, other letters as they are."""
    return F.translate(F.btrim(line, F.lit(STRIPPED)), string.ascii_uppercase, string.ascii_lowercase)


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1
) -> DataFrame:
    """Drop every line whose key is found in at least ``min_docs`` documents.

    Returns ``id_col``, ``n_lines``, ``n_dropped`` and ``kept_text``, one row per row of
    ``docs``.  A null or empty text is one empty line; keys under ``min_chars`` code
    points are never dropped; a text whose lines all go becomes empty.  Rows that repeat an
    id count as one document; a row without an id adds to no count but loses lines too.

    Lines are exploded and hashed (128 bits), and a hash counts its distinct documents: a
    line in a third of all documents is counted in two combining steps.  Only positions
    come back to the documents, whose text moves once.
    """
    spark = docs.sparkSession
    base = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ).withColumn("version", F.xxhash64("text"))
    lines = (
        base.select("id", "version", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
        .select("id", "version", "at", line_key("line").alias("key"))
        .where(F.length("key") >= min_chars)
        .select("id", "version", "at", F.unhex(F.md5("key")).alias("hash"))
    )
    # Written: a join with a table, unlike one with an aggregate, lets Spark split a hot hash.
    common = materialise(
        lines.groupBy("hash").agg(F.countDistinct("id").alias("n")).where(F.col("n") >= min_docs).select("hash"),
        scratch_path(spark, "common-lines"),
    )
    drops = lines.join(common, "hash").groupBy("id", "version").agg(F.collect_set("at").alias("drop"))
    texts = base.select("id", "version", F.split("text", "\n", -1).alias("lines"))
    found = texts.join(
        drops.withColumnsRenamed({"id": "drop_id", "version": "drop_version"}),
        F.col("id").eqNullSafe(F.col("drop_id")) & (F.col("version") == F.col("drop_version")),
        "left",
    )
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    return found.select(
        F.col("id").alias(id_col),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
        F.array_join(
            F.when(F.col("drop").isNull(), F.col("lines")).otherwise(F.transform(stay, lambda i: F.get("lines", i))),
            "\n",
        ).alias("kept_text"),
    )
