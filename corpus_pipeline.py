"""The corpus pipeline: documents in, packed sequences out, each stage written before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costspark.llm.exact_dedup import exact_dedup
from costspark.llm.near_join import near_join
from costspark.llm.packing import pack
from costspark.llm.secret_scan import redact, secret_spans
from costspark.llm.toxicity import toxicity
from costspark.runtime import materialise, scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifiers call toxic go."""
    scored = toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where("predicted = 0").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: the one with the largest doc_id.

    Rows go by id and text: another text under the same id stays, a copy without an id goes.
    """
    gone = exact_dedup(docs).where(~F.col("kept")).select(F.col("doc_id").alias("_id"), "text_sha256").distinct()
    text = F.sha2(F.coalesce("text", F.lit("")), 256)
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_sha") == F.col("text_sha256"))
    return docs.withColumn("_sha", text).join(gone.hint("merge"), same, "left_anti").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: the one with the smallest doc_id.

    Rows go by id and text, as in ``drop_copies``.
    """
    gone = near_join(docs).where(~F.col("stays")).select(F.col("doc_id").alias("near_id"), F.col("text_hash").alias("near_hash"))
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    rows = rows.withColumn("hash", F.xxhash64(F.coalesce("row.text", F.lit(""))))
    same = (F.col("row.doc_id") == F.col("near_id")) & (F.col("hash") == F.col("near_hash"))
    return rows.join(gone.distinct().hint("merge"), same, "left_anti").select("row.*")


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of the secret scan is replaced by a mark; the documents stay."""
    return redact(docs, secret_spans(docs)).withColumn("n_chars", F.length("text").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, each with its sequence and place there."""
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", hide_secrets),
    ("best-fit packing", pack_sequences),
]

# Toxicity, near duplicates and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage is written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), scratch_path(spark, "stage-" + name.replace(" ", "-")))
    return docs
