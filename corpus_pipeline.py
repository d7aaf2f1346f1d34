"""From raw documents to packed sequences: five stages, each one operator over all rows that the stage before kept.

Every stage but the last returns the columns of documents; other columns go.
Rows with a null doc_id take part in every stage, and a repeated doc_id with
unlike texts is two documents.  Null and empty texts have no words, so the
quality rules reject them.  Equal rows are copies: the near-dedup keeps one.  An
empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import common, decontamination, packing, quality_rules, simhash, substring_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules accept, each judged by itself; equal rows share a verdict."""
    return quality_rules.accepted(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of exact or near copies: the one of the least doc_id, then text hash; null ids come last, repeated rows count once."""
    rows = simhash.similar_rows(docs, shingle=5, similarity=0.8).withColumn("r", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    first = rows.groupBy("root").agg(F.min("r").alias("kept"))
    copies = rows.join(first, "root").where("r <> kept").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).distinct()
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    same = docs["doc_id"].eqNullSafe(copies["id"]) & (docs["text_hash"] == copies["hash"])
    return docs.join(copies, same, "left_anti").dropDuplicates(["doc_id", "text_hash"]).select(*COLUMNS)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that stand earlier; those left without a word go."""
    changed = substring_dedup.substring_dedup(docs).where("n_removed > 0").select(F.col("doc_id").alias("id"), "text_hash", "kept_text").distinct()
    same = docs["doc_id"].eqNullSafe(changed["id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == changed["text_hash"])
    joined = docs.join(changed, same, "left").where("kept_text IS NULL OR kept_text <> ''")
    text = F.coalesce("kept_text", "text")
    return joined.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("kept_text").isNull(), F.col("n_chars")).otherwise(F.length(text)).cast("long").alias("n_chars"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates; null items match nothing."""
    return decontamination.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens, with their ids: what a training run reads.  Each row is a document; a null text has its end id only."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", substrings),
    ("benchmark decontamination", decontaminated),
    ("packing", packed),
]
#: Tokens and fingerprints are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.written(docs, name.replace(" ", "-"))
    return docs
