"""The corpus pipeline: quality rules, line dedup, SimHash near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and gets what its predecessor kept; `run` writes every stage to the shared folder
and reads it back. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm import common, lines, mixing, overlaps, packing, rules

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go. The text is hashed once to find its verdict again."""
    rows = docs.select(*COLUMNS)
    judged = rules.quality_rules(rows.withColumn("text_hash", F.xxhash64("text")), carry=("text_hash",))
    rejected = judged.where(~F.col("kept")).select("doc_id", "text_hash").distinct()
    return rows.withColumn("text_hash", F.xxhash64("text")).join(
        rejected.select(F.col("doc_id").alias("id_out"), F.col("text_hash").alias("hash_out")),
        F.col("doc_id").eqNullSafe(F.col("id_out")) & (F.col("text_hash") == F.col("hash_out")), "left_anti").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; every document stays, with what is left of it."""
    out = lines.line_dedup(docs.select(*COLUMNS), carry=("lang", "source"))
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source",
                      F.char_length("kept_text").cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word Jaccard of 0.8 or more) stays: the one with the smallest id, null ids last,
    equal ids by the hash of the text. Of rows that repeat both, the one with the least (lang, source, n_chars) stays."""
    rows = docs.select(*COLUMNS).withColumn("key", overlaps.class_key(F.col("text")))
    grouped = overlaps.near_copies(docs.select("doc_id", "text"))
    # what is not simply kept: rows that go, and rows that stay but stand there several times
    marked = grouped.groupBy("doc_id", "key").agg(F.first("stays").alias("stays"), F.count(F.lit(1)).alias("n"))
    marked = common.stored(marked.where("not stays or n > 1").select(
        F.col("doc_id").alias("marked_id"), F.col("key").alias("marked_key"), "stays"), "marked")
    same = F.col("doc_id").eqNullSafe(F.col("marked_id")) & (F.col("key") == F.col("marked_key"))
    several = rows.join(marked.where("stays"), same, "left_semi").groupBy("doc_id", "key").agg(
        F.min(F.struct("lang", "source", "n_chars", "text")).alias("least")).select(
        "doc_id", "least.text", "least.lang", "least.source", "least.n_chars")
    return rows.join(marked, same, "left_anti").select(*COLUMNS).unionByName(several)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as it takes them, shard by shard."""
    mixed = mixing.mix(docs.select(*COLUMNS), carry=("text", "lang", "n_chars"))
    return mixing.mixed_rows(mixed, COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [("quality rules", quality), ("line dedup", line_dedup), ("simhash near-dedup", near_dedup),
          ("mixing sources to target weights", mix_sources), ("packing", pack)]

# The outlier estimate, similarities and tokens are beyond SQL: tests/llm compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
