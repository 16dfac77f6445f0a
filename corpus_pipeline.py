"""A training corpus in five stages, each one of the operators of specweave.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of
documents: doc_id, text, lang, source, n_chars.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specweave.llm import decontaminate, mixing, quality, sharding, simhash
from specweave.llm.common import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SHARDS = 24


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the adaptive thresholds keep."""
    return quality.quality(docs).filter("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id. Texts
    link if their sets of five-word shingles have a Jaccard similarity of 0.8, or if their
    fingerprints differ in six bits at most."""
    return simhash.drop_near_duplicates(docs, shingle=5, max_bits=6, percent=80).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their benchmark passages; documents that are mostly such passages go.
    n_chars follows the text."""
    clean = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = F.col("contaminated") & F.col("clean_text").isNull()
    text = F.when(F.col("contaminated"), F.col("clean_text")).otherwise(F.col("text"))
    n_chars = F.when(F.col("contaminated"), F.length("clean_text").cast("long")).otherwise(F.col("n_chars"))
    return clean.filter(~gone).select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources, a row for each taken copy of a document."""
    return mixing.expanded(mixing.mix(docs, mixing.cyclic_weights(docs))).select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each copy with its shard and its slot in it."""
    return sharding.pack(docs, shards=SHARDS).select(*COLUMNS, "size", "tokens", "text_crc32", "shard", "slot")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("mix_sources", mix_sources),
    ("shard", shard),
]

#: Fingerprints, automata and vector packing have no SQL form; the tests hold the stages
#: against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
