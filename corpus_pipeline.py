"""A training corpus from raw documents: five stages, each one of the operators on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import mixing, packing, quality_rules, simhash, storage, substring
from tessella.llm.queries import labels, tokenizer_path


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.keep(docs, labels(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, about 0.8 of them alike or more), the one
    of smallest id; null ids stay."""
    return simhash.representatives(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that a document of smaller id has."""
    out = substring.deduped(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, packed into sequences."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), lasting=False).withColumnRenamed("id", "doc_id")


STAGES = [("quality_rules", rules), ("near_duplicates", near_duplicates), ("substring_dedup", substrings), ("mixing", mixture), ("packing", sequences)]

#: Rules with exact binomial bounds, fingerprints and tokens have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written as Parquet and read again as the next one's docs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, storage.stash(stage(spark, docs, sf_dir), name)
        if hasattr(before, "stashed_at"):
            storage.discard(before)
    return docs
