"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.conversation_trie import ORACLE as TRIE_SQL
from tessella.llm.decontamination import ORACLE as DECONTAMINATION_SQL
from tessella.llm.lexical_search import ORACLE as SEARCH_SQL
from tessella.llm.license_scan import oracle as license_sql
from tessella.llm.mixing import ORACLE as MIXING_SQL
from tessella.llm.substring import ORACLE as SUBSTRING_SQL
from tessella.llm.topk import ORACLE as TOPK_SQL


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies, on the driver and on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document: see quality_classifier.classify."""
    from tessella.llm.quality_classifier import classify

    return classify(documents(spark, sf_dir), labels(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and licences of every document: see license_scan.scan."""
    from tessella.llm.license_scan import scan

    return scan(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document: see substring.digest."""
    from tessella.llm.substring import digest

    return digest(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files: see token_store."""
    from tessella.llm.token_store import round_trip

    return round_trip(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json")).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document: see simhash.near_duplicates."""
    from tessella.llm.simhash import near_duplicates

    out = near_duplicates(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op6_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per piece of every document: see packing.pack."""
    from tessella.llm.packing import pack

    return pack(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score for every fiftieth vector: see topk.top_k."""
    from tessella.llm.topk import top_k

    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0).withColumnRenamed("id", "vec_id")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures and verdict of every document: see quality_rules.judge."""
    from tessella.llm.quality_rules import judge

    out = judge(documents(spark, sf_dir), labels(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document: see mixing.mix."""
    from tessella.llm.mixing import mix

    return mix(documents(spark, sf_dir).select("doc_id", "text", "source")).select("doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.copies") * F.col("mix.size")).alias("taken"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted, language_threshold, flagged of every document: see toxicity.classify."""
    from tessella.llm.toxicity import classify

    return classify(documents(spark, sf_dir), labels(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document: see decontamination.report."""
    from tessella.llm.decontamination import report

    return report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).withColumnRenamed("id", "doc_id")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, rank, doc_id, score of the 50 best documents for every benchmark item: see lexical_search.search."""
    from tessella.llm.lexical_search import build, search

    found = search(build(documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.withColumnsRenamed({"item": "item_id", "id": "doc_id"})


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per node of the trie of all rebuilt conversations: see conversation_trie.trie."""
    from tessella.llm.conversation_trie import conversations, trie, with_shared_starts

    return trie(with_shared_starts(conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_license_scan, op3_substring_dedup, op4_token_store, op5_simhash_near_dedup, op6_cost_balanced_packing, op7_exact_topk, op8_quality_rules, op9_source_mixing, op10_toxicity, op11_benchmark_decontamination, op12_ranked_search, op13_conversation_trie)}

ORACLES: dict[str, str] = {"op2_license_scan": license_sql(), "op3_substring_dedup": SUBSTRING_SQL, "op7_exact_topk": TOPK_SQL, "op9_source_mixing": MIXING_SQL, "op11_benchmark_decontamination": DECONTAMINATION_SQL, "op12_ranked_search": SEARCH_SQL, "op13_conversation_trie": TRIE_SQL}
