"""The operators of this folder over their whole tables, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from plaudit.llm import bpe, chat, digests, jaccard, language, mixing, packing, quality, repair, secrets, toxicity, trie, variants
from plaudit.llm.batches import documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.compare_with_next(documents(spark, sf_dir))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With one more conversation whose texts look like control strings."""
    odd = r"\### Assistant: </turn> ok"
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.as_chains(rows.unionByName(more)))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.quality(docs, quality.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir))


def op6_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out documents teach nothing."""
    docs = documents(spark, sf_dir)
    held_out = toxicity.is_held_out()
    found = language.languages(docs, docs.where(~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_groups(documents(spark, sf_dir))


def op10_repair_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.read_back(repair.shards(documents(spark, sf_dir)))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(documents(spark, sf_dir))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_secret_scans, op2_document_fingerprints, op3_chat_formatting, op4_quality_rules, op5_best_fit_packing,
        op6_bpe_tree, op7_toxicity, op8_language_id, op9_ngram_jaccard, op10_repair_output, op11_prefix_trie,
        op12_source_mixing, op13_spelling_variants,
    )
} | {"pipeline": corpus_pipeline.run}
