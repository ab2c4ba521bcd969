"""A corpus from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the
last return the columns of the documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plaudit.llm import jaccard, packing, quality, secrets, toxicity
from plaudit.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Near copies of the pipeline: five words and 0.8; the join's own contract (op9) is three and 0.9.
NEAR = jaccard.Similarity(words=5, percent=80)


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network calls toxic go."""
    return toxicity.keep_civil(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or a compression band go."""
    return quality.keep_good(docs, quality.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return jaccard.keep_first(docs, NEAR)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced inside the texts."""
    return secrets.redact(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in packed sequences."""
    return packing.packed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", civil),
    ("quality_rules", good),
    ("ngram_jaccard", unique),
    ("secret_scans", without_secrets),
    ("best_fit_packing", sequences),
]

#: The network, the compression ratios and the tokenizer have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each result stored as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
