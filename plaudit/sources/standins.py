"""Review, business and user tables derived from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scale import join_dimension, spread_small

_ADJ = ["great", "delicious", "friendly", "slow", "overpriced", "cozy", "bland", "good"]
_NOUN = ["food", "pizza", "service", "staff", "price", "value", "music", "decor"]


# One ending per review, so that every kind of pair, of-phrases, lists and plurals occur.
_ENDING = [
    "", " They left the rice cold.", " A host who was so kind and quick.", " The cup of tea was hot and tasted sweet.",
    " Bread and fish were dry but did not taste very bad.", " Really nice waiters, small portions, stale fries.",
    " The clean rooms of the place are quiet and not noisy.", " They make great desserts and keep the tables dirty.",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(words: list[str], k: Column) -> Column:
    out = F.when(k % 8 == 0, words[0])
    for i in range(1, 7):
        out = out.when(k % 8 == i, words[i])
    return out.otherwise(words[7])


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews without their text: user, business, stars and time, straight from the scan."""
    items = table(spark, sf_dir, "lineitem")
    return items.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("review_id"),
        F.col("l_suppkey").alias("user_id"),
        F.col("l_partkey").alias("business_id"),
        (1 + F.floor((F.col("l_quantity") - 1) / 10)).cast("double").alias("stars"),
        F.col("l_shipdate").alias("review_ts"),
        F.year("l_shipdate").alias("review_year"),
        F.month("l_shipdate").alias("review_month"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews with a templated text that needs the name of the business."""
    items = spread_small(
        table(spark, sf_dir, "lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag",
            "l_linestatus", "l_shipdate",
        ),
        "l_orderkey", "l_linenumber",
    )
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    joined = join_dimension(
        items, names, "l_partkey", "inner", spread=["l_orderkey", "l_linenumber", "l_suppkey"]
    )
    order, line, part, supp = (
        F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    )
    text = F.concat(
        F.lit("The "), _pick(_NOUN, part), F.lit(" was "),
        F.when(F.col("l_returnflag") == "R", "not ").otherwise(""),
        F.when(F.col("l_linestatus") == "O", "very ").otherwise(""),
        _pick(_ADJ, line + supp),
        F.lit(". We had "), _pick(_ADJ, order), F.lit(" "), _pick(_NOUN, order + line),
        F.lit("! Also the "), F.split_part("p_name", F.lit(" "), F.lit(2)),
        F.lit(" is "), F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit("."),
        _pick(_ENDING, order + supp),
    )
    return joined.select(
        F.concat_ws("-", order, line, part, supp).alias("review_id"),
        supp.alias("user_id"),
        part.alias("business_id"),
        (1 + F.floor((F.col("l_quantity") - 1) / 10)).cast("double").alias("stars"),
        F.col("l_shipdate").alias("review_ts"),
        F.year("l_shipdate").alias("review_year"),
        F.month("l_shipdate").alias("review_month"),
        text.alias("text"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return spread_small(docs, "doc_id")


def business(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("business_id"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("city"),
        F.col("p_type").alias("state"),
        F.concat("p_name", F.lit(", "), "p_type").alias("categories"),
        (F.col("p_size") % 9 / 2 + 1).cast("double").alias("stars"),
        F.col("p_size").cast("bigint").alias("review_count"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user with the number and mean of their stars."""
    return (
        ratings(spark, sf_dir)
        .groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("review_count"), F.avg("stars").alias("average_stars"))
    )


def order_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reviews: a longer tail of users."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("review_ts")
    )
