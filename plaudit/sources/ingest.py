"""Raw entities to Parquet: derived time columns, null-key drop, year partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import contracts
from .tables import read_json, write_parquet, write_partitioned

# Entity name -> (declared schema, partition by year?)
ENTITIES: dict[str, tuple[T.StructType, bool]] = {
    "business": (contracts.BUSINESS, False),
    "checkin": (contracts.CHECKIN, False),
    "review": (contracts.REVIEW, True),
    "tip": (contracts.TIP, True),
    "user": (contracts.USER, True),
}


def derive_time(
    df: DataFrame,
    source: str = "date",
    ts: str = "review_ts",
    year: str | None = "review_year",
    month: str | None = None,
) -> DataFrame:
    """Timestamp from a string, with year and month; a malformed string gives nulls."""
    out = df.withColumn(ts, F.try_to_timestamp(F.col(source)))
    if year:
        out = out.withColumn(year, F.year(ts))
    if month:
        out = out.withColumn(month, F.month(ts))
    return out


def drop_null_keys(df: DataFrame, keys: Sequence[str] = ("user_id", "stars", "review_ts")) -> DataFrame:
    return df.na.drop(subset=list(keys))


def ingest_reviews(spark: SparkSession, source: str, target: str) -> None:
    reviews = derive_time(read_json(spark, source, contracts.REVIEW))
    write_partitioned(reviews, target, ["review_year"])


def ingest_users(spark: SparkSession, source: str, target: str) -> None:
    users = derive_time(
        read_json(spark, source, contracts.USER), "yelping_since", "yelping_since_ts", "yelping_year"
    )
    write_partitioned(users, target, ["yelping_year"])


def ingest_for_credibility(spark: SparkSession, source: str, target: str) -> None:
    """Only what the time-series jobs need: user, stars and time, by year and month."""
    reviews = read_json(spark, source, contracts.REVIEW).select("user_id", "stars", "date")
    timed = drop_null_keys(derive_time(reviews, year="year", month="month"))
    write_partitioned(timed, target, ["year", "month"])


def with_year(df: DataFrame) -> DataFrame:
    """``year`` from ``date`` or ``yelping_since``; unchanged when neither exists."""
    for source in ("date", "yelping_since"):
        if source in df.columns:
            day = F.to_date(F.try_to_timestamp(F.col(source)))
            return df.withColumn("year", F.year(day))
    return df


def load_entity(spark: SparkSession, name: str, source: str, target: str) -> DataFrame:
    """One raw entity as JSON lines to Parquet, by year where the entity has a date."""
    schema, yearly = ENTITIES[name]
    df = read_json(spark, source, schema)
    timed = with_year(df) if yearly else df
    if "year" in timed.columns:
        write_partitioned(timed, target, ["year"])
    else:
        write_parquet(timed, target)
    return spark.read.parquet(target)


def load_all(spark: SparkSession, sources: dict[str, str], target_root: str) -> dict[str, DataFrame]:
    return {
        name: load_entity(spark, name, path, f"{target_root}/{name}") for name, path in sources.items()
    }
