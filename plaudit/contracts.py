"""Declared schemas of the raw inputs, and column contracts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


_TYPES = {
    "STRING": T.StringType(),
    "DOUBLE": T.DoubleType(),
    "BIGINT": T.LongType(),
    "INT": T.IntegerType(),
    "TEXTMAP": T.MapType(T.StringType(), T.StringType()),
}


def _struct(spec: str) -> T.StructType:
    """A flat schema from ``name TYPE`` pairs, usable before any session exists."""
    pairs = [field.split() for field in spec.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


REVIEW = _struct(
    "review_id STRING, user_id STRING, business_id STRING, stars DOUBLE, useful BIGINT, "
    "funny BIGINT, cool BIGINT, text STRING, date STRING"
)
BUSINESS = _struct(
    "business_id STRING, name STRING, address STRING, city STRING, state STRING, "
    "postal_code STRING, latitude DOUBLE, longitude DOUBLE, stars DOUBLE, review_count BIGINT, "
    "is_open BIGINT, categories STRING, attributes TEXTMAP"
)
USER = _struct(
    "user_id STRING, name STRING, yelping_since STRING, review_count BIGINT, average_stars DOUBLE"
)
CHECKIN = _struct("business_id STRING, date STRING")
TIP = _struct(
    "business_id STRING, user_id STRING, text STRING, date STRING, compliment_count BIGINT"
)

CLUSTERED = _struct(
    "business_id BIGINT, name STRING, city STRING, state STRING, categories STRING, "
    "food DOUBLE, service DOUBLE, price DOUBLE, amb DOUBLE, cluster INT, "
    "n_reviews_sample BIGINT, n_users_sample BIGINT, cover_food_frac DOUBLE, "
    "cover_service_frac DOUBLE, cover_price_frac DOUBLE, cover_amb_frac DOUBLE, "
    "stars DOUBLE, review_count BIGINT"
)


class MissingColumns(ValueError):
    """A job was handed a table without a column it needs."""


def require_columns(df: DataFrame, needed: Iterable[str], what: str = "table") -> DataFrame:
    """Fail before planning when ``df`` lacks a needed column; returns ``df`` for chaining."""
    absent = sorted(set(needed) - set(df.columns))
    if absent:
        raise MissingColumns(f"{what} lacks {absent}; it has {df.columns}")
    return df


def id_columns(tables: dict[str, DataFrame]) -> dict[str, list[str]]:
    """Join-key discovery: per table, the columns whose name contains ``id``."""
    return {name: [c for c in df.columns if "id" in c.lower()] for name, df in tables.items()}
