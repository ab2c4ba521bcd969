"""Projections, filters and joins that bring reviews, businesses and users together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vocab import DOMAIN_REGEX
from ..scale import join_dimension

# The curated business columns and their names in the enriched table.
BUSINESS_COLUMNS = [
    ("business_id", "business_id"),
    ("name", "biz_name"),
    ("city", "biz_city"),
    ("state", "biz_state"),
    ("postal_code", "biz_postal_code"),
    ("latitude", "biz_latitude"),
    ("longitude", "biz_longitude"),
    ("stars", "biz_stars"),
    ("review_count", "biz_review_count"),
    ("is_open", "biz_is_open"),
    ("categories", "biz_categories"),
    ("address", "biz_address"),
]


def select_present(df: DataFrame, wanted: Sequence[str | tuple[str, str]]) -> DataFrame:
    """The wanted columns that exist, renamed where a pair is given; absent ones are skipped."""
    pairs = [(w, w) if isinstance(w, str) else w for w in wanted]
    return df.select(*[F.col(src).alias(name) for src, name in pairs if src in df.columns])


def select_business(business: DataFrame) -> DataFrame:
    return select_present(business, BUSINESS_COLUMNS)


def enrich_reviews(reviews: DataFrame, business: DataFrame) -> DataFrame:
    """Every review with the columns of its business."""
    spread = [c for c in ("review_id", "user_id") if c in reviews.columns]
    return join_dimension(reviews, select_business(business), "business_id", spread=spread or None)


def filter_category(
    df: DataFrame, column: str = "categories", word: str = "restaurants", mode: str = "contains"
) -> DataFrame:
    """Case-insensitive category filter.  ``mode="suffix"`` keeps a row only when the list of
    categories ends with the word, which also asks it to be the last one."""
    pattern = {"contains": f"%{word}%", "suffix": f"%{word}"}[mode]
    return df.where(F.lower(F.col(column)).like(pattern))


def filter_domain(df: DataFrame, column: str = "categories", regex: str = DOMAIN_REGEX) -> DataFrame:
    return df.where(F.col(column).isNotNull() & F.col(column).rlike(regex))


def recent_top_rated(df: DataFrame, since: int = 2018, stars: float = 5) -> DataFrame:
    return df.where((F.col("review_year") >= since) & (F.col("stars") == stars))


def top_counts(df: DataFrame, key: str, k: int, name: str = "count") -> DataFrame:
    """The ``k`` most frequent values; equal counts in order of the value."""
    return (
        df.groupBy(key)
        .agg(F.count(F.lit(1)).alias(name))
        .orderBy(F.desc(name), F.asc(key))
        .limit(k)
    )


def preview(df: DataFrame, text: str = "text", ids: Sequence[str] = ("review_id", "user_id", "business_id")) -> DataFrame:
    """Display projection: text cut to 25 characters, ids to 10."""
    widths = {text: 25, **{c: 10 for c in ids}}
    return df.select(
        *[
            F.substring(F.col(c).cast("string"), 1, widths[c]).alias(c) if c in widths else F.col(c)
            for c in df.columns
        ]
    )


def has_field(df: DataFrame, column: str, field: str, name: str) -> DataFrame:
    """Whether a nested field is set: struct, map or JSON text."""
    kind = df.schema[column].dataType.typeName()
    if kind == "string":
        value = F.get_json_object(column, f"$.{field}")
    else:
        value = F.col(column).getField(field) if kind == "struct" else F.col(column).getItem(field)
    return df.withColumn(name, value.isNotNull())


def absa_ready(
    reviews: DataFrame, business: DataFrame, users: DataFrame, regex: str = DOMAIN_REGEX
) -> DataFrame:
    """Reviews of businesses in the domain, with the author's own statistics."""
    places = filter_domain(business, regex=regex).select("business_id", "name", "city", "state")
    people = users.select("user_id", "review_count", "average_stars")
    spread = ["review_id"] if "review_id" in reviews.columns else None
    at_place = join_dimension(reviews, places, "business_id", "inner", spread=spread)
    joined = join_dimension(
        at_place, people, "user_id", "left", spread=spread
    )
    keep = [
        "review_id", "business_id", "name", "city", "state", "user_id", "review_count",
        "average_stars", "stars", "text", "date", "review_ts",
    ]
    return select_present(joined, keep)


def absa_flat(
    ready: DataFrame, business: DataFrame
) -> DataFrame:
    """Adds business metadata under names that do not clash; text in lower case."""
    places = select_present(
        business,
        [
            "business_id", "categories", "latitude", "longitude",
            ("stars", "biz_stars"), ("review_count", "biz_review_count"),
        ],
    )
    renamed = ready.withColumnsRenamed({"stars": "review_stars", "review_count": "user_review_count"})
    spread = ["review_id"] if "review_id" in ready.columns else None
    joined = join_dimension(renamed, places, "business_id", spread=spread)
    keep = [
        "review_id", "business_id", "name", "city", "state", "categories", "review_stars",
        "user_review_count", "average_stars", "text", "date", "review_ts", "user_id", "latitude",
        "longitude", "biz_stars", "biz_review_count",
    ]
    return select_present(joined, keep).withColumn("text", F.lower("text"))


def dedup_rows(df: DataFrame) -> DataFrame:
    """Full-row duplicates out; copies collapse within each task before the shuffle."""
    return df.dropDuplicates()


def distinct_values(df: DataFrame, column: str, k: int | None = None) -> DataFrame:
    """Sorted distinct values for a selector, all of them or the first ``k``."""
    values = df.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column)
    return values if k is None else values.limit(k)


def profile(df: DataFrame, exact: Sequence[str] = ()) -> DataFrame:
    """Per column: rows, non-null values, distinct values, in one pass.

    Distinct values are estimated, but counted exactly for the columns named in ``exact`` (keys and
    other short columns: each of them shuffles its values).
    """
    each = []
    for c in df.columns:
        distinct = F.count_distinct(c) if c in exact else F.approx_count_distinct(c)
        each += [F.count(c).alias(f"n_{c}"), distinct.alias(f"d_{c}")]
    counted = df.agg(F.count(F.lit(1)).alias("rows"), *each)
    out = counted.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column_name"), F.col("rows").alias("row_count"),
                        F.col(f"n_{c}").alias("non_null"), F.col(f"d_{c}").alias("distinct_values"),
                    )
                    for c in df.columns
                ]
            )
        )
    )
    return out
