"""Every query must equal DuckDB."""

import compare
import pytest

import __spark_entry__ as entry
from plaudit.plans.catalog import QUERIES
from plaudit.plans.oracle import SQL


@pytest.fixture(scope="module")
def duck(sf):
    return compare.connect(sf)


def test_contract(spark):
    assert set(SQL) <= set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    assert set(QUERIES) == set(SQL)
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, duck, name):
    assert compare.difference(QUERIES[name](spark, sf), duck, SQL[name]) is None


# The queries whose joins would be broadcast on small data: here they take the salted way.
JOINED = ["enrich_reviews", "absa_flat", "join_weights", "restaurant_vectors", "polarity_hits", "weighted_scores", "aspect_map_apply", "language_assign"]


@pytest.mark.parametrize("name", JOINED)
def test_equals_sql_without_broadcast(spark, sf, duck, name):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        assert compare.difference(QUERIES[name](spark, sf), duck, SQL[name]) is None
    finally:
        spark.conf.set(key, before)

