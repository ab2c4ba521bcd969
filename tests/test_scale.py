"""Skew-safe joins, samples and quantiles against plain ones."""

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from plaudit import scale
from plaudit.plans.catalog import QUERIES
from plaudit.session import materialize, shared_dir


@pytest.fixture()
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def skewed(spark, n=30_000):
    """A third of the rows on key 0, a third without key, the rest over 5,000 keys."""
    return spark.range(n).select(
        "id",
        F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 3 == 1, F.col("id") % 5000 + 1).alias("k"),
    )


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
@pytest.mark.parametrize("split", [True, False])
def test_join_equals_plain_join(no_broadcast, how, split):
    spark = no_broadcast
    fact = skewed(spark)
    dim = spark.range(0, 4000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    heavy = scale.heavy_keys(fact, ["k"]) if split else None
    got = scale.join_dimension(fact, dim, "k", how, spread=["id"], heavy=heavy)
    want = fact.join(dim, "k", how)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_salts_follow_the_count_of_a_key(spark):
    fact = skewed(spark)
    counts = fact.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    for found in (scale.heavy_keys(fact, ["k"]), scale.heavy_keys(counts, ["k"], count="n")):
        # Half of the rows that have a key, in parts of at most 0.2 %.
        assert [tuple(r) for r in found.collect()] == [(0, 250)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


@pytest.mark.parametrize("name, joins, scans", [("absa_flat", 4, 5), ("enrich_reviews", 1, 2), ("restaurant_vectors", 2, 3)])
def test_chained_joins_do_not_multiply_the_plan(no_broadcast, sf, name, joins, scans):
    """At most two exchanges per join (and one more for an aggregation), one scan per use of a table."""
    plan = plan_of(QUERIES[name](no_broadcast, sf))
    assert plan.count("SortMergeJoin") == joins
    assert plan.count("Exchange hashpartitioning") <= 2 * joins + 2
    assert plan.count("FileScan") <= scans


def test_rows_without_key_are_dealt_out(no_broadcast):
    spark = no_broadcast
    fact = spark.range(4000).select("id", F.when(F.col("id") % 9 == 0, F.col("id")).alias("k"))
    joined = scale.join_dimension(fact, spark.range(5).select(F.col("id").alias("k")), "k", spread=["id"])
    assert "__salt" in plan_of(joined) and joined.count() == 4000


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=3000), np.full(1500, 0.25)])
    df = spark.createDataFrame([(float(v), "g") for v in values], "x double, g string")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    # A coarse sketch, so that brackets and the collapsed lower part are in use.
    rows = scale.exact_quantiles(df, "x", probs, "g", accuracy=200).collect()
    got = {r.p: r.q for r in rows}
    for p in probs:
        assert got[p] == pytest.approx(np.quantile(values, p), abs=1e-12)


def test_hash_sample_ignores_partitioning(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    one = scale.hash_ordered_sample(df.repartition(1), "k", 700).collect()
    many = scale.hash_ordered_sample(df.repartition(7), "k", 700).collect()
    assert len(one) == 700 and sorted(one) == sorted(many)
    assert scale.hash_ordered_sample(df, "k", 9000).count() == 5000
    share = scale.hash_fraction_sample(df, "k", 0.1).count() / 5000
    assert 0.07 < share < 0.13
    assert scale.hash_fraction_sample(df, "k", 1.0).count() == 5000


def test_samples_keep_rows_without_key(spark):
    df = spark.createDataFrame([(None,)] * 5 + [(i,) for i in range(5)], "k long")
    assert scale.hash_ordered_sample(df, "k", 10).count() == 10
    assert scale.hash_fraction_sample(df, "k", 1.0).where("k is null").count() == 5


def test_a_cluster_needs_a_shared_folder():
    for master, fine in (("local[4]", True), ("local", True), ("yarn", False), ("local-cluster[2,1,1024]", False)):
        session = SimpleNamespace(
            conf=SimpleNamespace(get=lambda key, default: None),
            sparkContext=SimpleNamespace(applicationId="none", master=master),
        )
        if fine:
            assert shared_dir(session)
        else:
            with pytest.raises(RuntimeError):
                shared_dir(session)


def test_shared_folder_is_the_one_the_session_names(spark):
    named = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: {"spark.checkpoint.dir": "/shared/x/"}[key]))
    assert shared_dir(named) == "/shared/x"
    kept = materialize(spark.range(10), "t")
    assert kept.count() == 10
    assert shared_dir(spark) in kept.inputFiles()[0]
