"""Co-located tables, the ledger of stages, the weight state and exact heavy hitters."""

import json
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plaudit import session
from plaudit.operators import credibility, heavyhitters, sketches, weightstate
from plaudit.plans.ledger import Ledger
from plaudit.session import materialize, scratch, shared_dir
from plaudit.sources import colocated, variant

# -- co-located tables ---------------------------------------------------------------------------


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def ratings(spark):
    rng = random.Random(1)
    users = [None] * 50 + [1] * 400 + [rng.randint(2, 5000) for _ in range(3000)]
    return spark.createDataFrame([(i, u, float(rng.randint(1, 5))) for i, u in enumerate(users)], "review_id long, user_id long, stars double")


def test_join_and_regroup_without_shuffle(spark, no_broadcast):
    rows = ratings(spark)
    stored = colocated.store(rows, "user_id", 6, "ratings")
    assert {r.user_id for r in stored.hot.select("user_id").distinct().collect()} == {None, 1}
    weights = stored.per_key(credibility.reviewer_weights, "weights")
    grouped = stored.light.groupBy("user_id").agg(F.sum("stars"))
    joined = stored.light.join(weights.light, "user_id", "left")
    again = joined.groupBy("user_id").agg(F.sum("w_user"))
    for df in (grouped, joined, again):
        df.collect()
        assert "Exchange" not in plan_of(df)
    assert "SortMergeJoin" in plan_of(joined)
    plain = rows.join(credibility.reviewer_weights(rows), "user_id", "left")
    rounded = lambda df: {(r.review_id, r.user_id, r.stars, r.w_user and round(r.w_user, 9)) for r in df.collect()}
    assert rounded(stored.join(weights)) == rounded(plain)
    weights.drop()
    stored.drop()
    assert not spark.catalog.tableExists(stored.name)


def test_different_layouts_do_not_join(spark):
    one, other = (colocated.store(ratings(spark), "user_id", n, "r") for n in (2, 3))
    with pytest.raises(ValueError):
        one.join(other)


# -- ledger --------------------------------------------------------------------------------------


class Killed(Exception):
    pass


def declared(spark, root, source, built, fail=None, factor=2):
    ledger = Ledger(spark, root)

    def stage(name, build):
        def run():
            built.append(name)
            out = materialize(build(), f"inside-{name}")
            if name == fail:
                raise Killed
            return out

        return run

    ledger.declare("read", stage("read", lambda: spark.read.json(source)), reads=[source])
    ledger.declare("scaled", stage("scaled", lambda: ledger.frame("read").withColumn("x", F.col("x") * factor)), after=["read"], factor=factor)
    ledger.declare("total", stage("total", lambda: ledger.frame("scaled").agg(F.sum("x").alias("x"))), after=["scaled"])
    return ledger


def test_a_killed_run_goes_on(spark, tmp_path):
    source, root, built = str(tmp_path / "in.json"), str(tmp_path / "ledger"), []
    with open(source, "w") as f:
        f.write("".join(json.dumps({"x": i}) + "\n" for i in range(5)))
    before = set(os.listdir(shared_dir(spark)))
    ledger = declared(spark, root, source, built, fail="total")
    assert built == []  # nothing is built before it is asked for
    with pytest.raises(Killed):
        ledger.frame("total")
    assert built == ["total", "scaled", "read"] and not ledger.done("total") and ledger.done("scaled")
    assert set(os.listdir(shared_dir(spark))) == before  # the stages' own tables are gone, also of the failed one
    built.clear()
    assert declared(spark, root, source, built).frame("total").first().x == 20 and built == ["total"]
    built.clear()
    assert declared(spark, root, source, built).frame("total").first().x == 20 and built == []
    # Another parameter: the stage and what follows; another input: everything.
    assert declared(spark, root, source, built, factor=3).frame("total").first().x == 30 and built == ["total", "scaled"]
    built.clear()
    with open(source, "a") as f:
        f.write('{"x": 100}\n')
    last = declared(spark, root, source, built)
    assert last.frame("total").first().x == 220 and built == ["total", "scaled", "read"]
    assert len(last.entries()) == 8 and len(last.clean()) == 5 and {m["stage"] for m in last.entries()} == {"read", "scaled", "total"}
    assert last.frame("total").first().x == 220


def test_rows_without_a_manifest_are_not_done(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    ledger.declare("a", lambda: spark.range(3))
    spark.range(7).write.parquet(f"{ledger._folder('a')}/rows")
    assert not ledger.done("a") and ledger.frame("a").count() == 3
    with pytest.raises(ValueError):
        ledger.declare("a", lambda: spark.range(3))
    with pytest.raises(ValueError):
        ledger.declare("b", lambda: spark.range(3), after=["c"])


def test_scratch_blocks_nest(spark):
    with scratch(spark):
        outer = materialize(spark.range(2), "outer")
        with scratch(spark):
            inner = session.scratch_path(spark, "inner")
            spark.range(1).write.parquet(inner)
        assert not os.path.exists(inner) and outer.count() == 2


# -- weight state --------------------------------------------------------------------------------


def reviews(seed):
    rng = random.Random(seed)
    return [(rng.randint(1, 9), rng.choice([None, 1.0, 2.0, 3.5, 5.0]), 2020 + m // 12, m % 12 + 1, min(7, m // 2 + rng.choice([0, 0, 0, 1, 3])))
            for m in (rng.randint(0, 13) for _ in range(600))]


SCHEMA = "user_id int, stars double, year int, month int, batch int"


def as_set(df):
    return {(r.user_id, r.year, r.month, r.n_reviews, round(r.var_stars, 9), round(r.w_user, 9)) for r in df.collect()}


def test_batches_equal_one_shot(spark, tmp_path):
    df = spark.createDataFrame(reviews(3), SCHEMA)
    path = str(tmp_path / "state")
    for batch in range(8):
        part = df.where(F.col("batch") == batch)
        changed = weightstate.apply_batch(spark, path, part, batch)
        assert changed == part.select("year", "month").distinct().count()
        assert weightstate.apply_batch(spark, path, part, batch) == 0  # again, and nothing happens
    assert as_set(weightstate.weights(spark, path)) == as_set(credibility.monthly_weights(df))
    many = as_set(weightstate.weights(spark, path, 5))
    assert many == as_set(credibility.monthly_weights(df, min_reviews=5))


def test_a_crash_between_two_months(spark, tmp_path):
    """One partition took batch 1 before the crash; the rerun adds it to the other alone."""
    first = spark.createDataFrame([(1, 2.0, 2020, 1), (1, 4.0, 2020, 2)], "user_id int, stars double, year int, month int")
    second = spark.createDataFrame([(1, 5.0, 2020, 1), (2, 1.0, 2020, 2), (None, 1.0, 2020, 2)], first.schema)
    path = str(tmp_path / "state")
    weightstate.apply_batch(spark, path, first, 0)
    weightstate.apply_batch(spark, path, second.where("month = 1"), 1)
    assert weightstate.apply_batch(spark, path, second, 1) == 1
    whole = first.union(second.where("user_id is not null"))
    assert as_set(weightstate.weights(spark, path)) == as_set(credibility.monthly_weights(whole))


# -- heavy hitters -------------------------------------------------------------------------------


@pytest.mark.parametrize("shape, counters", [(1.3, 12), (1.05, 40), (0.0, 8)])
def test_top_keys_are_exact(spark, shape, counters):
    rng = random.Random(int(shape * 100))
    keys = [f"k{int(rng.paretovariate(shape)) if shape else rng.randint(1, 300)}" for _ in range(20_000)] + [None] * 500
    df = spark.createDataFrame([(k,) for k in keys], "w string").repartition(6)
    counts = Counter(k for k in keys if k is not None)
    want = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:4]
    assert [tuple(r) for r in heavyhitters.top_keys(df, "w", 4, counters=counters).collect()] == want


def test_counters_are_bounded_and_miss_what_they_say(spark):
    rng = random.Random(5)
    keys = [str(int(rng.paretovariate(1.1))) for _ in range(30_000)]
    found = heavyhitters.summaries(spark.createDataFrame([(k,) for k in keys], "key string").repartition(3), 50).collect()
    lost = sum(r.lost for r in found)
    counts, counters = Counter(keys), Counter()
    for r in found:
        if r.key is not None:
            counters[r.key] += r.n
    assert len(found) <= 3 * 51 and 0 < lost <= len(keys) / 51
    assert all(0 <= counts[k] - counters[k] <= lost for k in counts)


def test_fewer_keys_than_asked(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "w string")
    assert [tuple(r) for r in heavyhitters.top_keys(df, "w", 5).collect()] == [("a", 1), ("b", 1)]
    assert heavyhitters.top_keys(df.limit(0), "w", 5).collect() == []


# -- sketches ------------------------------------------------------------------------------------


def test_sketches_of_parts_merge(spark, tmp_path):
    rng = random.Random(9)
    rows = [(y, rng.randint(1, 4000), rng.gauss(0, 1) if rng.random() < 0.9 else None, "t") for y in (1, 2, 3) for _ in range(4000)]
    df = spark.createDataFrame(rows, "year int, k int, v double, s string")
    path = str(tmp_path / "s")
    sketches.refresh(df.where("year < 3"), path, "year", ["k", "v", "s"])
    before = {f for _, _, files in os.walk(f"{path}/year=1") for f in files}
    sketches.refresh(df.where("year = 3"), path, "year", ["k", "v", "s"])
    assert before == {f for _, _, files in os.walk(f"{path}/year=1") for f in files}  # other years untouched
    got = {r.column_name: r for r in sketches.merged(spark, path, probs=(0.1, 0.5)).collect()}
    values = sorted(r[2] for r in rows if r[2] is not None)
    assert (got["v"].row_count, got["v"].non_null) == (len(rows), len(values)) and got["s"].quantiles is None
    assert got["k"].distinct_values == pytest.approx(len({r[1] for r in rows}), rel=0.05) and got["s"].distinct_values == 1
    for p, q in zip((0.1, 0.5), got["v"].quantiles):
        rank = sum(x <= q for x in values) / len(values)
        assert abs(rank - p) < 0.03
    one = {r.column_name: r.row_count for r in sketches.merged(spark, path, F.col("year") == 2).collect()}
    assert one == {"k": 4000, "v": 4000, "s": 4000}


def test_sketches_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], "year int, v double")
    sketches.refresh(df, str(tmp_path / "s"), "year", ["v"])
    row = sketches.merged(spark, str(tmp_path / "s")).first()
    assert (row.row_count, row.non_null, row.distinct_values, row.quantiles) == (1, 0, 0, None)


# -- drifting JSON -------------------------------------------------------------------------------


def test_extractor_results_of_all_shapes(spark, tmp_path):
    path = tmp_path / "x.json"
    path.write_text("\n".join([
        '{"sentence": "a", "aspect": ["soup", "tea"], "sentiment": ["Positive", "Neutral"], "confidence": [0.9, 1]}',
        '{"text": "b", "aspect": "soup", "polarity": "Negative", "probs": 0.5, "IOB": ["O"]}',
        '{"text": {"body": "c", "lang": "en"}, "aspect": null, "confidence": "high"}',
        '{"sentence": ["d"], "aspects": []}',
        "", "not json", '["a"]', "{}",
    ]))
    got = [tuple(r) for r in variant.read_drifting(spark, str(path), variant.EXTRACTED).collect()]
    none = (None, None, None, None)
    assert got == [
        ("a", ["soup", "tea"], ["Positive", "Neutral"], [0.9, 1.0], None, None),
        ("b", ["soup"], ["Negative"], [0.5], '{"IOB":["O"]}', None),
        ("c", None, None, None, '{"aspect":null,"confidence":"high"}', None),
        (None, [], None, None, '{"sentence":["d"]}', None),
        (*none, None, "not json"), (*none, None, '["a"]'), (*none, None, None),
    ]
