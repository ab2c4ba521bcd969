"""The registered queries of the llm folder, and the pipeline."""

import compare
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from plaudit.llm import jaccard, packing, quality, secrets
from plaudit.llm.oracle import SQL
from plaudit.llm.queries import QUERIES


def test_contract():
    assert [f"op{n}" for n in range(1, 14)] == [q.split("_")[0] for q in QUERIES if q != "pipeline"]
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, name):
    assert compare.difference(QUERIES[name](spark, sf), compare.connect(sf), SQL[name]) is None


def test_pipeline(spark, sf):
    """Every stage does what its operator says on what the stage before it kept."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, sf).cache()
        assert out.columns == docs.columns
        ids, before = {r.doc_id for r in out.collect()}, {r.doc_id for r in seen.collect()}
        if name == "quality_rules":
            assert ids == {r.doc_id for r in quality.quality(seen, quality.fitted(seen, spark.read.parquet(f"{sf}/labels.parquet"))).where("kept").collect()}
        if name == "ngram_jaccard":
            assert ids == {r.component_id for r in jaccard.near_groups(seen, corpus_pipeline.NEAR).collect()}
        if name == "secret_scans":
            assert ids == before and secrets.scan(out).agg({"n_hex": "sum", "n_access": "sum"}).first()[0] == 0
        assert ids <= before and len(ids) > 0.5 * len(before)
        seen = out
    run = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in run.select("doc_id").collect()} == {r.doc_id for r in seen.collect()}
    assert sorted(run.columns) == sorted(packing.packed(docs.limit(1)).columns)


def test_pipeline_finds_near_copies_of_five_words_and_080(spark, sf):
    """One edit per fifty words: 0.82 over five words, under 0.9 over three; 0.77 is no near copy."""
    words = [f"w{i}" for i in range(200)]
    near = [("x" if i % 50 == 25 else w) for i, w in enumerate(words)]
    far = [("y" if i % 40 == 20 else w) for i, w in enumerate(words)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate((words, near, far))], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.unique(spark, docs, sf).collect()} == {0, 2}
