"""Scores from extracted (aspect term, sentiment) lists, and the hook for an external scorer."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vocab


def bucket_exact(term: Column, buckets: vocab.Vocabulary = vocab.BUCKETS_EXACT) -> Column:
    low = F.lower(term)
    out = None
    for name, words in buckets.items():
        hit = low.isin(list(words))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def bucket_loose(
    term: Column,
    buckets: vocab.Vocabulary = vocab.BUCKETS_LOOSE,
    fragments: vocab.Vocabulary = vocab.BUCKET_FRAGMENTS,
) -> Column:
    """Exact match after cutting one trailing ``s``, then the fragments, in bucket order."""
    low = F.regexp_replace(F.trim(F.lower(term)), "s$", "")
    out = None
    for name, words in buckets.items():
        hit = low.isin(list(words))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    for name, parts in fragments.items():
        hit = F.lit(False)
        for part in parts:
            hit = hit | low.contains(part)
        out = out.when(hit, name)
    return out


def _sign(label: Column, anywhere: bool) -> Column:
    low = F.lower(label)
    test = (lambda s: low.contains(s)) if anywhere else (lambda s: low.startswith(s))
    return F.when(test("pos"), 1.0).when(test("neg"), -1.0).otherwise(0.0)


def bucket_scores(
    extracted: DataFrame,
    reduce: str = "sum",
    aspect: str = "aspect",
    sentiment: str = "sentiment",
    aspects: tuple[str, ...] = ("food", "service", "price", "amb"),
) -> DataFrame:
    """Replaces the two lists by ``aspect_<a>`` scores and term lists.

    ``reduce="sum"``: exact buckets, signs added up, ``<a>_pos_terms`` lists the positive terms.
    ``reduce="mean"``: loose buckets, signs averaged, ``<a>_terms`` lists all terms.
    Row-local: a review's terms never leave their row.
    """
    bucket = bucket_exact if reduce == "sum" else bucket_loose
    marked = F.transform(
        F.arrays_zip(F.col(aspect).alias("term"), F.col(sentiment).alias("label")),
        lambda z: F.struct(
            z["term"].alias("term"),
            bucket(z["term"]).alias("bucket"),
            _sign(z["label"], anywhere=reduce == "mean").alias("sign"),
        ),
    )
    shortest = F.least(F.size(aspect), F.size(sentiment))
    zipped = F.when(shortest > 0, F.slice(marked, 1, F.greatest(shortest, F.lit(1))))
    rows = extracted.withColumn("__marks", F.coalesce(zipped, F.array()))

    def of(name: str) -> Column:
        return F.filter("__marks", lambda m: m["bucket"] == name)

    columns = []
    for name in aspects:
        total = F.aggregate(of(name), F.lit(0.0), lambda acc, m: acc + m["sign"])
        if reduce == "mean":
            total = F.coalesce(F.try_divide(total, F.size(of(name))), F.lit(0.0))
        columns.append(total.alias(f"aspect_{name}"))
    for name in aspects:
        if reduce == "sum":
            listed = F.filter(of(name), lambda m: m["sign"] > 0)
            columns.append(F.transform(listed, lambda m: m["term"]).alias(f"{name}_pos_terms"))
        else:
            columns.append(F.transform(of(name), lambda m: m["term"]).alias(f"{name}_terms"))
    kept = [c for c in extracted.columns if c not in (aspect, sentiment)]
    return rows.select(*kept, *columns)


EXTRACTED = T.StructType(
    [
        T.StructField("aspect", T.ArrayType(T.StringType())),
        T.StructField("sentiment", T.ArrayType(T.StringType())),
    ]
)


_ASCII_WORD = re.compile("[a-z]+")
_BUCKETED = frozenset(w for words in vocab.BUCKETS_EXACT.values() for w in words)
_PLUS, _MINUS = frozenset(vocab.LEXICON_POSITIVE), frozenset(vocab.LEXICON_NEGATIVE)


def keyword_scorer(texts: list[str]) -> list[dict[str, list[str]]]:
    """Stand-in for a model: bucket words found in a text, all labelled by its opinion words."""
    out = []
    for text in texts:
        low = text.lower()
        # The letters of ASCII are known; other texts are asked letter by letter.
        words = _ASCII_WORD.findall(low) if low.isascii() else "".join(c if c.isalpha() else " " for c in low).split()
        balance = sum((w in _PLUS) - (w in _MINUS) for w in words)
        label = "Positive" if balance > 0 else "Negative" if balance < 0 else "Neutral"
        found = [w for w in words if w in _BUCKETED]
        out.append({"aspect": found, "sentiment": [label] * len(found)})
    return out


def batch_extract(
    reviews: DataFrame,
    load: Callable[[], Callable[[list[str]], list[dict[str, list[str]]]]] = lambda: keyword_scorer,
    text: str = "text",
    batch: int = 16,
) -> DataFrame:
    """Adds (aspect, sentiment) lists from a user's scorer, called with ``batch`` texts at a time.

    ``load`` runs once per task, on the executor, and returns the scorer; a model is never
    shipped from the driver.  Arrow batches stream through, so a task holds one batch.
    """
    schema = T.StructType([*reviews.schema.fields, *EXTRACTED.fields])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = None
        for frame in frames:
            scorer = scorer or load()
            texts = frame[text].fillna("").tolist()
            results: list[dict[str, list[str]]] = []
            for at in range(0, len(texts), batch):
                results.extend(scorer(texts[at : at + batch]))
            yield frame.assign(
                aspect=[r.get("aspect") or [] for r in results],
                sentiment=[r.get("sentiment") or [] for r in results],
            )

    return reviews.mapInPandas(run, schema)
