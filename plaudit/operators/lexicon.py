"""Sentence-level lexicon scoring: one narrow pass over the reviews, no shuffle, no Python."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.bind import is_in

ASPECTS = ("food", "service", "price", "amb")


def _sentence_facts(
    text: Column, aspects: vocab.Vocabulary, positive: Sequence[str], negative: Sequence[str]
) -> Column:
    """Per sentence that names an aspect: which aspects, and its positive and negative words."""
    # Most words are in no list: one lookup settles them.  Empty sentences name no aspect.
    known = is_in(sorted({*positive, *negative, *(w for terms in aspects.values() for w in terms)}))
    tokens = F.transform(F.split(F.lower(text), "[.!?]+"), lambda s: F.filter(F.regexp_extract_all(s, F.lit("[a-z']+"), F.lit(0)), known))
    facts = F.transform(
        tokens,
        lambda words: F.struct(
            *[
                F.exists(words, is_in(terms)).alias(name)
                for name, terms in aspects.items()
            ],
            F.filter(words, is_in(positive)).alias("pos"),
            F.filter(words, is_in(negative)).alias("neg"),
        ),
    )

    def active(fact: Column) -> Column:
        out = F.lit(False)
        for name in aspects:
            out = out | fact[name]
        return out

    return F.filter(F.coalesce(facts, F.array()), active)


def _hits(aspect: str, side: str) -> Column:
    return F.aggregate(
        F.filter("__facts", lambda f: f[aspect]), F.lit(0), lambda acc, f: acc + F.size(f[side])
    )


def _first(items: Column, n: int | None) -> Column:
    return items if n is None else F.slice(items, 1, n)


def _terms(aspect: str, side: str, per_sentence: int | None, per_review: int | None) -> Column:
    hits = F.transform(
        F.filter("__facts", lambda f: f[aspect]), lambda f: _first(f[side], per_sentence)
    )
    return _first(F.flatten(hits), per_review)


def score_reviews(
    reviews: DataFrame,
    text: str = "text",
    aspects: vocab.Vocabulary = vocab.LEXICON_ASPECTS,
    positive: Sequence[str] = vocab.LEXICON_POSITIVE,
    negative: Sequence[str] = vocab.LEXICON_NEGATIVE,
    with_terms: bool = True,
    per_sentence: int | None = None,
    per_review: int | None = None,
) -> DataFrame:
    """Adds ``aspect_<a>`` scores in [-1, 1] and, if asked, ``<a>_pos_terms`` / ``<a>_neg_terms``.

    A sentence naming any word of an aspect gives all its positive and negative words to that
    aspect; the score is (p - n) / (p + n + 1e-6), or 0.0 without such words or without text.
    ``per_sentence`` and ``per_review`` limit the listed terms, never the score.
    """
    facts = reviews.withColumn("__facts", _sentence_facts(F.col(text), aspects, positive, negative))
    counted = facts.select(
        "*",
        *[_hits(a, "pos").alias(f"__{a}_p") for a in aspects],
        *[_hits(a, "neg").alias(f"__{a}_n") for a in aspects],
    )

    def ratio(a: str) -> Column:
        p, n = F.col(f"__{a}_p"), F.col(f"__{a}_n")
        total = p + n
        return F.when(total == 0, 0.0).otherwise((p - n) / (total + F.lit(vocab.RATIO_EPSILON)))

    kept = [c for c in reviews.columns]
    scores = [ratio(a).alias(f"aspect_{a}") for a in aspects]
    terms = (
        [_terms(a, s, per_sentence, per_review).alias(f"{a}_{s}_terms") for a in aspects for s in ("pos", "neg")]
        if with_terms
        else []
    )
    return counted.select(*kept, *scores, *terms)
