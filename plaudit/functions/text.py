"""Text expressions: every function maps columns to columns and stays inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import let
from .vocab import GRAM_SIZES, STOP_WORDS


def strip(text: Column) -> Column:
    """Trim any white space, not only blanks."""
    return F.btrim(text, F.lit(" \t\n\u000b\f\r"))


def alpha_words(text: Column) -> Column:
    """Lower-case alphabetic words; a leading empty word may remain, as with a plain split."""
    return F.split(F.regexp_replace(F.lower(text), "[^a-z]", " "), r"\s+")


def without_stop_words(words: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    return F.filter(words, lambda w: ~w.isin(list(stop_words)))


def sentences(text: Column) -> Column:
    """Pieces between runs of ``.``, ``!`` and ``?``, trimmed, empties dropped."""
    pieces = F.transform(F.split(text, "[.!?]+"), strip)
    return F.filter(pieces, lambda s: F.length(s) > 0)


def word_tokens(sentence: Column) -> Column:
    return F.regexp_extract_all(F.lower(sentence), F.lit("[a-zA-Z']+"), F.lit(0))


def lemma(word: Column) -> Column:
    """Light lemma of a lower-case word: plural endings only."""
    return (
        F.when(word.endswith("ies") & (F.length(word) > 3), F.concat(word.substr(F.lit(1), F.length(word) - 3), F.lit("y")))
        .when(word.endswith("s") & ~word.endswith("ss"), word.substr(F.lit(1), F.length(word) - 1))
        .otherwise(word)
    )


def lemmas(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z][a-z\-']+"), F.lit(0))
    return F.transform(words, lemma)


def char_grams(text: Column, sizes: tuple[int, int] = GRAM_SIZES) -> Column:
    """Character n-grams inside word boundaries, with repeats.

    Each word gets one blank on either side; grams never cross words.  A padded word no longer
    than a size is emitted whole, once, and larger sizes add nothing.
    """
    low, high = sizes
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: F.length(w) > 0)

    def grams_of(padded: Column) -> Column:
        length = F.length(padded)
        by_size = F.transform(
            F.sequence(F.lit(low), F.greatest(F.lit(low), F.least(F.lit(high), length))),
            lambda n: F.transform(
                F.sequence(F.lit(1), F.greatest(F.lit(1), length - n + 1)),
                lambda at: padded.substr(at, n),
            ),
        )
        return F.flatten(by_size)

    padded_words = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    return F.flatten(F.transform(padded_words, grams_of))


def word_grams(words: Column, longest: int) -> Column:
    """All runs of 1 to ``longest`` words, joined by blanks."""

    def runs(w: Column) -> Column:
        count = F.size(w)
        by_size = F.transform(
            F.filter(F.sequence(F.lit(1), F.lit(longest)), lambda n: n <= count),
            lambda n: F.transform(
                F.sequence(F.lit(1), count - n + 1),
                lambda at: F.array_join(F.slice(w, at, n), " "),
            ),
        )
        return F.flatten(by_size)

    return let(words, runs)


def substrings(text: Column, lengths: Sequence[int]) -> Column:
    """All substrings of the given lengths."""

    def cuts(t: Column) -> Column:
        fitting = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(t))
        by_length = F.transform(
            fitting,
            lambda n: F.transform(
                F.sequence(F.lit(1), F.length(t) - n + 1), lambda at: t.substr(at, n)
            ),
        )
        return F.flatten(by_length)

    return let(text, cuts)


def normal_opinion(opinion: Column) -> Column:
    """Lower-case first, then blank out everything but letters, digits, blanks and hyphens."""
    return F.regexp_replace(F.lower(opinion), r"[^a-z0-9\s\-]", " ")


def opinion_words(opinion: Column) -> Column:
    return F.filter(F.split(normal_opinion(opinion), r"\s+"), lambda w: F.length(w) > 0)
