r"""Spelling variants: words one edit apart, grouped under their most frequent form.

The search is bit-sliced.  For a list of words, one bitset per (position, letter) marks the words
with that letter there.  A query of l letters is read letter by letter; three bitsets over the
list follow it, 64 words per machine word: ``exact`` (no error so far), ``swapped`` (one letter
replaced, positions level) and ``longer`` (the listed word has one letter more so far, so it is
read one position ahead).  ``exact`` feeds the others in every step, so zero and one error are
tracked together, and all queries of one length go through at once.  A listed word with one letter
less needs no bitset: there the listed word is the query, and the pair counts both ways.

Lists are kept short without losing a pair.  Two words one edit apart, the shorter of l letters,
share l - 1 letters at their ends, so they share their first or their last l // 2.  Words meet in
blocks by such a start or end, for their own length and as the longer word of the length below.  A
block of over ``MOST_WORDS`` is divided again in the same way: of the m letters between, its
pairs share the next or the previous m // 2.  A pair that shares the start belongs there alone:
blocks of ends leave it out, so no pair is found twice.  Division ends when one letter or none is
between, where the alphabet bounds a block.

Contract: null texts have no words; repeated rows count as rows; a null id is the empty string
before the colon; an empty table gives no rows; extra columns are ignored; runs may be of any
length; equal counts go by code-point order.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaudit.llm.batches import map_tasks
from plaudit.session import materialize

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMAGED, SHORTEST, RAREST, FACTOR = 97, 5, 3, 2
#: Words of a block before it is divided; words of one index, letters held at once, queries at once.
MOST_WORDS, INDEX_WORDS, HELD_LETTERS, QUERIES = 4096, 2048, 1 << 21, 4096
ANY_START = 1 << 30

_BLOCK = ["l", "a", "b", "below"]


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): lower-cased runs of letters, one in 97 with a letter removed, both by hash."""
    runs = F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(0)))
    id_ = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"))
    h = F.crc32(F.concat("id", "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    without = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    word = F.when(h % DAMAGED == 0, without).otherwise(F.col("run"))
    return (
        docs.select(id_.alias("id"), runs.alias("run")).select(word.alias("word"))
        .where(F.length("word") >= SHORTEST)
        .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= RAREST)
    )


def _divided(rows: DataFrame) -> DataFrame:
    """Every row in its two smaller blocks: by a longer start ``a``, and by a longer end ``b`` among
    the pairs whose common start is ``below`` that."""
    half = F.floor((F.col("l") - F.col("a") - F.col("b")) / 2).cast("int")
    start = F.struct((F.col("a") + half).alias("a"), F.col("b").alias("b"), F.col("below").alias("below"))
    end = F.struct(
        F.col("a").alias("a"), (F.col("b") + half).alias("b"), F.least("below", F.col("a") + half).alias("below")
    )
    cut = rows.select("word", "n", "l", F.inline(F.array(start, end)))
    key = F.xxhash64(*_BLOCK, F.expr("substring(word, 1, a)"), F.expr("right(word, b)"))
    return cut.withColumn("key", key)


def blocks(vocab: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """(word, n, l, a, b, below, key): words of l and l + 1 letters that share ``a`` letters at the
    start and ``b`` at the end; blocks of more than ``most`` words are divided."""
    length = F.length("word")
    roles = F.explode(F.array(length, length - 1)).alias("l")
    whole = vocab.select("word", "n", roles).where(F.col("l") >= SHORTEST)
    zero = F.lit(0)
    level = materialize(_divided(whole.withColumns({"a": zero, "b": zero, "below": F.lit(ANY_START)})), "blocks")
    found = None
    while True:
        divisible = level.where(F.col("l") - F.col("a") - F.col("b") >= 2)
        large = materialize(divisible.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > most), "large")
        if large.isEmpty():
            return level if found is None else found.unionByName(level)
        marked = level.join(large, "key", "left")
        small = materialize(marked.where("m is null").select(level.columns), "blocks")
        found = small if found is None else found.unionByName(small)
        level = materialize(_divided(marked.where("m is not null").select("word", "n", *_BLOCK)), "blocks")


def _codes(words: list[str], width: int) -> tuple[np.ndarray, int]:
    """Letters as small numbers, one row per word; shorter words end in a number of no letter."""
    flat = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le"), np.uint32)
    letters, codes = np.unique(flat, return_inverse=True)
    return codes.reshape(len(words), width).astype(np.int32), len(letters)


def _bitsets(column: np.ndarray, letters: int) -> np.ndarray:
    """(letter, words / 64): which words have the letter in this position."""
    n = len(column)
    marks = np.zeros((letters, -(-n // 64) * 64), bool)
    marks[column, np.arange(n)] = True
    return np.packbits(marks, axis=1, bitorder="little").view(np.uint64)


def _packed(marks: np.ndarray) -> np.ndarray:
    return _bitsets(marks.astype(np.int32), 2)[1]


def _one_edit(codes: np.ndarray, letters: int, queries: np.ndarray, listed: np.ndarray, l: int, long: np.ndarray):
    """Index pairs (query, listed word) with one letter replaced, or one more in the listed word."""
    column = lambda i: _bitsets(codes[listed, i], letters)
    here, ahead = column(0), column(1)
    exact = np.full((len(queries), here.shape[1]), ~np.uint64(0))
    swapped, longer = np.zeros_like(exact), np.zeros_like(exact)
    for i in range(l):
        letter = codes[queries, i]
        level = here[letter]
        longer = (longer | exact) & ahead[letter]
        swapped = (swapped & level) | (exact & ~level)
        exact &= level
        here, ahead = ahead, column(i + 2) if i + 2 <= l else ahead
    is_long = _packed(long[listed])
    found = (swapped & _packed(~long[listed])) | ((longer | exact) & is_long)
    at, slot = np.nonzero(found)
    bits = (found[at, slot][:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    row, bit = np.nonzero(bits)
    return queries[at[row]], listed[slot[row] * 64 + bit]


def near_in(words: list[str], l: int, a: int, b: int, below: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (shorter or equal, other) of one block's kind among ``words`` of l and l + 1 letters."""
    codes, letters = _codes(words, l + 1)
    long = np.array([len(w) > l for w in words])
    short = np.flatnonzero(~long)
    left, right = [], []
    for q in range(0, len(short), QUERIES):
        for t in range(0, len(words), INDEX_WORDS):
            listed = np.arange(t, min(t + INDEX_WORDS, len(words)))
            x, y = _one_edit(codes, letters, short[q : q + QUERIES], listed, l, long)
            left.append(x)
            right.append(y)
    x, y = np.concatenate(left), np.concatenate(right)
    ok = (codes[x, :a] == codes[y, :a]).all(axis=1)
    if below <= l:
        ok &= (codes[x, :below] != codes[y, :below]).any(axis=1)
    if b:
        ends = np.arange(l - b, l)
        ok &= (codes[x][:, ends] == np.take_along_axis(codes[y], ends + long[y][:, None], axis=1)).all(axis=1)
    return x[ok], y[ok]


_PAIR = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order; whole blocks of one kind are searched together up to a size."""
    kind, words, counts, letters = None, [], [], 0

    def pairs():
        x, y = near_in(words, *kind)
        other = [len(words[j]) > kind[0] for j in y]
        one = [(words[i], words[j], counts[j]) for i, j in zip(x, y)]
        both = one + [(words[j], words[i], counts[i]) for i, j, more in zip(x, y, other) if more]
        w, v, n = zip(*both) if both else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((w, v, n), _PAIR)], schema=_PAIR)

    def listed():
        for batch in batches:
            yield from zip(*(batch.column(i).to_pylist() for i in range(7)))

    for key, block in groupby(listed(), key=lambda r: r[2:]):
        block = list(block)
        l = key[0]
        if len(block) < 2 or all(len(r[0]) > l for r in block):
            continue
        if words and (key[:4] != kind or len(words) + len(block) > INDEX_WORDS or letters > HELD_LETTERS):
            yield pairs()
            words, counts, letters = [], [], 0
        kind = key[:4]
        words += [r[0] for r in block]
        counts += [r[1] for r in block]
        letters += l * len(block)
    if words:
        yield pairs()


def near_words(vocab: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """(word, near, near_n): every ordered pair of words exactly one edit apart, once."""
    order = [*_BLOCK, "key"]
    dealt = blocks(vocab, most).repartition(*order).sortWithinPartitions(*order).select("word", "n", *order)
    return map_tasks(dealt, _search, "word string, near string, near_n long")


def roots(links: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the last word reached; counts double on the way, so no rings."""
    reached = materialize(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialize(reached.join(further, "root", "left"), "roots")
        reached = step.select("word", F.coalesce("next", "root").alias("root"))
        if step.where("next is not null").isEmpty():
            return reached


def grouped(vocab: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every (word, n)."""
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    near = near_words(vocab, most).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    found = vocab.join(near, "word", "left")
    has = -F.col("best.less") >= FACTOR * F.col("n")
    formed = materialize(
        found.select(
            "word", F.when(has, F.col("best.form")).alias("form"), "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    last = roots(formed.where("form is not null"))
    return formed.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def variants(docs: DataFrame) -> DataFrame:
    """Spelling variants over the words of all documents."""
    return grouped(materialize(vocabulary(docs), "vocabulary"))
