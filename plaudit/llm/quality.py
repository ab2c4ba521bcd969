"""Quality rules: counts of words, symbols and repeats, and bands of compression ratios.

A text is compressed whole and in fixed chunks with zstandard.  Text that repeats itself
compresses far better than prose, random characters hardly at all; what counts as prose depends
on the length, so every length class (powers of two) has its own lowest and highest ratio.
``fitted`` learns them from documents labelled good, apart for whole texts and chunks; a class of
fewer than ``enough`` of these keeps the wide limits of ``Bands``.

Null and empty texts have no words and fail the base rule.  Extra columns pass through
``keep_good`` untouched; repeated rows are judged each alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaudit.llm.batches import column_of, groups_by_size, map_tasks, rows, texts_of
from plaudit.llm.shingles import words_of

SYMBOLS = b"#*$%&|<>"
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
VERDICT = "ratio double, bad_chunks long, n_chunks long, base_failed boolean, kept boolean"


@dataclass(frozen=True)
class Bands:
    """Lowest and highest ratio of a text by its bytes, and of a chunk by the chunk size.

    The lowest ratio rises from 0 (no limit) below 256 bytes to ``lowest`` at 1,024; the highest
    starts at ``highest`` for 64 bytes and rises by ``step`` with each doubling.  ``share``: a
    text is rejected when more than this part of its chunks lies outside the band.

    ``limits`` has (is chunk, length class) -> (lowest, highest) as far as they are fitted.  A class
    reaches from quantile ``tail`` of all good documents to its mirror image, and on both sides half
    as far again as these lie from the median.
    """

    level: int = 3
    chunk: int = 2048
    lowest: float = 1.4
    highest: float = 2.4
    step: float = 0.18
    share: float = 0.25
    enough: int = 50
    tail: float = 0.005
    limits: tuple[tuple[tuple[bool, int], tuple[float, float]], ...] = ()

    def of(self, n_bytes: int, is_chunk: bool = False) -> tuple[float, float]:
        for key, found in self.limits:
            if key == (is_chunk, n_bytes.bit_length()):
                return found
        doublings = max(0, n_bytes.bit_length() - 7)
        low = 0.0 if n_bytes < 256 else self.lowest - 0.15 * max(0, 11 - n_bytes.bit_length())
        return low, self.highest + self.step * doublings


@lru_cache(maxsize=2)
def _compressor(level: int) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=False)


def chunks_of(text: bytes, size: int) -> list[bytes]:
    """Fixed chunks of a text longer than one; a rest of under half a chunk joins the chunk before it."""
    if len(text) <= size:
        return []
    cuts = range(0, max(1, len(text) - size // 2), size)
    return [text[c : c + size] for c in cuts[:-1]] + [text[cuts[-1] :]]


def ratio_of(text: bytes, level: int) -> float:
    return len(text) / len(_compressor(level).compress(text)) if text else 0.0


def band_verdict(text: bytes, bands: Bands) -> tuple[float, int, int, bool]:
    """(ratio of the whole, chunks outside their band, chunks, within the bands)."""
    if not text:
        return 0.0, 0, 0, False

    def fine(ratio: float, n_bytes: int, is_chunk: bool) -> bool:
        low, high = bands.of(n_bytes, is_chunk)
        return low <= ratio <= high

    ratio, parts = ratio_of(text, bands.level), chunks_of(text, bands.chunk)
    bad = sum(not fine(ratio_of(part, bands.level), len(part), True) for part in parts)
    return ratio, bad, len(parts), fine(ratio, len(text), False) and bad <= bands.share * len(parts)


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def repeated_words(texts: list[bytes], window: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Per text: words, and words inside a window of ``window`` words that occurs twice or more."""
    words = words_of(texts)
    counts = np.diff(words.first)
    at, text = words.runs(window)
    covered = np.zeros(len(words.starts) + 1, np.int64)
    if len(at):
        with np.errstate(over="ignore"):
            key = words.hashes(window, at) + text.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(covered, at[twice], 1)
        np.add.at(covered, at[twice] + window, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(covered)[:-1] > 0)])
    return counts, inside[words.first[1:]] - inside[words.first[:-1]]


def judge(texts: list[str], bands: Bands) -> dict[str, list]:
    """All counts and verdicts of some texts."""
    out: dict[str, list] = {f.split()[0]: [] for f in f"{STATS}, {VERDICT}".split(", ")}
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    for part in groups_by_size([len(b) for b in raw]):
        counts, repeats = repeated_words(raw[part])
        for t, b, n, again in zip(texts[part], raw[part], counts.tolist(), repeats.tolist()):
            blanks = len(b) - len(b.translate(None, b" \t\n\r\v\f"))
            failed = n < 10 or 100 * again > 20 * n
            ratio, bad, chunks, fine = band_verdict(b, bands)
            symbols = len(b) - len(b.translate(None, SYMBOLS))
            row = (n, len(t) - blanks, symbols, duplicate_lines(b), again, ratio, bad, chunks)
            for name, value in zip(out, (*row, failed, fine and not failed)):
                out[name].append(value)
    return out


def fitted(docs: DataFrame, labels: DataFrame, bands: Bands = Bands()) -> Bands:
    """Bands with limits from all documents of label ``quality`` 1 that pass the base rule.

    Documents of crc32(doc_id as text) mod 4 = 2 never teach.  Without labels the bands stay as
    they are; of several labels of one document the lowest counts.  Ratios are joined with the
    labels, so no text is shuffled.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("is_chunk", pa.bool_()), ("class", pa.int32()), ("ratio", pa.float64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = texts_of(batch), column_of(batch, "doc_id").to_pylist()
            failed = judge(texts, bands)["base_failed"]
            found: list[tuple] = []
            for doc_id, t, bad in zip(ids, texts, failed):
                if not bad:
                    raw = t.encode("utf-8", "surrogatepass")
                    parts = [raw, *chunks_of(raw, bands.chunk)]
                    found += [(doc_id, i > 0, len(p).bit_length(), ratio_of(p, bands.level)) for i, p in enumerate(parts)]
            if found:
                yield rows(schema, **dict(zip(schema.names, zip(*found))))

    teaches = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2
    known = labels.where(teaches & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    good = known.where("quality = 1").select("doc_id")
    ratios = map_tasks(
        docs.where(teaches).select("doc_id", "text"), task, "doc_id long, is_chunk boolean, class int, ratio double"
    )
    tails = F.percentile_approx("ratio", [bands.tail, 0.5, 1 - bands.tail], 10_000)
    found = (
        ratios.join(good, "doc_id")
        .groupBy("is_chunk", "class").agg(F.count("*").alias("n"), tails.alias("q")).where(F.col("n") >= bands.enough)
    )
    reach = lambda low, middle, high: (low - (middle - low) / 2, high + (high - middle) / 2)
    limits = tuple(sorted(((r["is_chunk"], r["class"]), reach(*r["q"])) for r in found.collect()))
    return replace(bands, limits=limits)


def quality(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """One row per document: doc_id, the base counts, the ratios and the verdicts."""
    schema = pa.schema(
        [("doc_id", pa.int64())]
        + [(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines")]
        + [("n_repeat_words", pa.int64()), ("ratio", pa.float64()), ("bad_chunks", pa.int64())]
        + [("n_chunks", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_())]
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield rows(schema, doc_id=column_of(batch, "doc_id"), **judge(texts_of(batch), bands))

    return map_tasks(docs.select("doc_id", "text"), task, f"doc_id long, {STATS}, {VERDICT}")


def keep_good(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The documents whose verdict is ``kept``, all their columns as they are."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(judge(texts_of(batch), bands)["kept"], pa.bool_()))

    return map_tasks(docs, task, docs.schema)
