"""Language by nearest centroid of TF-IDF n-gram vectors.

A text becomes counts of its lower-cased byte bigrams and trigrams, hashed into ``dims`` places
(everything in ASCII that is no letter is one blank); counts go by 1 + log, weighted by the inverse
document frequency over all documents to learn from, and the vector gets length one.  Each
language has up to ``clusters`` centroids, found by spherical k-means over a bounded sample; a text
takes the language of the nearest one by cosine.  A text whose nearest centroid is further than
almost all texts of that cluster's language were from theirs is marked as rejected.

Contract: null texts and texts without a letter are ``und`` with score 0, as is every text when no
language was learned; ties go to the language first in order.  Null languages teach nothing.
Repeated rows are scored each.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plaudit.llm.batches import column_of, groups_by_size, map_tasks, rows, texts_of

UND = "und"
_LETTER = regex.compile(r"\p{L}")
_FOLD = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


@dataclass(frozen=True)
class Setup:
    dims: int = 4096
    clusters: int = 4
    per_language: int = 600  # documents to learn centroids from
    rounds: int = 10
    distance: float = 0.01  # part of the sample that may lie further than the limit


def counts_of(texts: list[str], dims: int) -> np.ndarray:
    """(text, place) -> how many bigrams and trigrams of the text fall there."""
    out = np.zeros((len(texts), dims), np.float32)
    for i, text in enumerate(texts):
        raw = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "surrogatepass").translate(_FOLD), np.uint8)
        b = raw.astype(np.uint32)
        two = b[:-1] * np.uint32(257) + b[1:]
        three = two[:-1] * np.uint32(257) + b[2:]
        for grams in (two + np.uint32(1 << 30), three):
            place = (grams * np.uint32(0x9E3779B1)) >> np.uint32(16)
            out[i] += np.bincount(place & np.uint32(dims - 1), minlength=dims)
    return out


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weighted = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * idf
    size = np.sqrt((weighted**2).sum(axis=1, keepdims=True))
    return (weighted / np.maximum(size, 1e-9)).astype(np.float32)


def spherical_clusters(points: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Centroids of length one; the first is the point nearest the mean, the next the furthest."""
    chosen = [int(np.argmax(points @ points.mean(axis=0)))]
    while len(chosen) < min(k, len(points)):
        near = (points @ points[chosen].T).max(axis=1)
        chosen.append(int(np.argmin(near)))
    centres = points[chosen]
    for _ in range(rounds):
        own = np.argmax(points @ centres.T, axis=1)
        sums = np.stack([points[own == c].sum(axis=0) for c in range(len(centres))])
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.maximum(size, 1e-9), centres).astype(np.float32)
    return centres


def document_frequencies(docs: DataFrame, setup: Setup) -> np.ndarray:
    """Inverse document frequency of each place; every task counts before it sends anything."""
    schema = pa.schema([("place", pa.int32()), ("n", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(setup.dims + 1, np.int64)
        for batch in batches:
            texts = texts_of(batch)
            for part in groups_by_size([len(t) + 4096 for t in texts]):
                counts = counts_of(texts[part], setup.dims)
                total[:-1] += (counts > 0).sum(axis=0)
                total[-1] += len(counts)
        yield rows(schema, place=np.arange(setup.dims + 1), n=total)

    sums = map_tasks(docs.select("text"), task, "place int, n long").groupBy("place").agg(F.sum("n").alias("n"))
    met = np.zeros(setup.dims + 1)
    for r in sums.collect():  # dims + 1 rows
        met[r.place] = r.n
    return (np.log((1 + met[-1]) / (1 + met[:-1])) + 1).astype(np.float32)


def learn(docs: DataFrame, setup: Setup = Setup()) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """(idf, language of each centroid, centroids, smallest accepted cosine of each)."""
    known = docs.where("lang is not null and text is not null").select("lang", "text")
    idf = document_frequencies(known, setup)
    # Hashes of texts are chosen first: per_language for each language, few enough to broadcast.
    lettered = known.where(F.col("text").rlike(r"\p{L}")).withColumn("hash", F.xxhash64("text"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("hash"))
    chosen = (
        lettered.groupBy("lang", "hash").agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("rank", first).where(F.col("rank") <= setup.per_language).select("lang", "hash")
    )
    some = lettered.join(F.broadcast(chosen), ["lang", "hash"]).groupBy("lang", "hash").agg(F.min("text").alias("text"))
    schema = pa.schema([("lang", pa.string()), ("limit", pa.float64()), ("centre", pa.binary())])

    def cluster(group: pa.Table) -> pa.Table:
        points = vectors(counts_of(group.column("text").to_pylist(), setup.dims), idf)
        centres = spherical_clusters(points, setup.clusters, setup.rounds)
        limit = float(np.quantile((points @ centres.T).max(axis=1), setup.distance))
        n = len(centres)
        lang = group.column("lang")[0].as_py()
        return pa.Table.from_batches(
            [rows(schema, lang=[lang] * n, limit=[limit] * n, centre=[c.tobytes() for c in centres])]
        )

    found = some.select("lang", "text").groupBy("lang").applyInArrow(cluster, "lang string, limit double, centre binary")
    got = sorted(found.collect(), key=lambda r: r.lang)  # clusters x languages
    centres = np.array([np.frombuffer(r.centre, np.float32) for r in got], np.float32).reshape(len(got), setup.dims)
    return idf, [r.lang for r in got], centres, np.array([r.limit for r in got])


def languages(docs: DataFrame, train: DataFrame, setup: Setup = Setup()) -> DataFrame:
    """doc_id, lang_pred, score, rejected of ``docs``; learns from ``train`` (text, lang)."""
    idf, langs, centres, limits = learn(train, setup)
    schema = pa.schema(
        [("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())]
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            names, scores, far = [], [], []
            for part in groups_by_size([len(t) + 4096 for t in texts]):
                if not langs:
                    best, cosine = np.zeros(part.stop - part.start, int), np.zeros(part.stop - part.start)
                else:
                    table = vectors(counts_of(texts[part], setup.dims), idf) @ centres.T
                    best, cosine = np.argmax(table, axis=1), np.clip(table.max(axis=1), 0, 1)
                for text, b, c in zip(texts[part], best.tolist(), cosine.tolist()):
                    lettered = bool(langs) and _LETTER.search(text) is not None
                    names.append(langs[b] if lettered else UND)
                    scores.append(c if lettered else 0.0)
                    far.append(not lettered or c < limits[b])
            yield rows(schema, doc_id=column_of(batch, "doc_id"), lang_pred=names, score=scores, rejected=far)

    return map_tasks(docs.select("doc_id", "text"), task, "doc_id long, lang_pred string, score double, rejected boolean")
