"""Fingerprints of improbable features.

Every window of ``WINDOW`` bytes has an entropy; entropies are ranked by how rarely they occur over
all documents, the rarest first.  In each run of ``WINDOW`` neighbouring windows the one with the
rarest entropy (the leftmost of equals) gets a point, and windows with at least ``points`` points
are the features of the text.  Features go, in order, into Bloom filters of ``BITS`` bits, five
bits each, a new filter after ``per_filter`` features.  Two fingerprints are alike by the bits that
their filters share beyond chance: for each filter of the shorter chain the best match in the
other one, averaged.

Contract: null counts as empty.  A text of under four windows holds too few of them: each of its
stretches of ``STRETCH`` bytes is a feature (itself, if it is shorter); an empty text has none.  Two
empty fingerprints are alike (1), an empty and another one are not (0).  Equal texts have equal
fingerprints.  Rows of equal doc_id follow each other by text; null ids come after all others;
a lone document is its own next one.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaudit.llm.batches import column_of, groups_by_size, map_tasks, rows, texts_of
from plaudit.llm.shingles import Words, _powers, _room

WINDOW = 64
STRETCH = 16
PIECE = 1 << 18  # bytes whose windows are held at once
BITS = 2048
HASHES = 5
LEVELS = 1001
#: c log2 c in thousandths, for counts up to the window: whole numbers, so that sums are exact.
_TERM = np.round([c * np.log2(c) * 1000 if c else 0 for c in range(WINDOW + 1)]).astype(np.int64)
#: Above every rank; a key holds the rank over PLACE bits of position, enough for any text.
NONE = np.int64(1 << 10)
PLACE = np.int64(40)


@dataclass(frozen=True)
class Choice:
    points: int = 16
    per_filter: int = 160
    lowest: int = 100  # windows of an entropy level below this are no features
    beyond: float = 0.3  # part of the room above chance that counts as chance


def levels(buffer: np.ndarray) -> np.ndarray:
    """Entropy level, 0 to 1000, of the window that starts at each byte (the last ones fewer).

    A byte that enters a window adds to the sum of c log c by how many equal bytes are in it, and
    a byte that leaves takes away likewise; both counts come from comparing with the 63 bytes
    before and after.
    """
    n = len(buffer)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for lag in range(1, WINDOW):
        same = (buffer[lag:] == buffer[:-lag]).view(np.uint8)
        before[lag:] += same
        after[:-lag] += same
    gain = np.diff(_TERM)
    enters, leaves = gain[before], gain[after]
    enters[WINDOW:] -= leaves[:-WINDOW]
    # The first window is built byte by byte; equal bytes before its start do not exist.
    total = np.cumsum(enters)[WINDOW - 1 :]
    entropy = np.log2(WINDOW) * 1000 * WINDOW - total
    return np.clip(entropy / (np.log2(WINDOW) * WINDOW), 0, LEVELS - 1).astype(np.int64)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, start of each text, whether a window that starts at a byte lies in one text)."""
    buffer = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    inside = np.zeros(len(buffer) + 1, np.int64)
    fits = sizes >= WINDOW
    np.add.at(inside, starts[fits], 1)
    np.add.at(inside, (starts + sizes)[fits] - WINDOW + 1, -1)
    return buffer, starts, np.cumsum(inside)[:-1] > 0


def rarity_counts(docs: DataFrame) -> np.ndarray:
    """How many windows of all documents have each entropy level."""
    schema = pa.schema([("level", pa.int32()), ("n", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS, np.int64)
        for batch in batches:
            raw = [t.encode("utf-8", "surrogatepass") for t in texts_of(batch)]
            for part in groups_by_size([len(b) for b in raw]):
                buffer, _, inside = joined(raw[part])
                found = levels(buffer)
                total += np.bincount(found[inside[: len(found)]], minlength=LEVELS)
        yield rows(schema, level=np.arange(LEVELS), n=total)

    sums = map_tasks(docs.select("text"), task, "level int, n long").groupBy("level").agg(F.sum("n").alias("n"))
    out = np.zeros(LEVELS, np.int64)
    for r in sums.collect():  # LEVELS rows
        out[r.level] = r.n
    return out


def ranks(counts: np.ndarray, choice: Choice = Choice()) -> np.ndarray:
    """Rank of each level, the rarest that occurs first; NONE for levels that give no feature."""
    order = np.lexsort((np.arange(len(counts)), counts))
    out = np.empty(len(counts), np.int64)
    out[order] = np.arange(len(counts))
    out[: choice.lowest] = NONE
    return out


def features(texts: list[bytes], rank: np.ndarray, choice: Choice = Choice()) -> list[np.ndarray]:
    """64-bit hashes of the chosen windows of each text, in order."""
    buffer, starts, inside = joined(texts)
    n = len(buffer)
    # Hashes of byte stretches by prefix sums, as for words; only ends and starts are needed.
    with np.errstate(over="ignore"):
        terms = buffer.astype(np.uint64) * _powers(_room(n + 1))[0][:n]
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
    here = np.arange(n)
    stretch = Words(here, here + WINDOW, here, prefix).stretch
    key = np.full(n + 2 * WINDOW, NONE << PLACE, np.int64)
    if n >= WINDOW:
        found = levels(buffer)
        valid = inside[: len(found)]
        key[WINDOW : WINDOW + len(found)] = np.where(valid, rank[found], NONE) << PLACE
    key += np.arange(len(key))
    lowest = key
    for step in (1, 2, 4, 8, 16, 32):
        lowest = np.minimum(lowest[:-step], lowest[step:])
    lowest = lowest[lowest < NONE << PLACE]
    at, points = np.unique(lowest & np.int64((1 << PLACE) - 1), return_counts=True)
    at = at[points >= choice.points] - WINDOW
    hashes = stretch(at, at) if len(at) else np.zeros(0, np.uint64)
    cuts = np.searchsorted(at, np.append(starts, n))
    out = []
    for i, text in enumerate(texts):
        if 0 < len(text) < 4 * WINDOW:
            size = min(len(text), STRETCH)
            first = starts[i] + np.arange(len(text) - size + 1)
            out.append(Words(here, here + size, here, prefix).stretch(first, first))
        else:
            out.append(hashes[cuts[i] : cuts[i + 1]])
    return out


def filters(hashes: np.ndarray, choice: Choice = Choice()) -> np.ndarray:
    """Chained Bloom filters, one row of 64-bit words each."""
    n = -(-len(hashes) // choice.per_filter)
    bits = np.zeros((n, BITS), np.uint8)
    which = np.arange(len(hashes)) // choice.per_filter
    for i in range(HASHES):
        bits[which, ((hashes >> np.uint64(11 * i)) & np.uint64(BITS - 1)).astype(np.int64)] = 1
    return np.packbits(bits, axis=1).view(np.uint64)


def likeness(a: np.ndarray, b: np.ndarray, choice: Choice = Choice()) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    p, q = np.bitwise_count(a).sum(axis=1), np.bitwise_count(b).sum(axis=1)
    best = np.zeros(len(a))
    for i in range(len(a)):
        shared = np.bitwise_count(a[i] & b).sum(axis=1)
        most = np.minimum(p[i], q).astype(float)
        chance = p[i] * q.astype(float) / BITS
        floor = chance + choice.beyond * (most - chance)
        best[i] = np.clip((shared - floor) / np.maximum(most - floor, 1e-9), 0, 1).max()
    return float(best.mean())


def as_text(chain: np.ndarray) -> str:
    return base64.b64encode(chain.tobytes()).decode()


def fingerprints(texts: list[str], rank: np.ndarray, choice: Choice = Choice()) -> list[np.ndarray]:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    out: list[np.ndarray] = []
    for part in groups_by_size([len(b) for b in raw], PIECE):
        out += [filters(h, choice) for h in features(raw[part], rank, choice)]
    return out


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by the beginning of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame) -> DataFrame:
    """(bucket, ghost, doc_id, text) in partitions sorted so that the next document follows.

    Buckets are ranges of doc_id; each ends with a copy, the ghost, of the document that comes
    after its last one.  Bounds and ghosts are a few per shuffle partition.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    keyed = docs.select(key.alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / n for i in range(1, n)]
    bounds = np.array(keyed.agg(F.percentile_approx("key", shares, 100 * n)).first()[0] or [], np.int64)

    @F.pandas_udf("int")
    def bucket(keys: pd.Series) -> pd.Series:
        # Descending: the largest ids are in bucket 0.
        return pd.Series(len(bounds) - np.searchsorted(bounds, keys.to_numpy(), "left")).astype("int32")

    placed = keyed.withColumn("bucket", bucket("key"))
    tops = {r.bucket: r.top for r in placed.groupBy("bucket").agg(F.max("key").alias("top")).collect()}
    order = sorted(tops)
    after = {tops[b]: order[i - 1] for i, b in enumerate(order)}  # bucket 0 follows the last one
    edges = spark.createDataFrame(list(after.items()), "key long, bucket int")
    ghosts = (
        keyed.join(F.broadcast(edges), "key").groupBy("key", "bucket")
        .agg(F.min("text").alias("text"))
        .select("key", F.lit(None).cast("long").alias("doc_id"), "text", "bucket", F.lit(True).alias("ghost"))
    )
    both = placed.withColumn("ghost", F.lit(False)).unionByName(ghosts)
    return (
        both.repartitionByRange("bucket")
        .sortWithinPartitions("bucket", "ghost", F.desc("key"), "text")
        .select("bucket", "ghost", "doc_id", "text")
    )


def compare_with_next(docs: DataFrame, choice: Choice = Choice()) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rank = ranks(rarity_counts(docs), choice)
    columns = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in columns.split(", ")])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far and its fingerprint
        for batch in batches:
            texts = texts_of(batch)
            prints = fingerprints(texts, rank, choice)
            ids, buckets, ghosts = (column_of(batch, c).to_pylist() for c in ("doc_id", "bucket", "ghost"))
            lines = list(zip(buckets, ghosts, ids, texts, prints))
            if held is not None:
                lines.insert(0, held)
            pairs = [(a, b) for a, b in zip(lines, lines[1:]) if a[0] == b[0] and not a[1]]
            held = lines[-1] if lines else None
            changed = [edited(a[3], b[3]) for a, b in pairs]
            new = fingerprints(changed, rank, choice)
            yield rows(
                schema,
                doc_id=[a[2] for a, _ in pairs],
                n_chars=[len(a[3]) for a, _ in pairs],
                edited_sha256=[hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
                fingerprint=[as_text(a[4]) for a, _ in pairs],
                edited_fingerprint=[as_text(p) for p in new],
                near_edited=[likeness(a[4], p, choice) for (a, _), p in zip(pairs, new)],
                near_next=[likeness(a[4], b[4], choice) for a, b in pairs],
            )

    return map_tasks(with_next(docs), task, columns)
