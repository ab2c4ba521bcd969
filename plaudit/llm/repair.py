"""Token ids in files of Re-Pair grammars.

Documents are sorted by id over range partitions and cut into shards of about ``SHARD_IDS`` ids.
In each shard frequent pairs of neighbouring symbols are replaced by nonterminals, round after
round, many pairs at once, until no pair is frequent; where pairs overlap, the more frequent one
goes first and the others wait for the next round.  A pair never becomes more frequent by other
replacements, so a round counts only pairs that were frequent or hold a symbol of the round
before.  A shard stores its rules with their expansion lengths, the remaining
sequence, and where its documents begin, so that ids from any place can be decoded alone.

A shard is one row of a Parquet table, its ``payload`` the bytes of the format below:
magic, counts (6 x u64), then zstandard blocks: rules, expansion lengths, symbols (low 16 bits and
the rest apart), document ids, their null marks, document starts.

Contract: null text is empty and holds the end id alone.  Rows of one doc_id stand side by side;
null ids come first.  An empty table gives an empty table.  Extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plaudit.llm.batches import column_of, map_tasks, rows, texts_of
from plaudit.llm.tokens import word_encoder
from plaudit.session import materialize

MAGIC = b"RPR1"
SHARD_IDS = 1 << 20
END_ID = 1


@dataclass(frozen=True)
class Effort:
    pairs: int = 8192  # replaced in one round at most; the others wait
    at_least: int = 8  # occurrences of a pair


def maybe_frequent(keys: np.ndarray, at_least: int) -> np.ndarray:
    """Places of keys whose hash occurs ``at_least`` times: all frequent keys and a few others."""
    bits = max(8, len(keys).bit_length())
    with np.errstate(over="ignore"):
        slot = ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
    return np.flatnonzero(np.bincount(slot, minlength=1 << bits)[slot] >= at_least)


def weights(keys: np.ndarray, effort: Effort) -> tuple[np.ndarray, np.ndarray]:
    """Of each key: is it frequent, and its weight in this round (0 none, the most frequent highest)."""
    frequent, heavy = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    some = maybe_frequent(keys, effort.at_least)
    if not len(some):
        return frequent, heavy
    order = some[np.argsort(keys[some])]
    held = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
    counts = np.diff(np.append(starts, len(held)))
    often = np.flatnonzero(counts >= effort.at_least)
    chosen = often[np.argsort(-counts[often], kind="stable")][: effort.pairs]
    weight = np.zeros(len(counts), np.int64)
    weight[chosen] = np.arange(len(chosen), 0, -1)
    frequent[order] = np.repeat(counts >= effort.at_least, counts)
    heavy[order] = np.repeat(weight, counts)
    return frequent, heavy


def without_overlap(at: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which of the ascending places ``at`` are replaced: those heavier than their neighbours, and
    every second one of a stretch of equal pairs, as in a run of one symbol."""
    beside = at[1:] == at[:-1] + 1
    before = np.concatenate([[0], np.where(beside, weight[:-1], 0)])
    after = np.concatenate([np.where(beside, weight[1:], 0), [0]])
    place = np.arange(len(at))
    begin = np.maximum.accumulate(np.where(before != weight, place, 0))
    step = place - begin - (before > weight)[begin]
    return (step % 2 == 0) & (after <= weight)


def compress(ids: np.ndarray, effort: Effort = Effort()) -> tuple[np.ndarray, np.ndarray, int]:
    """(symbols, rules, first nonterminal): rule i expands nonterminal ``first + i`` to a pair."""
    seq = ids.astype(np.uint64)
    first = int(seq.max()) + 1 if len(seq) else 0
    rules: list[np.ndarray] = []
    made = first
    live = np.arange(len(seq) - 1)  # places whose pair may be frequent
    while len(live):
        keys = (seq[live] << np.uint64(32)) | seq[live + 1]
        frequent, weight = weights(keys, effort)
        heavy = np.flatnonzero(weight)
        if not len(heavy):
            break
        heavy = heavy[without_overlap(live[heavy], weight[heavy])]
        _, where, number, uses = np.unique(weight[heavy], return_index=True, return_inverse=True, return_counts=True)
        # The heaviest pair keeps at least every second of its places, so each round replaces some.
        worth = uses >= effort.at_least // 2
        rules.append(keys[heavy[where[worth]]])
        fresh = np.cumsum(worth) - 1 + made
        kept = worth[number]
        take = live[heavy[kept]]
        seq[take] = fresh[number[kept]].astype(np.uint64)
        made += int(worth.sum())
        alive, stay = np.zeros(len(seq), bool), np.ones(len(seq), bool)
        alive[live[frequent]] = True
        alive[take] = True
        alive[take[take > 0] - 1] = True
        stay[take + 1] = False
        seq, alive = seq[stay], alive[stay]
        live = np.flatnonzero(alive[:-1])
    flat = np.concatenate(rules) if rules else np.zeros(0, np.uint64)
    pairs = np.stack([flat >> np.uint64(32), flat & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32)
    return seq.astype(np.uint32), pairs, first


def spans(symbols: np.ndarray, lengths: np.ndarray, first: int) -> np.ndarray:
    """Ids of each symbol."""
    out = np.ones(len(symbols), np.int64)
    inner = symbols >= first
    out[inner] = lengths[symbols[inner].astype(np.int64) - first]
    return out


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, first: int) -> np.ndarray:
    """The ids of some symbols; a nonterminal hands its place to both symbols of its pair."""
    each = spans(symbols, lengths, first)
    at = np.cumsum(each) - each
    out = np.empty(int(each.sum()), np.uint32)
    while len(symbols):
        inner = symbols >= first
        out[at[~inner]] = symbols[~inner]
        pair, at = rules[symbols[inner].astype(np.int64) - first], at[inner]
        at = np.concatenate([at, at + spans(pair[:, 0], lengths, first)])
        symbols = np.concatenate([pair[:, 0], pair[:, 1]])
    return out


def expansion_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """Ids of each nonterminal; rules only use earlier ones, whole rounds at a time."""
    out = np.ones(len(rules), np.int64)
    while len(rules):
        new = spans(rules[:, 0], out, first) + spans(rules[:, 1], out, first)
        if (new == out).all():
            break
        out = new
    return out


def to_bytes(doc_ids: list[int | None], starts: np.ndarray, ids: np.ndarray, effort: Effort = Effort()) -> bytes:
    """One shard in the file format."""
    symbols, rules, first = compress(ids, effort)
    pack = zstandard.ZstdCompressor(level=1).compress
    blocks = [
        rules.astype("<u4"), expansion_lengths(rules, first).astype("<u4"),
        (symbols & np.uint32(0xFFFF)).astype("<u2"), (symbols >> np.uint32(16)).astype("<u2"),
        np.array([d or 0 for d in doc_ids], "<i8"), np.array([d is None for d in doc_ids], "u1"),
        starts.astype("<u8"),
    ]
    packed = [pack(b.tobytes()) for b in blocks]
    head = struct.pack("<6Q", len(rules), len(symbols), len(doc_ids), len(ids), first, len(blocks))
    sizes = struct.pack(f"<{len(blocks)}Q", *map(len, packed))
    return MAGIC + head + sizes + b"".join(packed)


class Shard:
    """A shard's bytes, opened for reading."""

    def __init__(self, payload: bytes) -> None:
        if payload[:4] != MAGIC:
            raise ValueError("not a grammar shard")
        n_rules, n_symbols, n_docs, self.n_ids, self.first, n_blocks = struct.unpack_from("<6Q", payload, 4)
        sizes = struct.unpack_from(f"<{n_blocks}Q", payload, 52)
        at, raw = 52 + 8 * n_blocks, []
        unpack = zstandard.ZstdDecompressor().decompress
        for size in sizes:
            raw.append(unpack(payload[at : at + size]))
            at += size
        self.rules = np.frombuffer(raw[0], "<u4").reshape(n_rules, 2)
        self.lengths = np.frombuffer(raw[1], "<u4").astype(np.int64)
        low, high = np.frombuffer(raw[2], "<u2"), np.frombuffer(raw[3], "<u2")
        self.symbols = low.astype(np.uint32) | (high.astype(np.uint32) << np.uint32(16))
        nulls = np.frombuffer(raw[5], "u1")
        self.doc_ids = [None if z else d for d, z in zip(np.frombuffer(raw[4], "<i8").tolist(), nulls)]
        self.starts = np.frombuffer(raw[6], "<u8").astype(np.int64)
        self.ends = np.cumsum(spans(self.symbols, self.lengths, self.first))

    def ids(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from ``start`` on: only the symbols that cover them are expanded."""
        if n <= 0:
            return np.zeros(0, np.uint32)
        low = int(np.searchsorted(self.ends, start, "right"))
        high = int(np.searchsorted(self.ends, start + n, "left")) + 1
        begins = int(self.ends[low - 1]) if low else 0
        part = expand(self.symbols[low:high], self.rules, self.lengths, self.first)
        return part[start - begins : start - begins + n]


def shards(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = END_ID, effort: Effort = Effort()) -> DataFrame:
    """Stored rows (part, shard, n_ids, payload), in ascending doc_id by part and shard."""
    schema = pa.schema(
        [("part", pa.int32()), ("shard", pa.int32()), ("n_ids", pa.int64()), ("payload", pa.binary())]
    )
    end = np.array([end_id], "<u4").tobytes()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, shard = word_encoder(vocabulary).encode, TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            counts = np.array([len(b) // 4 for b in held], np.int64)
            payload = to_bytes(doc_ids, np.cumsum(counts) - counts, np.frombuffer(b"".join(held), "<u4"), effort)
            return rows(schema, part=[part], shard=[shard], n_ids=[int(counts.sum())], payload=[payload])

        for batch in batches:
            for doc, text in zip(column_of(batch, "doc_id").to_pylist(), texts_of(batch)):
                doc_ids.append(doc)
                held.append(encode(text) + end)
                size += len(held[-1]) // 4
                if size >= SHARD_IDS:
                    yield flush()
                    doc_ids, held, size, shard = [], [], 0, shard + 1
        if held:
            yield flush()

    inorder = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return materialize(map_tasks(inorder, task, "part int, shard int, n_ids long, payload binary"), "shards")


def read_back(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the shards."""
    schema = pa.schema(
        [("part", pa.int32()), ("shard", pa.int32()), ("doc_id", pa.int64())]
        + [(n, pa.int64()) for n in ("at", "n_tokens", "ids_crc32")]
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                part, number, payload = (column_of(batch, n)[i].as_py() for n in ("part", "shard", "payload"))
                shard = Shard(payload)
                ids = shard.ids(0, shard.n_ids).astype("<u4")
                ends = np.append(shard.starts[1:], shard.n_ids)
                found = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(shard.starts, ends)]
                n = len(found)
                yield rows(
                    schema, part=[part] * n, shard=[number] * n, doc_id=shard.doc_ids,
                    at=shard.starts, n_tokens=ends - shard.starts, ids_crc32=found,
                )

    decoded = map_tasks(
        files.select("part", "shard", "payload"), task,
        "part int, shard int, doc_id long, at long, n_tokens long, ids_crc32 long",
    )
    # Ids before a part: one row per range partition; before a shard: within its part.
    earlier = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    parts = parts.select("part", earlier(Window.orderBy("part")).alias("before_part"))
    each = files.select("part", "shard", earlier(Window.partitionBy("part").orderBy("shard")).alias("before_shard"))
    offsets = each.join(parts, "part")
    return decoded.join(offsets, ["part", "shard"]).select(
        "doc_id", (F.col("before_part") + F.col("before_shard") + F.col("at")).alias("start"),
        "n_tokens", "ids_crc32",
    )
