"""Best-fit packing of token pieces by exact complements.

The plan is made from the counts per length alone (as many numbers as the capacity, whatever the
corpus).  For each length, largest first, single lengths, pairs and triples whose sum fills the
gap exactly are looked up and consumed as often as all of them are available; what is left is
placed best-fit by decreasing length.  Pairs and triples of small lengths can take what later gaps
need, so the plan is made once for each of ``RESERVES`` (lengths below it stay out of pairs and
triples) and the one of the fewest sequences counts.  Each step uses up a length or a group of
open sequences, so the plan has a few thousand entries at most.  Pieces then find their place by their rank among
the pieces of their length; ranks are counted per length and salt, so no length is one group.

Contract: null text is empty (one piece, the end id).  Repeated rows are packed each.  An empty
table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plaudit.llm.batches import column_of, map_tasks, rows, texts_of
from plaudit.llm.tokens import byte_encoder
from plaudit.session import materialize

CAPACITY = 1024
END_ID = 2
SALT_ROWS = 500_000  # pieces per salt of one length, about
RESERVES = (0, 1 / 32, 1 / 16, 1 / 8, 3 / 16, 1 / 4, 3 / 8, 1 / 2)  # of the capacity

Plan = list[tuple[tuple[int, ...], int]]


def cut(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of ``n`` tokens: all full but the first, which takes the rest."""
    rest = n % capacity
    return ([rest] if rest else []) + [capacity] * (n // capacity)


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the pieces of every document."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("piece", pa.int32())]
        + [(n, pa.int64()) for n in ("start", "length", "ids_crc32")]
    )
    end = np.array([end_id], "<u4").tobytes()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_encoder(vocabulary).encode
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(column_of(batch, "doc_id").to_pylist(), texts_of(batch)):
                ids = encode(text) + end
                start = 0
                for i, n in enumerate(cut(len(ids) // 4, capacity)):
                    out.append((doc, i, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])))
                    start += n
            yield rows(schema, **dict(zip(schema.names, zip(*out)))) if out else rows(
                schema, **{n: [] for n in schema.names}
            )

    return map_tasks(
        docs.select("doc_id", "text"), task,
        "doc_id long, piece int, start long, length long, ids_crc32 long",
    )


def _times(parts: tuple[int, ...], left: np.ndarray) -> int:
    """How often the parts are available together."""
    return min(int(left[p]) // parts.count(p) for p in set(parts))


def _sums(total: int, left: np.ndarray, size: int, least: int = 1) -> Iterator[tuple[int, ...]]:
    """Available lengths, ``size`` of them and none below ``least``, that add up to ``total``; largest first."""
    if size == 1:
        if total >= least and left[total]:
            yield (total,)
    elif size == 2:
        half = np.arange((total + 1) // 2, total - least + 1)
        for a in half[(left[half] > 0) & (left[total - half] > 0)][::-1].tolist():
            yield (a, total - a)
    else:
        most = np.arange(-(-total // 3), total - 2 * least + 1)
        for a in most[left[most] > 0][::-1].tolist():
            for b, c in _sums(total - a, left, 2, least):
                if b <= a:
                    yield (a, b, c)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Sequences as (lengths, how many such sequences); every piece is used exactly once."""
    least = -(-sum(length * n for length, n in counts.items()) // capacity)
    best: tuple[int, Plan] | None = None
    for reserve in RESERVES:
        made = _complements(counts, capacity, max(1, int(reserve * capacity)))
        n = sum(many for _, many in made)
        if best is None or n < best[0]:
            best = n, made
        if n == least:
            break
    return best[1] if best else []


def _complements(counts: dict[int, int], capacity: int, reserve: int) -> Plan:
    """Exact complements, pairs and triples of lengths from ``reserve`` on, then best fit."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] += n
    made: Plan = []
    if left[capacity]:
        made.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    for size, least in ((1, 1), (2, reserve), (3, reserve)):
        for length in range(capacity - 1, 0, -1):
            if not left[length]:
                continue
            for others in _sums(capacity - length, left, size, least):
                n = _times((length, *others), left)
                if n:
                    for p in (length, *others):
                        left[p] -= n
                    made.append(((length, *others), n))
                if not left[length]:
                    break
    return made + _best_fit(left, capacity)


def _best_fit(left: np.ndarray, capacity: int) -> Plan:
    """Decreasing best fit of what remains, whole groups of equal sequences at a time."""
    by_gap: dict[int, dict[tuple[int, ...], int]] = {}
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            gap = min((g for g in by_gap if g >= length and by_gap[g]), default=None)
            if gap is None:
                fit = capacity // length
                whole, rest = divmod(n, fit)
                for times, many in ((fit, whole), (rest, 1)):
                    if times and many:
                        group = by_gap.setdefault(capacity - times * length, {})
                        group[(length,) * times] = group.get((length,) * times, 0) + many
                break
            open_, many = by_gap[gap].popitem()
            used = min(n, many)
            if many > used:
                by_gap[gap][open_] = many - used
            group = by_gap.setdefault(gap - length, {})
            group[(*open_, length)] = group.get((*open_, length), 0) + used
            n -= used
    return [(parts, n) for group in by_gap.values() for parts, n in group.items()]


def slots(made: Plan) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): where ranked pieces go."""
    out, ranks, sequence = [], {}, 0
    for parts, n in made:
        offset = 0
        for length in parts:
            rank = ranks.get(length, 0)
            out.append((length, rank, rank + n, sequence, offset))
            ranks[length] = rank + n
            offset += length
        sequence += n
    return out


def ranked(cut_pieces: DataFrame, total: int) -> DataFrame:
    """Adds ``rank``, 0, 1, 2 ... within each length."""
    salts = max(16, total // SALT_ROWS + 1)
    salted = cut_pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    sizes = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    return salted.withColumn("own", F.row_number().over(own) - 1).join(first, ["length", "salt"]).withColumn(
        "rank", F.col("base") + F.col("own")
    ).drop("salt", "own", "base")


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset; ``cut_pieces`` has doc_id, piece, length and ids_crc32."""
    spark = cut_pieces.sparkSession
    counts = {r.length: r.n for r in cut_pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = slots(plan(counts, capacity))
    table = spark.createDataFrame(
        places or [(0, 0, 0, 0, 0)], "length long, low long, high long, sequence long, offset long"
    )
    # At most ``capacity`` rows with a few thousand places in all.
    of_length = table.groupBy("length").agg(F.collect_list(F.struct("low", "high", "sequence", "offset")).alias("places"))
    at = F.filter("places", lambda p: (p["low"] <= F.col("rank")) & (F.col("rank") < p["high"]))[0]
    put = ranked(cut_pieces, sum(counts.values())).join(F.broadcast(of_length), "length").withColumn("at", at)
    return put.withColumn(
        "sequence_id", F.col("at.sequence") + F.col("rank") - F.col("at.low")
    ).withColumn("offset", F.col("at.offset")).drop("at", "places", "rank")


def packed(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    cut_pieces = materialize(pieces(docs, capacity, end_id, vocabulary), "pieces")
    return pack(cut_pieces, capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
