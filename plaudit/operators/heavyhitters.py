"""Exact top-k in two passes, without a shuffle of the rare keys.

Each task keeps a bounded list of counters (Misra-Gries): when it overflows, all counters lose as
much as the first one beyond the limit holds.  A key's counters then miss at most the sum E of what
its tasks took away, and a key in no list occurs at most E times.  The k-th largest counter is a
lower bound of the k-th count; where it exceeds E, no unlisted key can enter the top k, and only
keys whose counter is within E of it are counted again, exactly.  Otherwise the lists are doubled;
lists that never overflow have E = 0, so this ends.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

COUNTERS = 10_000
#: Candidates up to this number are broadcast to the recount; more are joined by a shuffle.
FEW = 100_000

_SUMMARY = pa.schema([("key", pa.string()), ("n", pa.int64()), ("lost", pa.int64())])


def trimmed(counts: Counter, limit: int) -> tuple[Counter, int]:
    """At most ``limit`` counters, each less by the first one beyond it, and that amount."""
    if len(counts) <= limit:
        return counts, 0
    cut = sorted(counts.values(), reverse=True)[limit]
    return Counter({k: n - cut for k, n in counts.items() if n > cut}), cut


def summaries(keys: DataFrame, limit: int) -> DataFrame:
    """(key, n, lost): per task ``limit`` counters at most, and one row that tells what they miss."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, lost = Counter(), 0
        for batch in batches:
            seen = batch.column(0).drop_null().value_counts()
            counts.update(dict(zip(seen.field(0).to_pylist(), seen.field(1).to_pylist())))
            if len(counts) > 2 * limit:  # trimmed now and then: each cut is paid for by limit + 1 keys
                counts, cut = trimmed(counts, limit)
                lost += cut
        counts, cut = trimmed(counts, limit)
        names, numbers = list(counts.keys()), list(counts.values())
        columns = [[*names, None], [*numbers, 0], [*([0] * len(names)), lost + cut]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SUMMARY)], schema=_SUMMARY)

    return keys.mapInArrow(task, "key string, n long, lost long")


def top_keys(rows: DataFrame, key: str, k: int, name: str = "n", counters: int = COUNTERS) -> DataFrame:
    """The ``k`` most frequent values of a string column and their exact counts.

    Nulls do not count; equal counts go by value.  ``rows`` is read twice, or more often where
    frequencies are flat.
    """
    keys = rows.select(F.col(key).alias("key"))
    limit = max(counters, 2 * k)
    while True:
        listed = materialize(summaries(keys, limit), "summaries")
        lost = listed.agg(F.sum("lost")).first()[0] or 0
        sums = materialize(listed.where("key is not null").groupBy("key").agg(F.sum("n").alias("n")), "counters")
        top = [r.n for r in sums.orderBy(F.desc("n")).limit(k).collect()]  # k numbers
        least = top[-1] if len(top) == k else 0
        if lost == 0 or least > lost:
            break
        limit *= 2
    candidates = materialize(sums.where(F.col("n") + lost >= least).select("key"), "candidates")
    few = F.broadcast(candidates) if candidates.count() <= FEW else candidates
    exact = keys.join(few, "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias(name))
    return exact.orderBy(F.desc(name), F.asc("key")).limit(k).withColumnRenamed("key", key)
