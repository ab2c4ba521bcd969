"""Tables bucketed and sorted by a key, so that joins and groupings by it need no shuffle.

Bucketing sends a key to one bucket, so a key with much of the table would make one task of it.
Such keys, few by arithmetic (``scale.heavy_keys``), and rows without a key are kept beside the
buckets in a plain table, where partial aggregation and a bounded broadcast serve them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import HEAVY_SHARE, heavy_keys
from ..session import materialize, scratch_path


@dataclass(frozen=True)
class Colocated:
    """``light``: a catalog table bucketed by ``key``; ``hot``: rows of heavy keys or of none."""

    name: str
    key: str
    buckets: int
    light: DataFrame
    hot: DataFrame

    def per_key(self, summarise: Callable[[DataFrame], DataFrame], label: str) -> Colocated:
        """One row per key by ``summarise``, co-located with this table; rows without a key have none."""
        summary = summarise(self.light)
        name, light = _bucketed(summary, self.key, self.buckets, label)
        hot = materialize(summarise(self.hot.where(F.col(self.key).isNotNull())), f"{label}-hot")
        return Colocated(name, self.key, self.buckets, light, hot)

    def join(self, other: Colocated) -> DataFrame:
        """Left join with one row per key of a table that is co-located with this one.

        Buckets meet buckets; the heavy keys, at most one per ``HEAVY_SHARE``, are broadcast.
        """
        if (self.key, self.buckets) != (other.key, other.buckets):
            raise ValueError("tables are bucketed differently")
        few = other.hot.limit(int(1 / HEAVY_SHARE) + 1)
        return self.light.join(other.light, self.key, "left").unionByName(self.hot.join(F.broadcast(few), self.key, "left"))

    def drop(self) -> None:
        self.light.sparkSession.sql(f"DROP TABLE IF EXISTS {self.name}")


def _bucketed(df: DataFrame, key: str, buckets: int, label: str, sort: Sequence[str] = ()) -> tuple[str, DataFrame]:
    name = f"{label}_{uuid.uuid4().hex}".replace("-", "_")
    (
        df.write.bucketBy(buckets, key).sortBy(key, *sort).option("path", scratch_path(df.sparkSession, label))
        .format("parquet").saveAsTable(name)
    )
    return name, df.sparkSession.table(name)


def store(df: DataFrame, key: str, buckets: int, label: str, sort: Sequence[str] = ()) -> Colocated:
    """``df`` laid out once by ``key``: the one shuffle that later joins and groupings save.

    Equal ``buckets`` make tables fit each other; take about as many as the largest join has
    tasks.  Inside a bucket rows go by key, then ``sort``.
    """
    heavy = F.broadcast(heavy_keys(df, [key]).select(key))
    hot = df.join(heavy, key, "left_semi").unionByName(df.where(F.col(key).isNull()))
    light = df.where(F.col(key).isNotNull()).join(heavy, key, "left_anti")
    name, table = _bucketed(light.repartition(buckets, key), key, buckets, label, sort)
    return Colocated(name, key, buckets, table, materialize(hot.select(df.columns), f"{label}-hot"))
