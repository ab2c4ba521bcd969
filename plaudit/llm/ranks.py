"""Positions and running sums inside groups of any size, without one task per group.

A window over a group puts the whole group into one task.  Here rows are ordered over the whole
cluster by range, so a large group covers many partitions; each partition counts its own part, and
only one row per (group, partition) is ordered inside a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plaudit.session import materialize

#: Positions of one block of ``running``; bounds what a window holds.
BLOCK = 4096


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """``df`` with ``pos``, 1, 2, ... inside each group of ``keys`` (never null), by ``order``.

    Rows equal in all of ``order`` get positions in any order; make it total where that matters.
    Without keys the positions run over the whole table.  The ordered rows are stored, so a
    lost executor gives no row another position.
    """
    # A range needs a first column: without keys the order alone deals the rows out.
    by = [*keys, *order]
    ordered = materialize(
        df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__seq", F.monotonically_increasing_id()),
        "ordered",
    ).withColumn("__part", F.shiftright("__seq", 33))
    parts = ordered.groupBy(*keys, "__part").agg(F.min("__seq").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    return ordered.join(parts, [*keys, "__part"]).select(
        *df.columns, (F.col("__before") + F.col("__seq") - F.col("__first") + 1).alias("pos")
    )


def running(
    df: DataFrame, key: str, pos: str, sums: dict[str, Column], backwards: bool = False
) -> DataFrame:
    """``df`` with running sums along ``pos`` (unique inside ``key``), this row included.

    A group is cut into blocks of positions; blocks are summed first, so no window holds more
    than one block of rows or one row per block of a group.
    """
    named = df.withColumn("__block", F.floor(F.col(pos) / BLOCK))
    for name, value in sums.items():
        named = named.withColumn(f"__{name}", value)
    turned = F.col("__block").desc() if backwards else F.col("__block")
    earlier = Window.partitionBy(key).orderBy(turned).rowsBetween(Window.unboundedPreceding, -1)
    blocks = named.groupBy(key, "__block").agg(*[F.sum(f"__{n}").alias(f"__{n}") for n in sums]).select(
        key, "__block", *[F.coalesce(F.sum(f"__{n}").over(earlier), F.lit(0)).alias(f"__before_{n}") for n in sums]
    )
    inside = Window.partitionBy(key, "__block").orderBy(F.col(pos).desc() if backwards else F.col(pos))
    inside = inside.rowsBetween(Window.unboundedPreceding, 0)
    return named.join(blocks, [key, "__block"]).select(
        *df.columns, *[(F.col(f"__before_{n}") + F.sum(f"__{n}").over(inside)).alias(n) for n in sums]
    )
