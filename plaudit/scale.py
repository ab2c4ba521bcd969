"""Building blocks that keep plans sound when tables grow and keys are skewed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import materialize

# A key is heavy when it holds more than this share of the rows.  At most 1 / HEAVY_SHARE keys
# can be heavy, whatever the data: that bound is what allows the heavy keys to be broadcast.
HEAVY_SHARE = 0.002
# Rows without a key meet nothing; they spread over so many partitions.
NULL_SPREAD = 4096

_SALTS, _SALT = "__salts", "__salt"


def size_bound(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan; joins multiply, so derived tables only overstate it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread_small(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a small input over the cores before heavy per-row work.

    A small table in one file is one busy task, whatever the cluster.  Up to 32 MB per core an
    exchange costs less than idle cores; larger inputs already have enough splits and stay as they
    are, without a shuffle.  Rows go by the hash of ``keys``, the same way on a re-run.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if size_bound(df) > cores * 32 * 1024 * 1024:
        return df
    return df.repartition(cores, *keys)


def heavy_keys(
    rows: DataFrame, keys: Sequence[str], share: float = HEAVY_SHARE, count: str | None = None
) -> DataFrame:
    """(keys, __salts) of the keys with more than ``share`` of the rows, stored.

    A key of n such shares gets n salts, so no part holds much more than one share.  ``count``
    names a column of ``rows`` that already counts them, one row per key.  Make it once from the
    source of a join's keys and hand it to ``join_dimension``.
    """
    n = F.count(F.lit(1)) if count is None else F.sum(count)
    counts = rows.dropna(subset=list(keys)).groupBy(*keys).agg(n.alias("__n"))
    total = counts.agg(F.sum("__n")).first()[0] or 0
    heavy = counts.where(F.col("__n") > total * share).select(
        *keys, F.ceil(F.col("__n") / (total * share or 1)).cast("int").alias(_SALTS)
    )
    return materialize(heavy, "heavy-keys")


def join_dimension(
    fact: DataFrame,
    dim: DataFrame,
    on: str | Sequence[str],
    how: str = "left",
    spread: Sequence[str] | None = None,
    heavy: DataFrame | None = None,
) -> DataFrame:
    """Equi-join of many ``fact`` rows to one ``dim`` row per key.

    One shuffle of either side, or none where Catalyst broadcasts; adaptive execution splits
    skewed partitions.  In a left join rows without a key are dealt out by a hash of ``spread``,
    so they meet in no task.  ``heavy``, a stored table from ``heavy_keys``, also splits those
    keys over as many salts as they have shares of the rows, and copies their ``dim`` rows to match.
    The salt is a hash of row columns, so a re-run of a lost task sends each row to the same place.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if how not in ("left", "inner", "left_semi"):
        raise ValueError(f"join_dimension keeps fact rows; how={how!r} is not supported")
    if heavy is None and how != "left":
        return fact.join(dim, keys, how)
    simple = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)
    cheap = [f.name for f in fact.schema.fields if isinstance(f.dataType, simple)]
    dealt = F.xxhash64(*(spread or cheap or keys))
    no_key = F.lit(False)
    for key in keys:
        no_key = no_key | F.col(key).isNull()
    salt = F.when(no_key, F.pmod(dealt, F.lit(NULL_SPREAD)).cast("int"))
    if heavy is None:
        salted = fact.withColumn(_SALT, salt.otherwise(0))
        copied = dim.withColumn(_SALT, F.lit(0))
    else:
        few = F.broadcast(heavy)
        split = F.pmod(dealt, F.col(_SALTS)).cast("int")
        salted = fact.join(few, keys, "left").withColumn(
            _SALT, salt.when(F.col(_SALTS).isNotNull(), split).otherwise(0)
        ).drop(_SALTS)
        every = F.sequence(F.lit(0), F.coalesce(_SALTS, F.lit(1)) - 1)
        copied = dim.join(few, keys, "left").withColumn(_SALT, F.explode(every)).drop(_SALTS)
    return salted.join(copied, [*keys, _SALT], how).drop(_SALT)


def _digest(key: str, seed: str):
    """Hash of a key; a null key is a key like any other."""
    return F.md5(F.concat(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("\u0000"))))


def hash_ordered_sample(df: DataFrame, key: str, n: int, seed: str = "42") -> DataFrame:
    """Exactly ``n`` rows (fewer if there are fewer), first by the hash of ``key``.

    The same rows on any partitioning.  A count per 4-digit hash prefix (65,536 rows at most)
    finds the prefix at which ``n`` rows are reached; earlier ones are kept whole.
    """
    tagged = df.withColumn("__h", _digest(key, seed)).withColumn("__p", F.substring("__h", 1, 4))
    prefixes = tagged.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    reached = prefixes.withColumn("__run", F.sum("__n").over(Window.orderBy("__p")))
    last = reached.where(F.col("__run") >= n).orderBy("__p").select("__p", F.col("__run") - F.col("__n")).first()
    cut, before = last if last is not None else ("g", n)
    # Only the last prefix, one in 65,536 of the rows, is ordered.
    rest = tagged.where(F.col("__p") == cut).orderBy("__h", key).limit(n - before)
    return tagged.where(F.col("__p") < cut).unionByName(rest).drop("__h", "__p")


def hash_fraction_sample(df: DataFrame, key: str, fraction: float, seed: str = "3") -> DataFrame:
    """Rows whose hashed ``key`` falls in the lowest ``fraction`` of 65,536 slots; no shuffle."""
    cut = f"{round(fraction * 65536):05x}"
    return df.where(F.concat(F.lit("0"), F.substring(_digest(key, seed), 1, 4)) < F.lit(cut))


def exact_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], by: str, accuracy: int = 100_000
) -> DataFrame:
    """Exact, linearly interpolated quantiles of ``value`` per ``by`` (a few groups only).

    ``percentile`` would keep every distinct value of a group in one buffer.  Here a bounded
    sketch brackets each rank, equal values are counted before the shuffle, all values below the
    bracket collapse to one row, and only the bracket (about ``20 / accuracy`` of the values) is
    ordered.  A rank outside its bracket stops the job rather than giving a wrong number.
    Returns rows (by, p, q).
    """
    slack = 10.0 / accuracy
    x = F.col(value).cast("double")
    known = df.where(x.isNotNull()).select(F.col(by), x.alias("__v"))
    lows = [max(0.0, p - slack) for p in probs]
    highs = [min(1.0, p + slack) for p in probs]
    sketch = known.groupBy(by).agg(
        F.count(F.lit(1)).alias("__n"),
        F.min("__v").alias("__min"),
        F.max("__v").alias("__max"),
        F.percentile_approx("__v", lows, accuracy).alias("__lo"),
        F.percentile_approx("__v", highs, accuracy).alias("__hi"),
    )
    few = F.col("__n") <= accuracy
    ranks = sketch.select(
        by,
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(float(p)).alias("p"),
                        (F.lit(float(p)) * (F.col("__n") - 1)).alias("__pos"),
                        F.when(few, F.col("__min")).otherwise(F.col("__lo")[i]).alias("__lo"),
                        F.when(few, F.col("__max")).otherwise(F.col("__hi")[i]).alias("__hi"),
                    )
                    for i, p in enumerate(probs)
                ]
            )
        ),
    )
    counted = known.groupBy(by, "__v").agg(F.count(F.lit(1)).alias("__n"))
    bracketed = (
        counted.join(F.broadcast(ranks), by)
        .where(F.col("__v") <= F.col("__hi"))
        .groupBy(by, "p", "__pos", F.when(F.col("__v") >= F.col("__lo"), F.col("__v")).alias("__v"))
        .agg(F.sum("__n").alias("__n"))
    )
    in_order = Window.partitionBy(by, "p").orderBy(F.col("__v").asc_nulls_first())
    running = bracketed.withColumn("__run", F.sum("__n").over(in_order))
    floor, ceil = F.floor("__pos"), F.ceil("__pos")
    missed = F.col("__v").isNull() & (F.col("__run") > floor)
    ends = running.groupBy(by, "p", "__pos").agg(
        F.bool_or(missed).alias("__missed"),
        F.min(F.when(F.col("__run") > floor, F.col("__v"))).alias("__a"),
        F.min(F.when(F.col("__run") > ceil, F.col("__v"))).alias("__b"),
    )
    interpolated = F.col("__a") + (F.col("__b") - F.col("__a")) * (F.col("__pos") - floor)
    return ends.select(
        by,
        "p",
        F.when(
            F.col("__missed") | F.col("__b").isNull(), F.raise_error(F.lit("rank outside bracket"))
        )
        .otherwise(interpolated)
        .cast("double")
        .alias("q"),
    )


def scalar_struct(df: DataFrame, **columns: Column) -> Column:
    """One-row aggregates of ``df`` as a single struct-valued scalar subquery."""
    return df.agg(F.struct(*[c.alias(name) for name, c in columns.items()]).alias("s")).scalar()
