"""Clustering of business vectors: k-means, quality, profiles, slider-weighted re-assignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .vectors import zscores

ASPECTS = ("food", "service", "price", "amb")

Centres = list[list[float]]


def _squared_distance(point: Column, centre: Column) -> Column:
    return F.aggregate(
        F.zip_with(point, centre, lambda x, c: (x - c) * (x - c)), F.lit(0.0), lambda total, x: total + x
    )


def _literal(centres: Centres) -> Column:
    return F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centres])


def farthest_points(points: DataFrame, k: int, key: str) -> Centres:
    """``k`` seeds: the point nearest to the origin, then always the one farthest from all seeds so far.

    ``points`` (key, features) is a stored table; equal distances go to the smallest key.  One
    aggregation per seed, and only the seed itself leaves it.  Fewer different points, fewer seeds.
    """
    origin = F.aggregate("features", F.lit(0.0), lambda total, x: total + x * x)
    first = points.agg(F.min(F.struct(origin.alias("d"), F.col(key).alias("key"), "features")).alias("m")).first()["m"]
    seeds: Centres = [] if first is None else [first["features"]]
    while seeds and len(seeds) < k:
        distance = F.array_min(F.transform(_literal(seeds), lambda c: _squared_distance(F.col("features"), c)))
        ranked = F.min(F.struct((-distance).alias("d"), F.col(key).alias("key"), "features"))
        farthest = points.agg(ranked.alias("m")).first()["m"]
        if farthest["d"] == 0:
            break
        seeds.append(farthest["features"])
    return seeds


def _nearest(centres: Column) -> Column:
    """Number of the nearest centre; equal distances go to the lowest."""
    ranked = F.transform(
        centres, lambda c, i: F.struct(_squared_distance(F.col("features"), c).alias("d"), i.alias("cluster"))
    )
    return F.array_min(ranked)["cluster"]


def lloyd(points: DataFrame, centres: Centres, max_iter: int = 50, tolerance: float = 1e-4) -> Centres:
    """Centres after moving each to the mean of its points, until none moves further than ``tolerance``.

    Every round is one pass with partial sums per task: k rows leave each task.  A centre without
    points stays where it is.
    """
    for _ in range(max_iter):
        labelled = points.select("features", _nearest(_literal(centres)).alias("cluster"))
        means = labelled.groupBy("cluster").agg(
            F.array(*[F.avg(F.col("features")[i]) for i in range(len(centres[0]))]).alias("mean")
        )
        found = {r["cluster"]: r["mean"] for r in means.collect()}  # k rows at most
        moved = [found.get(i, c) for i, c in enumerate(centres)]
        steps = [sum((x - y) ** 2 for x, y in zip(a, b)) for a, b in zip(moved, centres)]
        centres = moved
        if max(steps) <= tolerance**2:
            break
    return centres


def kmeans_clusters(
    vectors: DataFrame, k: int = 6, max_iter: int = 50, columns: Sequence[str] = ASPECTS,
    key: str = "business_id", tolerance: float = 1e-4,
) -> DataFrame:
    """Vectors with ``features`` (standardised, array) and ``cluster`` (from 0, null without features).

    Seeds and updates are deterministic, so equal rows give equal labels on any partitioning.  A
    row with a null in ``columns`` has no features.  The standardised table is stored, as it is
    read in every round; on the driver there are k centres and nothing else.
    """
    features = F.array(*[F.col(f"{c}_z") for c in columns])
    known = F.lit(True)
    for c in columns:
        known = known & F.col(c).isNotNull()
    standard = zscores(vectors, columns).withColumn("features", F.when(known, features))
    stored = materialize(standard.drop(*[f"{c}_z" for c in columns if f"{c}_z" not in vectors.columns]), "standard")
    points = stored.where(F.col("features").isNotNull()).select(F.col(key), "features")
    seeds = farthest_points(points, k, key)
    if not seeds:
        return stored.withColumn("cluster", F.lit(None).cast("int"))
    centres = lloyd(points, seeds, max_iter, tolerance)
    return stored.withColumn("cluster", F.when(F.col("features").isNotNull(), _nearest(_literal(centres))))


def silhouette_values(clustered: DataFrame) -> DataFrame:
    """Adds ``silhouette`` under squared Euclidean distance, in closed form.

    The mean squared distance from x to a cluster of n points with sum S and sum of squares Q is
    |x|^2 - 2 x S / n + Q / n, so one row per cluster is all a point needs.  In its own cluster
    the point itself does not count; a point alone in its cluster, or with no other cluster, gets 0.
    """
    square = F.aggregate("features", F.lit(0.0), lambda total, x: total + x * x)
    labelled = clustered.where(F.col("cluster").isNotNull() & F.col("features").isNotNull())
    width = labelled.select(F.max(F.size("features"))).first()[0] or 0
    sums = labelled.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.sum(square).alias("q"),
        F.array(*[F.sum(F.col("features")[i]) for i in range(width)]).alias("s"),
    )
    groups = sums.agg(F.array_sort(F.collect_list(F.struct("cluster", "n", "q", "s")))).scalar()
    held = clustered.withColumn("__groups", groups).withColumn("__square", square)

    def total(g: Column) -> Column:
        inner = F.aggregate(F.zip_with("features", g["s"], lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
        return F.greatest(F.lit(0.0), g["n"] * F.col("__square") - 2 * inner + g["q"])

    own = F.get(F.filter("__groups", lambda g: g["cluster"] == F.col("cluster")), F.lit(0))
    others = F.filter("__groups", lambda g: g["cluster"] != F.col("cluster"))
    held = held.withColumns(
        {
            "__a": F.when(own["n"] > 1, total(own) / (own["n"] - 1)),
            "__b": F.array_min(F.transform(others, lambda g: total(g) / g["n"])),
        }
    )
    largest = F.greatest("__a", "__b")
    value = F.coalesce(F.try_divide(F.col("__b") - F.col("__a"), F.nullif(largest, F.lit(0.0))), F.lit(0.0))
    value = F.when(F.col("__a").isNull() | F.col("__b").isNull(), 0.0).otherwise(value)
    return held.withColumn("silhouette", F.when(F.col("cluster").isNotNull(), value)).drop("__groups", "__square", "__a", "__b")


def silhouette(clustered: DataFrame) -> float | None:
    """Mean silhouette of all labelled rows."""
    return silhouette_values(clustered).agg(F.avg("silhouette")).first()[0]


def describe_clusters(clustered: DataFrame, business: DataFrame) -> DataFrame:
    """Clustered vectors with the metadata of their business: one row per business on both sides."""
    meta = business.select(
        "business_id", "name", "city", "state", "categories", "stars", "review_count"
    )
    return clustered.join(meta, "business_id", "left")


def cluster_profile(clustered: DataFrame, columns: Sequence[str] = ASPECTS) -> DataFrame:
    """Centre and size of each cluster."""
    return clustered.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"avg_{c}") for c in columns]
    )


def nearest_label(
    centres: Column, values: Sequence[Column], weights: Sequence[float], names: Sequence[str]
) -> Column:
    """Label of the nearest centre in an array of structs (cluster, <names>).

    Distance is the sum of (w * (x - c))^2, so a weight acts squared; equal distances go to the
    lowest label.
    """

    def distance(c: Column) -> Column:
        total = F.lit(0.0)
        for value, weight, name in zip(values, weights, names):
            total = total + F.pow(F.lit(float(weight)) * (value - c[name]), F.lit(2.0))
        return total

    ranked = F.transform(centres, lambda c: F.struct(distance(c).alias("d"), c["cluster"].alias("cluster")))
    return F.array_min(ranked)["cluster"]


def assign_fixed(
    df: DataFrame, centres: Sequence[Sequence[float]], columns: Sequence[str] = ASPECTS
) -> DataFrame:
    """``cluster`` of the nearest given centre, numbered from 0."""
    table = F.array(
        *[
            F.struct(
                F.lit(i).alias("cluster"), *[F.lit(float(v)).alias(c) for v, c in zip(row, columns)]
            )
            for i, row in enumerate(centres)
        ]
    )
    label = nearest_label(table, [F.col(c) for c in columns], [1.0] * len(columns), columns)
    return df.withColumn("cluster", label)


def weighted_assign(
    labelled: DataFrame, weights: Sequence[float] = (1.0, 1.0, 1.0, 1.0),
    columns: Sequence[str] = tuple(f"{a}_z" for a in ASPECTS),
) -> DataFrame:
    """Adds ``cluster_weighted``: the nearest centroid of the existing clusters under slider weights.

    The centroids, one row per cluster, reach the rows as one array-valued scalar subquery.  A
    single cluster means a single centroid at the global mean, labelled 0.
    """
    centroids = labelled.where(F.col("cluster").isNotNull()).groupBy("cluster").agg(
        *[F.avg(c).alias(c) for c in columns]
    )
    array = centroids.agg(
        F.array_sort(F.collect_list(F.struct("cluster", *columns))).alias("c")
    ).scalar()
    held = labelled.withColumn("__centres", array)
    near = nearest_label(F.col("__centres"), [F.col(c) for c in columns], weights, columns)
    label = F.when(F.size("__centres") >= 2, near).otherwise(F.lit(0))
    return held.withColumn("cluster_weighted", label).drop("__centres")


def cluster_size_compare(
    df: DataFrame, one: str = "cluster", other: str = "cluster_weighted"
) -> DataFrame:
    """Sizes under two labellings, aligned by label; an absent label counts 0.

    Each row casts one vote per labelling, so a single aggregation replaces a full join.
    """
    votes = df.select(
        F.inline(
            F.array(
                F.struct(F.col(one).alias("label"), F.lit(1).alias("a"), F.lit(0).alias("b")),
                F.struct(F.col(other).alias("label"), F.lit(0).alias("a"), F.lit(1).alias("b")),
            )
        )
    )
    return (
        votes.where(F.col("label").isNotNull())
        .groupBy("label")
        .agg(F.sum("a").alias("original"), F.sum("b").alias("weighted"))
    )
