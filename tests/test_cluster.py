"""k-means and silhouette against plain loops and against the library's own evaluator."""

import random

import numpy as np
import pytest
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from plaudit.operators import cluster

ASPECTS = ["food", "service", "price", "amb"]
SCHEMA = "business_id long, food double, service double, price double, amb double"


def points(seed, n=240):
    rng = random.Random(seed)
    middles = [[rng.uniform(-1, 1) for _ in ASPECTS] for _ in range(7)]
    return [(i, *[round(rng.gauss(m, 0.2), 3) for m in rng.choice(middles)]) for i in range(n)]


def plain(rows, k, rounds=50, tolerance=1e-4):
    ids = [r[0] for r in rows]
    x = np.array([r[1:] for r in rows])
    x = (x - x.mean(0)) / x.std(0, ddof=1)
    d = lambda c: ((x - c) ** 2).sum(1)
    seeds = [x[min(range(len(x)), key=lambda i: (d(0)[i], ids[i]))]]
    while len(seeds) < k:
        near = np.min([d(c) for c in seeds], axis=0)
        seeds.append(x[min(range(len(x)), key=lambda i: (-near[i], ids[i]))])
    centres = np.array(seeds)
    for _ in range(rounds):
        labels = np.argmin([d(c) for c in centres], axis=0)
        moved = np.array([x[labels == j].mean(0) if (labels == j).any() else centres[j] for j in range(k)])
        step = ((moved - centres) ** 2).sum(1).max()
        centres = moved
        if step <= tolerance**2:
            break
    return x, dict(zip(ids, np.argmin([d(c) for c in centres], axis=0).tolist()))


def plain_silhouettes(x, labels):
    out = []
    for i, own in enumerate(labels):
        d = ((x - x[i]) ** 2).sum(1)
        means = {c: d[labels == c].sum() / max(1, (labels == c).sum() - (c == own)) for c in set(labels)}
        a, b = means.pop(own), min(means.values(), default=None)
        out.append(0.0 if b is None or (labels == own).sum() == 1 or max(a, b) == 0 else (b - a) / max(a, b))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_kmeans_equals_plain_loops(spark, seed):
    rows = points(seed)
    x, want = plain(rows, 5)
    df = spark.createDataFrame(rows, SCHEMA)
    for parts in (1, 7):
        found = cluster.kmeans_clusters(df.repartition(parts), 5)
        assert {r.business_id: r.cluster for r in found.collect()} == want
    by_id = {r.business_id: r.silhouette for r in cluster.silhouette_values(found).collect()}
    labels = np.array([want[r[0]] for r in rows])
    assert [by_id[r[0]] for r in rows] == pytest.approx(plain_silhouettes(x, labels), abs=1e-9)
    vectors = found.withColumn("v", array_to_vector("features"))
    evaluator = ClusteringEvaluator(featuresCol="v", predictionCol="cluster", distanceMeasure="squaredEuclidean")
    assert cluster.silhouette(found) == pytest.approx(evaluator.evaluate(vectors), abs=1e-9)


def test_few_points_nulls_and_constant_columns(spark):
    rows = [(1, 0.0, 1.0, 5.0, 0.0), (2, 0.0, 1.0, 5.0, 0.0), (3, 1.0, 2.0, 5.0, 0.0), (4, None, 1.0, 5.0, 0.0)]
    found = cluster.kmeans_clusters(spark.createDataFrame(rows, SCHEMA).withColumn("features", F.lit("x")), 4)
    labels = {r.business_id: r.cluster for r in found.collect()}
    assert labels[1] == labels[2] != labels[3] and labels[4] is None
    values = {r.business_id: r.silhouette for r in cluster.silhouette_values(found).collect()}
    assert values == {1: 1.0, 2: 1.0, 3: 0.0, 4: None}
    empty = cluster.kmeans_clusters(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and cluster.silhouette(empty) is None
    one = cluster.kmeans_clusters(spark.createDataFrame(rows[:2], SCHEMA))
    assert {r.cluster for r in one.collect()} == {0} and cluster.silhouette(one) == 0.0


def test_a_centre_without_points_stays(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [1.0])], "business_id long, features array<double>")
    assert cluster.lloyd(df, [[0.0], [1.0], [9.0]]) == [[0.0], [1.0], [9.0]]
