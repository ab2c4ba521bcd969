"""Connected components of an edge table, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaudit.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of ``edges`` (a, b); equal roots mean connected.

    Every node hooks to its smallest neighbour in a hashed order, hooked nodes merge, and the
    edges between what is left go on; a constant share of nodes goes each round, whatever their
    numbering.  Each round is stored, so a lost executor costs one round.  Self-loops and
    repeated edges do no harm; null ends are dropped.
    """
    edges = edges.select("a", "b").dropna()
    labels = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        key = F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("id"))
        own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("id"))
        hooks = materialize(
            both.groupBy("a").agg(F.min(key).alias("m")).select(
                F.col("a").alias("node"), F.least(own, "m")["id"].alias("to")
            ),
            "hooks",
        )
        if labels is None:
            labels = hooks.select("node", F.col("to").alias("root"))
        else:
            step = hooks.select(F.col("node").alias("root"), "to")
            labels = labels.join(step, "root", "left").select(
                "node", F.coalesce("to", "root").alias("root")
            )
        labels = materialize(labels, "labels")
        a = hooks.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        b = hooks.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        edges = materialize(
            edges.join(a, "a").join(b, "b").where("ta <> tb")
            .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(),
            "edges",
        )
        if edges.isEmpty():
            return labels
