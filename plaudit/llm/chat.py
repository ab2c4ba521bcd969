r"""Conversations from reply trees, with built-in functions only.

A row is a node that replies to its parent.  Iterative self-joins double the reach of every node
(1, 2, 4 ... ancestors), so a tree of depth d takes log2(d) joins.  They give each leaf its root,
depth and mean score; the best ``keep`` leaves of each root are chosen, and the stored jumps then
enumerate the nodes of the chosen root-to-leaf paths alone.  Each path becomes one conversation.

The template writes a turn as ``<|turn|>role<|text|>text<|end|>`` and a newline.  Inside roles and
texts ``\`` becomes ``\\`` and ``<|`` becomes ``<\|``, so no control string occurs there and the
escape can be undone.  The loss mask lists the code points of the assistant texts.

Contract: null role and text are empty; rows without a conversation id are left out; null turns
come first and rows of equal turn go by role, then text, so repeated rows are turns of their own.
Nodes whose ancestors form a ring reach no root and are on no path; a parent that is not there
makes a node a root.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plaudit.session import materialize

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
ASSISTANT = "assistant"


def escape(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"\\([\\|])", "$1")


def as_chains(conversations: DataFrame) -> DataFrame:
    """(conv_id, node, parent, role, text, score): every turn replies to the one before it."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return (
        conversations.where("conv_id is not null")
        .select("conv_id", "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
        .withColumn("node", F.row_number().over(order).cast("long"))
        .select(
            "conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
            "role", "text", F.lit(0.0).alias("score"),
        )
    )


def jumps(nodes: DataFrame) -> list[DataFrame]:
    """Stored tables (conv_id, node, up, steps, total, top): ``up`` is ``steps`` above the node, or
    the root if that is nearer (null for a root itself); ``total`` sums the scores below ``up``;
    ``top``: nothing stands above ``up``.  Only nodes that are not at the top yet are joined again.
    """
    known = nodes.select("conv_id", F.col("node").alias("parent"), F.lit(True).alias("there"))
    up = F.when(F.col("there"), F.col("parent"))
    first = materialize(
        nodes.join(known, ["conv_id", "parent"], "left").select(
            "conv_id", "node", up.alias("up"),
            F.when(up.isNotNull(), 1).otherwise(0).cast("long").alias("steps"),
            F.coalesce("score", F.lit(0.0)).alias("total"),
        ),
        "jumps",
    )
    roots = first.where("up is null").select("conv_id", F.col("node").alias("up"), F.lit(True).alias("root"))
    top = F.col("up").isNull() | F.col("root").isNotNull()
    tables = [materialize(first.join(roots, ["conv_id", "up"], "left").withColumn("top", top).drop("root"), "jumps")]
    open_before = None
    while True:
        last = tables[-1]
        open_now = last.where("not top").count()
        if open_now == 0:
            return tables
        if open_now == open_before:  # what is still open runs in rings
            tables.append(last.where("top"))
            return tables
        open_before = open_now
        above = last.where("up is not null").select(
            "conv_id", F.col("node").alias("up"), F.col("up").alias("up2"),
            F.col("steps").alias("steps2"), F.col("total").alias("total2"), F.col("top").alias("top2"),
        )
        moved = last.where("not top").join(above, ["conv_id", "up"]).select(
            "conv_id", "node", F.col("up2").alias("up"), (F.col("steps") + F.col("steps2")).alias("steps"),
            (F.col("total") + F.col("total2")).alias("total"), F.col("top2").alias("top"),
        )
        tables.append(materialize(last.where("top").unionByName(moved), "jumps"))


def best_leaves(nodes: DataFrame, tables: list[DataFrame], keep: int = 1) -> DataFrame:
    """(conv_id, leaf, depth): of every root the ``keep`` leaves with the highest mean score."""
    ends = tables[-1]
    parents = nodes.select("conv_id", F.col("parent").alias("node")).where("node is not null").distinct()
    roots = ends.where("up is null").select("conv_id", F.col("node").alias("root"), F.col("total").alias("own"))
    leaves = ends.join(parents, ["conv_id", "node"], "left_anti").withColumn("root", F.coalesce("up", "node"))
    scored = leaves.join(roots, ["conv_id", "root"]).withColumn(
        "mean",
        (F.col("total") + F.when(F.col("up").isNull(), 0.0).otherwise(F.col("own"))) / (F.col("steps") + 1),
    )
    rank = F.row_number().over(
        Window.partitionBy("conv_id", "root").orderBy(F.desc("mean"), F.desc("steps"), "node")
    )
    return scored.withColumn("rank", rank).where(F.col("rank") <= keep).select(
        "conv_id", F.col("node").alias("leaf"), F.col("steps").alias("depth")
    )


def path_nodes(leaves: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """(conv_id, leaf, node, depth): every node between each leaf and its root."""
    found = leaves.select("conv_id", "leaf", F.col("leaf").alias("node"), "depth")
    for k, table in enumerate(tables):
        exact = table.where((F.col("steps") == 1 << k) & F.col("up").isNotNull()).select("conv_id", "node", "up")
        higher = found.join(exact, ["conv_id", "node"]).select(
            "conv_id", "leaf", F.col("up").alias("node"), (F.col("depth") - (1 << k)).alias("depth")
        )
        found = materialize(found.unionByName(higher), "paths")
    return found


def formatted(nodes: DataFrame, keep: int = 1) -> DataFrame:
    """conv_id, leaf, conversation, loss: one row per chosen path.

    ``loss``: array of (start, end), code points of the assistant texts inside ``conversation``.
    """
    nodes = materialize(nodes, "nodes")
    tables = jumps(nodes)
    paths = path_nodes(best_leaves(nodes, tables, keep), tables)
    turns = (
        paths.join(nodes.select("conv_id", "node", "role", "text"), ["conv_id", "node"])
        .withColumn("head", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT)))
        .withColumn("body", escape(F.col("text")))
        .withColumn("turn", F.concat("head", "body", F.lit(END)))
    )
    before = Window.partitionBy("conv_id", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    placed = turns.withColumn("at", F.coalesce(F.sum(F.length("turn")).over(before), F.lit(0)) + F.length("head"))
    mask = F.when(
        F.col("role") == ASSISTANT,
        F.struct(F.col("at").alias("start"), (F.col("at") + F.length("body")).alias("end")),
    )
    part = F.struct("depth", "turn", mask.alias("mask"))
    path = placed.groupBy("conv_id", "leaf").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return path.select(
        "conv_id", "leaf",
        F.array_join(F.transform("parts", lambda p: p["turn"]), "").alias("conversation"),
        F.filter(F.transform("parts", lambda p: p["mask"]), lambda m: m.isNotNull()).alias("loss"),
    )


def read_back(conversations: DataFrame) -> DataFrame:
    """Adds ``turns``, array of (role, text), and ``loss_text``, from the formatted text."""
    pieces = F.filter(F.split("conversation", r"<\|end\|>\n"), lambda p: p != "")
    halves = F.transform(pieces, lambda p: F.split(F.substr(p, F.lit(len(TURN) + 1)), r"<\|text\|>", 2))
    return conversations.withColumn("halves", halves).select(
        *conversations.columns,
        F.transform(
            "halves", lambda h: F.struct(unescape(h[0]).alias("role"), unescape(h[1]).alias("text"))
        ).alias("turns"),
        F.array_join(
            F.transform(
                "loss",
                lambda m: unescape(
                    F.substr("conversation", (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int"))
                ),
            ),
            "",
        ).alias("loss_text"),
    )


def digests(nodes: DataFrame) -> DataFrame:
    """What can be read back from the formatted conversations, as counts and hashes."""
    line = F.lit("\n")
    said = F.transform("turns", lambda t: F.concat(t["role"], line, t["text"], line))
    return read_back(formatted(nodes)).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("conversation").cast("long").alias("formatted_chars"),
    )
