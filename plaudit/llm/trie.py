r"""Prefix trie of rebuilt conversations, from fingerprints that compose.

Conversation c is rebuilt as the first h turns of its base c - c % 5, then its own turns after the
first h, h = crc32 of the decimal c, modulo 9.  No rebuilt text is ever made.  A run of turns has
the fingerprint (length, hash), and (m, x)(n, y) = (m + n, x + B^m y) makes these a monoid: the
hash sums B^i times the digest of turn i.  B has an inverse, so the hash of any inner run is a
difference of two running sums, moved to its new place by a power of B.  Every prefix of a rebuilt
conversation is thus the product of a head of the base and a run of its own turns, three hashes
modulo 31-bit primes, computed from the sums of the original conversations alone.

Prefixes of equal depth and fingerprint form a node.  Equality is verified, not assumed: all
members of a node must come from one parent node and refer to stored turns of one digest, and each
digest's turns must be of one text.  Should a fingerprint collide, the job takes another base.

Subtree sums need no recursion.  A conversation that is the smallest member of a node stays so
further down, hence owns one stretch of nodes to its end; a node's subtree is the stretch of its
own smallest member from there on, and the whole stretches of the members that begin below.

Contract: null role and text are empty; rows without a conversation id are left out; turns go by
turn (null first), then role, then text's digest, so repeated rows are turns of their own; an empty
table has no nodes; ``%`` takes the sign of c.  Extra columns are ignored.  No step needs the
rows of one conversation, or of one node, in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaudit.llm.batches import map_tasks
from plaudit.llm.ranks import positions, running
from plaudit.scale import heavy_keys, join_dimension
from plaudit.session import materialize

PRIMES = (2147483647, 2147483629, 2147483587)
LONGEST_HEAD, FAMILY = 8, 5
CHUNK_CHARS = 1 << 16

_H = ["f1", "f2", "f3"]  # hash of a prefix
_P = ["p1", "p2", "p3"]  # hash of the prefix without its last turn
_D = ["d1", "d2", "d3", "d4"]  # 240 bits of a turn's digest
NODE = ["depth", *_H]


def _bases(seed: int) -> list[int]:
    return [int(hashlib.sha256(f"{seed}:{p}".encode()).hexdigest(), 16) % (p - 2) + 2 for p in PRIMES]


def _table(values: list[int]) -> Column:
    """A literal array."""
    return F.expr(f"array({', '.join(f'{v}L' for v in values)})")


def _power(base: int, p: int, exponent: Column) -> Column:
    """``base ** exponent % p`` for exponents below 2^40, by one table per byte."""
    result = None
    for byte in range(5):
        table = _table([pow(base, i << 8 * byte, p) for i in range(256)])
        factor = table[F.shiftright(exponent, 8 * byte).bitwiseAND(F.lit(255)).cast("int")]
        result = factor if result is None else result * factor % p
    return result


def digested(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, body, d1..d4, n_bytes); ``body`` writes role and text unmistakably."""
    clean = conversations.where("conv_id is not null").select(
        "conv_id", "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]
    )
    body = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    pieces = [F.conv(F.substring("sha", 15 * i + 1, 15), 16, 10).cast("long").alias(d) for i, d in enumerate(_D)]
    return (
        clean.withColumn("body", body).withColumn("sha", F.sha2("body", 256))
        .select("conv_id", "turn", "role", "body", *pieces, F.octet_length("text").cast("long").alias("n_bytes"))
    )


def check_digests(turns: DataFrame) -> None:
    """Equal digests must mean equal turns; the texts of each digest are compared once."""
    bodies = turns.groupBy(*_D).agg(F.min("body").alias("a"), F.max("body").alias("b"))
    if not bodies.where("a <> b").isEmpty():
        raise ValueError("two turns of one digest differ")


def placed(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, d1..d4, n_bytes): every turn at its place in its conversation."""
    rows = turns.select("conv_id", "turn", "role", *_D, "n_bytes")
    found = positions(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), "role", *_D])
    return materialize(found.select("conv_id", "pos", *_D, "n_bytes"), "turns")


def summed(turns: DataFrame, bases: list[int]) -> DataFrame:
    """Adds the hashes of the turns up to (f) and before (p) each place."""
    terms = {}
    for f, d, b, p in zip(_H, _D, bases, PRIMES):
        terms[f] = (F.col(d) % (p - 1) + 1) * _power(b, p, F.col("pos")) % p
    sums = running(turns.select("*", *[t.alias(f"t{f}") for f, t in terms.items()]), "conv_id", "pos", {f: F.col(f"t{f}") for f in _H})
    return materialize(
        sums.select(
            "conv_id", "pos", *_D, "n_bytes",
            *[(F.col(f) % p).alias(f) for f, p in zip(_H, PRIMES)],
            *[((F.col(f) - F.col(f"t{f}")) % p).alias(q) for f, q, p in zip(_H, _P, PRIMES)],
        ),
        "sums",
    )


def plans(sums: DataFrame) -> DataFrame:
    """One row per conversation: how it is rebuilt.

    ``head`` are the turns taken from the base (8 at most), ``b`` their hash; ``h`` own turns are
    left out, ``c`` is their hash; ``depth`` is the length of the result.
    """
    short = F.when(F.col("pos") <= LONGEST_HEAD, F.struct("pos", *_D, "n_bytes", *_H, *_P))
    own = materialize(
        sums.groupBy("conv_id").agg(
            F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(short)).alias("first")
        ),
        "heads",
    )
    base = own.select(F.col("conv_id").alias("base"), F.col("first").alias("base_first"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (LONGEST_HEAD + 1)).cast("int")
    joined = (
        own.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).join(base, "base", "left")
        .withColumn("h", h)
        .withColumn("head", F.when(F.col("base_first").isNull(), F.slice("first", 1, 0)).otherwise(F.expr("slice(base_first, 1, h)")))
        .withColumn("left_out", F.expr("slice(first, 1, h)"))
    )
    last = lambda array, f: F.coalesce(F.try_element_at(array, F.lit(-1))[f], F.lit(0))
    return materialize(
        joined.select(
            "conv_id", "h", "head", F.size("head").alias("n_head"),
            (F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long").alias("end"),
            *[last(F.col("head"), f).alias(f"b{f}") for f in _H],
            *[last(F.col("left_out"), f).alias(f"c{f}") for f in _H],
        ),
        "plans",
    )


def members(sums: DataFrame, plan: DataFrame, bases: list[int]) -> DataFrame:
    """(conv_id, depth, hash f, hash p of the parent, d1..d4 and n_bytes of the last turn, end): one
    row per prefix of every rebuilt conversation, the empty one included."""
    zero = F.lit(0).cast("long")
    roots = plan.select("conv_id", zero.alias("depth"), *[zero.alias(c) for c in (*_H, *_P, *_D, "n_bytes")], "end")
    heads = plan.select("conv_id", "end", F.inline("head")).withColumnRenamed("pos", "depth").select(roots.columns)
    own = sums.join(plan.drop("head"), "conv_id").where("pos > h")
    moved = []
    for f, q, b, p in zip(_H, _P, bases, PRIMES):
        back = _table([pow(b, -i, p) for i in range(LONGEST_HEAD + 1)])[F.col("h") - F.col("n_head")]
        for name in (f, q):
            run = (F.col(name) - F.col(f"c{f}") + p) % p
            moved.append(((F.col(f"b{f}") + run * back) % p).alias(name))
    tails = own.select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("n_head")).alias("depth"), *moved, *_D, "n_bytes", "end"
    ).select(roots.columns)
    return materialize(roots.unionByName(heads).unionByName(tails), "members")


def nodes_of(prefixes: DataFrame) -> DataFrame:
    """One row per (depth, hash); ``same``: all members agree on parent and last turn."""
    kept = [*_P, *_D, "n_bytes"]
    found = prefixes.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
        *[F.min(c).alias(c) for c in kept], *[F.max(c).alias(f"max_{c}") for c in kept],
    )
    same = F.lit(True)
    for c in kept:
        same = same & (F.col(c) == F.col(f"max_{c}"))
    return materialize(found.withColumn("same", same).select(*NODE, "conv_id", "n_convs", *_P, "n_bytes", "same"), "nodes")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids in order to comma-joined chunks of bounded length; a node may have many."""
    node, first, held, chars = None, None, [], 0

    def flush():
        names = [*NODE, "first", "ids"]
        return pa.RecordBatch.from_pylist([dict(zip(names, (*node, first, ",".join(held))))], _CHUNKS)

    for batch in batches:
        for *key, conv in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if held and (key != node or chars > CHUNK_CHARS):
                yield flush()
                held, chars = [], 0
            if not held:
                node, first = key, conv
            held.append(str(conv))
            chars += len(held[-1]) + 1
    if held:
        yield flush()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order to one digest per node, without joining them."""
    node, sha, out = None, None, []
    for batch in batches:
        for *key, ids in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if key == node:
                sha.update(b"," + ids.encode())
                continue
            if node is not None:
                out.append((*node, sha.hexdigest()))
            node, sha = key, hashlib.sha256(ids.encode())
        if len(out) > 4096:
            yield pa.RecordBatch.from_pylist([dict(zip(_DIGESTS.names, r)) for r in out], _DIGESTS)
            out = []
    if node is not None:
        out.append((*node, sha.hexdigest()))
        yield pa.RecordBatch.from_pylist([dict(zip(_DIGESTS.names, r)) for r in out], _DIGESTS)


_KEY = [(n, pa.int64()) for n in NODE]
_CHUNKS = pa.schema([*_KEY, ("first", pa.int64()), ("ids", pa.string())])
_DIGESTS = pa.schema([*_KEY, ("ends_sha256", pa.string())])


def end_digests(prefixes: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes where conversations end.

    The ids of one node may be a third of all: they are joined to chunks over many tasks, ordered
    by range; the digest itself, sequential by nature, streams over the chunks.
    """
    key = ", ".join(f"{n} long" for n in NODE)
    order = [*NODE, "conv_id"]
    ends = materialize(prefixes.where("depth = end").select(*order), "ends")
    ordered = ends.repartitionByRange(*order).sortWithinPartitions(*order)
    chunks = materialize(map_tasks(ordered, _joined, f"{key}, first long, ids string"), "chunks")
    by_node = chunks.repartition(*NODE).sortWithinPartitions(*NODE, "first").select(*NODE, "ids")
    return map_tasks(by_node, _hashed, f"{key}, ends_sha256 string")


def prefix_trie(conversations: DataFrame, seed: int = 1) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    One row per node; ``conv_id`` is the smallest member, so (conv_id, depth) names a node.
    """
    turns = digested(conversations)
    check_digests(turns)
    located = placed(turns)
    while True:
        bases = _bases(seed)
        sums = summed(located, bases)
        prefixes = members(sums, plans(sums), bases)
        nodes = nodes_of(prefixes)
        if nodes.where("not same").isEmpty():
            return described(nodes, prefixes)
        seed += 1


def described(nodes: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The counts and sums of every node."""
    above = [(F.col("depth") - 1).alias("depth"), *[F.col(p).alias(f) for p, f in zip(_P, _H)]]
    children = materialize(nodes.where("depth > 0").groupBy(*above).agg(F.count(F.lit(1)).alias("n_children")), "children")
    counted = materialize(nodes.join(children, NODE, "left").fillna(0, ["n_children"]), "counted")
    weights = {
        "n_leaves": F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"),
        "saved_tokens": (F.col("n_convs") - 1) * F.col("n_bytes"),
    }
    stretch = running(counted, "conv_id", "depth", weights, backwards=True)
    whole = counted.groupBy("conv_id").agg(F.min("depth").alias("start"), *[F.sum(w).alias(n) for n, w in weights.items()])
    below = (
        prefixes.select(*NODE, "conv_id").join(whole, "conv_id").where("depth < start")
        .groupBy(*NODE).agg(*[F.sum(n).alias(f"below_{n}") for n in weights])
    )
    parents = nodes.select(*[F.col(c).alias(f"at_{c}") for c in NODE], F.col("conv_id").alias("parent_conv_id"))
    full = (
        stretch.join(below, NODE, "left").join(end_digests(prefixes), NODE, "left")
        .withColumn("at_depth", F.when(F.col("depth") > 0, F.col("depth") - 1))
        .withColumnsRenamed({p: f"at_{f}" for p, f in zip(_P, _H)})
    )
    on = [f"at_{c}" for c in NODE]
    heavy = heavy_keys(children.withColumnsRenamed({c: f"at_{c}" for c in NODE}), on, count="n_children")
    return join_dimension(full, parents, on, spread=["conv_id", "depth"], heavy=heavy).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        *[(F.col(n) + F.coalesce(f"below_{n}", F.lit(0))).alias(n) for n in weights],
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
