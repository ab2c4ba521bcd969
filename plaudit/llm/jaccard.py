"""N-gram Jaccard join by partitioning the universe of shingles.

Two sets of sizes x <= y with a Jaccard similarity of at least t differ in at most
(x + y)(1 - t) / (1 + t) shingles.  Sizes fall into bands with the ratio 1 / t, so partners lie in
the same band or in neighbouring ones; each set is indexed under its own band and, as a smaller
partner, under the next.  A band hashes the universe into segments.  With d differences allowed,
segments that must agree exactly count one, segments that may miss one shingle count two, and
as soon as the counts add up to d + 1 any two partners agree in some segment (pigeonhole).
``allocate`` picks for each band the mix that costs least, from the number of sets in the band.

A segment that is empty in a set says nothing, so it is not written: there are a few segments more
than the pigeonhole needs, so that those with content suffice.  A set whose do not (``need``) also
writes all segments, empty ones too, in a space of their own, where such sets meet each other.

Groups of one signature with the same members are one group.  Inside a group two sets are compared
by bitmaps of one bit a shingle (parity of the shingles at a place): the bits in which they differ
never exceed the shingles in which they differ, so a pair beyond the allowed difference is no link.
Of the others, edges that connect them are kept, not all pairs, and each set is checked against the
smallest it has an edge to.  Where a cluster of such edges is still in several components, its sets are dealt into blocks
and each two blocks are counted against each other in one task, by products of incidence matrices;
only a star of the components it connects leaves the task.  Every check counts the intersection of whole sets.

Contract: null or empty texts have an empty set and link with nothing.  Equal sets are one class,
whatever their number, and count as linked.  Rows that share a doc_id count as one document.  A
null doc_id never names a component.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plaudit.llm.batches import column_of, groups_by_size, map_tasks, rows, texts_of
from plaudit.llm.components import components
from plaudit.llm.shingles import mix, words_of
from plaudit.session import materialize

BLOCK = 128  # sets of a cluster that are counted against as many others at once
BLOCK_SHINGLES = 1 << 19  # and their shingles
GROUP = 4096  # sets of a signature whose bitmaps are compared with as many others at once
GROUP_ROWS = 20_000  # sets of several signatures that are compared in one go
COLUMNS = 8192
#: Share of unrelated sets that hold a given shingle, as passages that many texts share make it.
COMMON = 1e-4


@dataclass(frozen=True)
class Similarity:
    words: int = 3
    percent: int = 90  # Jaccard similarity at least this


def band_edges(percent: int, above: int) -> list[int]:
    """Lower bounds of the size bands, the last one above ``above``."""
    edges = [1]
    while edges[-1] <= above:
        edges.append(edges[-1] * 100 // percent + 1)
    return edges


def allowed(size_a: int, size_b: int, percent: int) -> int:
    """Most shingles in which two sets of these sizes may differ and still link."""
    return (size_a + size_b) * (100 - percent) // (100 + percent)


def allocate(size: int, differences: int, sets: int, candidate: float = 4.0) -> tuple[int, int]:
    """(segments that must agree, segments that may miss one shingle) of a band.

    Their counts, one and two, add up to ``differences + 1``.  The cost of a mix is the signatures
    that a set of ``size`` writes, plus ``candidate`` times the unrelated sets that it meets because
    a segment holds one shingle, and that a common one.
    """

    def cost(near: int) -> float:
        exact = differences + 1 - 2 * near
        width = size / (exact + near)
        alone = sets * COMMON * width * exp(-width)
        return exact + near * (1 + width) + candidate * alone * (exact + near)

    near = min(range((differences + 1) // 2 + 1), key=cost)
    return differences + 1 - 2 * near, near


def roomy(size: int, need: int, exact: int, near: int) -> int:
    """Segments that must agree, so many that the segments with content of nearly every set of
    ``size`` shingles count ``need``: by four standard deviations."""
    most = 4 * (exact + near) + 8
    while exact < most:
        width = size / (exact + near)
        none, one = exp(-width), width * exp(-width)
        mean = exact * (1 - none) + near * (2 * (1 - none) - one)
        spread = exact * none * (1 - none) + near * (4 * none + one)
        if mean - 4 * sqrt(spread) >= need:
            break
        exact += 1
    return exact


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text, ASCII letters lower-cased."""
    raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    out: list[np.ndarray] = []
    for part in groups_by_size([len(b) for b in raw]):
        words = words_of(raw[part])
        at, text = words.runs(k)
        hashes = words.hashes(k, at)
        cuts = np.searchsorted(text, np.arange(len(words.first)))
        for i, n in enumerate(np.diff(words.first).tolist()):
            if n >= k:
                out.append(np.unique(hashes[cuts[i] : cuts[i + 1]]))
            else:
                first = words.first[i : i + 1]
                out.append(words.stretch(first, first + (n - 1)) if n else np.zeros(0, np.uint64))
    return out


def set_key(shingles: np.ndarray, seed: int) -> int:
    """A 64-bit key of a set; the lowest bit is left free for a mark."""
    with np.errstate(over="ignore"):
        total = mix(mix(shingles, seed).sum(dtype=np.uint64).reshape(1), seed)
        return int(total.view(np.int64)[0]) & ~1


def signatures(shingles: np.ndarray, band: int, exact: int, near: int, need: int | None = None) -> np.ndarray:
    """64-bit keys of a set under one band: one per exact segment, and of every segment that may
    miss a shingle its whole content and the content without each of its shingles.

    With ``need``, the most differences to a partner and one more, only segments with content
    count, unless they count less than that (see the module).
    """
    m = exact + near
    segment = (mix(shingles, 101 + band) % np.uint64(m)).astype(np.int64)
    value = mix(shingles, 7)
    held = np.bincount(segment, minlength=m)
    with np.errstate(over="ignore"):
        total = np.zeros(m, np.uint64)
        np.add.at(total, segment, value)

        def keys(space: int, whole: np.ndarray, open_: np.ndarray) -> np.ndarray:
            label = np.arange(m).astype(np.uint64) + np.uint64(band << 32 | space << 56)
            own = mix(total[whole] ^ mix(label[whole], 3), 5)
            less = total[segment[open_]] - value[open_]
            return np.concatenate([own, mix(less ^ mix(label[segment[open_]], 3), 5)])

        every, missing = np.arange(m), segment >= exact
        if need is None:
            return keys(0, every, missing)
        rich = keys(0, np.flatnonzero(held), missing & (held[segment] > 1))
        if (held[:exact] > 0).sum() + np.minimum(held[exact:], 2).sum() >= need:
            return rich
        return np.concatenate([rich, keys(1, every, missing)])


def bitmap(shingles: np.ndarray) -> bytes:
    """One bit for every place of a power of two at least the size: parity of the shingles there."""
    size = max(64, 1 << max(0, len(shingles) - 1).bit_length())
    places = (mix(shingles, 17) & np.uint64(size - 1)).astype(np.int64)
    return np.packbits(np.bincount(places, minlength=size) & 1, bitorder="little").tobytes()


def describe(docs: DataFrame, by: Similarity) -> DataFrame:
    """doc_id, n_shingles, two 64-bit keys and the bitmap of the set, one row per document."""
    schema = pa.schema([*[(n, pa.int64()) for n in ("doc_id", "n_shingles", "k1", "k2")], ("bits", pa.binary())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(texts_of(batch), by.words)
            yield rows(
                schema,
                doc_id=column_of(batch, "doc_id"),
                n_shingles=[len(s) for s in sets],
                k1=[set_key(s, 11) for s in sets],
                k2=[set_key(s, 13) for s in sets],
                bits=[bitmap(s) for s in sets],
            )

    return map_tasks(
        docs.select("doc_id", "text"), task, "doc_id long, n_shingles long, k1 long, k2 long, bits binary"
    )


def index(docs: DataFrame, by: Similarity, plan: dict[int, tuple[int, int, int]], edges: list[int]) -> DataFrame:
    """(sig, owner): the signatures of every set, once per set and task.

    ``owner`` is k1, its lowest bit set under the set's own band.
    """
    schema = pa.schema([("sig", pa.int64()), ("owner", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            texts = texts_of(batch)
            for part in groups_by_size([len(t) for t in texts]):
                keys, owners = [], []
                for s in shingle_sets(texts[part], by.words):
                    key = set_key(s, 11)
                    if not len(s) or key in seen:
                        continue
                    seen.add(key)
                    band = int(np.searchsorted(edges, len(s), "right")) - 1
                    for scheme in (band, band + 1):
                        if scheme in plan:
                            exact, near, largest = plan[scheme]
                            need = allowed(len(s), largest, by.percent) + 1
                            keys.append(signatures(s, scheme, exact, near, need))
                            owners.append(key | (scheme == band))
                if keys:
                    yield rows(
                        schema,
                        sig=np.concatenate(keys).view(np.int64),
                        owner=np.repeat(np.array(owners, np.int64), [len(k) for k in keys]),
                    )

    return map_tasks(docs.select("text"), task, "sig long, owner long")


def band_plan(sets: DataFrame, by: Similarity) -> tuple[dict[int, tuple[int, int, int]], list[int]]:
    """The segments and the largest size of every band that holds sets, from counts per band (a few
    hundred rows)."""
    top = sets.agg(F.max("n_shingles")).first()[0] or 0
    edges = band_edges(by.percent, top)
    of = F.lit(0)
    for i, edge in enumerate(edges):
        of = F.when(F.col("n_shingles") >= edge, i).otherwise(of)
    counts = dict(sets.where("n_shingles > 0").groupBy(of.alias("band")).count().collect())
    plan = {}
    for band in counts:
        largest = edges[band + 1] - 1
        d = allowed(largest, largest, by.percent)
        met = counts[band] + counts.get(band - 1, 0)
        exact, near = allocate((edges[band] + largest) // 2, d, met)
        plan[band] = (roomy(edges[band], d + 1, exact, near), near, largest)
    return plan, edges


def stored_sets(docs: DataFrame, wanted: DataFrame, by: Similarity) -> DataFrame:
    """``wanted`` (a, k1) with the hashes of each set as bytes, ``shingles``.

    Few sets of many are wanted.  Stored, their table has a known size, and the texts meet it where they are
    read as long as it can be broadcast; guessed, every text would be shuffled.
    """
    schema = pa.schema([("a", pa.int64()), ("shingles", pa.binary())])
    wanted = materialize(wanted, "wanted")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(texts_of(batch), by.words)
            keys = column_of(batch, "k1").to_pylist()
            same = pa.array([set_key(s, 11) == k for s, k in zip(sets, keys)], pa.bool_())
            held = pa.array([s.tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([column_of(batch, "a"), held], schema=schema).filter(same)

    texts = docs.select(F.col("doc_id").alias("a"), "text").join(wanted, "a")
    return materialize(map_tasks(texts, task, "a long, shingles binary"), "sets")


def enough(both: np.ndarray, p: np.ndarray, q: np.ndarray, percent: int) -> np.ndarray:
    """Whether intersections reach the similarity, given the sizes of the sets."""
    return both * (100 + percent) >= percent * (p + q)


def edge_links(sets: DataFrame, edges: DataFrame, by: Similarity) -> DataFrame:
    """The (a, b) of ``edges`` that link."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(x: bytes, y: bytes) -> bool:
        p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        spot = np.minimum(np.searchsorted(q, p), len(q) - 1)
        return bool(enough((q[spot] == p).sum(), len(p), len(q), by.percent))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine, other = (column_of(batch, n).to_pylist() for n in ("shingles", "other"))
            kept = batch.filter(pa.array([links(x, y) for x, y in zip(mine, other)], pa.bool_()))
            yield rows(schema, a=column_of(kept, "a"), b=column_of(kept, "b"))

    ends = sets.select(F.col("a").alias("b"), F.col("shingles").alias("other"))
    both = edges.select("a", "b").join(sets, "a").join(ends, "b").select("a", "b", "shingles", "other")
    return map_tasks(both, task, "a long, b long")


def intersections(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of ``x`` with every set of ``y``."""
    out = np.zeros((len(x), len(y)), np.float32)
    common = np.intersect1d(np.unique(np.concatenate(x)), np.unique(np.concatenate(y)))
    for start in range(0, len(common), COLUMNS):
        some = common[start : start + COLUMNS]
        sides = []
        for sets in (x, y):
            table = np.zeros((len(sets), len(some)), np.float32)
            for i, s in enumerate(sets):
                inside = s[np.searchsorted(s, some[0]) : np.searchsorted(s, some[-1], "right")]
                spot = np.minimum(np.searchsorted(some, inside), len(some) - 1)
                table[i, spot[some[spot] == inside]] = 1
            sides.append(table)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def block_links(members: DataFrame, by: Similarity) -> DataFrame:
    """(a, b): components (``root``) that links between the members (a, cluster, size, held, root,
    shingles) of each cluster connect.

    A task returns fewer rows than it has components, whatever the number of links.  A cluster of n
    sets has n / BLOCK blocks, more if its sets are large (``held``: their shingles together); a set
    goes to as many tasks as there are blocks.
    """
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("held") / BLOCK_SHINGLES)).cast("int")
    own = F.pmod(F.xxhash64("a"), blocks.cast("long")).cast("int")
    dealt = members.withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), blocks - 1))
    ).select(
        "cluster", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        "own", "root", "shingles",
    )
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def task(group: pa.Table) -> pa.Table:
        low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        side = np.array(group.column("own"))
        root = np.array(group.column("root"))
        sets = [np.frombuffer(b, np.uint64) for b in group.column("shingles").to_pylist()]
        first, second = np.flatnonzero(side == low), np.flatnonzero(side == high)
        if not len(first) or not len(second):
            return schema.empty_table()
        sizes = np.array([len(s) for s in sets])
        both = intersections([sets[i] for i in first], [sets[i] for i in second])
        ok = enough(both, sizes[first][:, None], sizes[second][None, :], by.percent)
        i, j = np.nonzero(ok & (root[first][:, None] != root[second][None, :]))
        # All links of near copies would be the square of their number: what these connect is a star.
        roots, of = np.unique(root, return_inverse=True)
        centre = np.arange(len(roots))
        merge(centre, of[first[i]], of[second[j]])
        moved = centre != np.arange(len(roots))
        return pa.table({"a": roots[centre[moved]], "b": roots[moved]}, schema=schema)

    return dealt.groupBy("cluster", "low", "high").applyInArrow(task, "a long, b long")


def folded(bits: bytes, size: int) -> np.ndarray:
    """A bitmap brought to ``size`` bytes: its halves, combined by parity, as often as it takes."""
    out = np.frombuffer(bits, np.uint64)
    while out.nbytes > size:
        out = out[: len(out) // 2] ^ out[len(out) // 2 :]
    return out


def merge(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Gives all that the pairs connect the smallest label of theirs."""
    while True:
        p, q = label[x], label[y]
        if (p == q).all():
            return
        root = np.arange(len(label))
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root != root[root]).any():
            root = root[root]
        label[:] = root[label]


def compatible(group: np.ndarray, sizes: np.ndarray, own: np.ndarray, side: np.ndarray, bits: list[bytes], percent: int):
    """Index pairs that connect, inside each group, all sets whose bitmaps allow a link.

    ``group`` is sorted.  Two sets count if one is in its own band; of the groups that are dealt
    into blocks (``side`` 0 or 1, else 2) only pairs across the sides count.
    """
    least = np.full(group.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, np.array([len(b) for b in bits]))
    width, label = least[group], np.arange(len(group))
    found = [np.zeros((2, 0), np.int64)]
    for size in np.unique(width):
        at = np.flatnonzero(width == size)
        table = np.stack([folded(bits[i], int(size)) for i in at])
        g, first, offset = group[at], np.arange(len(at) - 1), 1
        while len(first := first[: np.searchsorted(first, len(at) - offset)]):
            first = first[g[first] == g[first + offset]]
            x, y = at[first], at[first + offset]
            differ = np.bitwise_count(table[first] ^ table[first + offset]).sum(axis=1, dtype=np.int64)
            ok = differ * (100 + percent) <= (sizes[x] + sizes[y]) * (100 - percent)
            ok &= (own[x] | own[y]) & ((side[x] == 2) | (side[x] != side[y])) & (label[x] != label[y])
            found.append(np.stack([x[ok], y[ok]]))
            merge(label, x[ok], y[ok])
            offset += 1
    return np.concatenate(found, axis=1)


def group_edges(members: DataFrame, by: Similarity) -> DataFrame:
    """(k1, a, k1b, b) from the rows (sig, low, high, side, own, k1, a, n, bits) of every group."""
    names = ["k1", "a", "k1b", "b"]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def edges(table: pa.Table) -> pa.RecordBatch:
            column = {n: table.column(n).to_numpy() for n in ("sig", "low", "high", "side", "own", "k1", "a", "n")}
            new = np.zeros(table.num_rows, bool)
            for n in ("sig", "low", "high"):
                new[1:] |= column[n][1:] != column[n][:-1]
            side = np.where(column["low"] == column["high"], 2, (column["side"] == column["high"]).astype(np.int64))
            x, y = compatible(np.cumsum(new), column["n"], column["own"] == 1, side, table.column("bits").to_pylist(), by.percent)
            apart = column["a"][x] != column["a"][y]
            x, y = x[apart], y[apart]
            return rows(schema, k1=column["k1"][x], a=column["a"][x], k1b=column["k1"][y], b=column["a"][y])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < GROUP_ROWS:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            keys = [table.column(n).to_numpy() for n in ("sig", "low", "high")]
            last = np.ones(table.num_rows, bool)
            for k in keys:
                last &= k == k[-1]
            cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            if cut:  # the last group may go on
                yield edges(table.slice(0, cut))
            held = table.slice(cut).to_batches()
        if held and sum(b.num_rows for b in held):
            yield edges(pa.Table.from_batches(held).combine_chunks())

    order = ["sig", "low", "high"]
    dealt = members.repartition(*order).sortWithinPartitions(*order, "n", "a")
    return map_tasks(dealt, task, "k1 long, a long, k1b long, b long")


def candidates(docs: DataFrame, classes: DataFrame, by: Similarity, plan: dict, edges: list[int]) -> DataFrame:
    """(k1, a, k1b, b): edges that connect all sets that share a signature and may link."""
    # Nearly all signatures are of one set.  One shuffle of the bare rows finds the others; grouping
    # first would shuffle the sums of every signature and then its rows once more.
    group = Window.partitionBy("sig")
    key = F.col("owner").bitwiseAND(~1)
    keyed = materialize(
        index(docs, by, plan, edges)
        .withColumns({"first": F.min(key).over(group), "last": F.max(key).over(group), "any_own": F.max(F.col("owner").bitwiseAND(1)).over(group)})
        .where("any_own = 1 and first < last")  # two sets of a lower band meet under their own band as well
        .select("sig", key.alias("k1"), F.col("owner").bitwiseAND(1).alias("own")),
        "shared",
    )
    low, high = F.lit((1 << 31) - 1), 33
    sums = []
    for seed in (1, 2):
        h = F.xxhash64("k1", F.lit(seed))
        sums += [F.sum(h.bitwiseAND(low)).alias(f"low{seed}"), F.sum(F.shiftrightunsigned(h, high)).alias(f"high{seed}")]
    groups = keyed.groupBy("sig").agg(F.count(F.lit(1)).alias("met"), *sums)
    same = [c for c in groups.columns if c != "sig"]
    chosen = groups.groupBy(*same).agg(F.min("sig").alias("sig")).select("sig", "met")
    parts = F.ceil(F.col("met") / GROUP).cast("int")
    shared = keyed.join(chosen, "sig").distinct().join(classes, "k1").select(
        "sig", "own", "k1", "a", "n", "bits", parts.alias("parts"),
        F.pmod(F.xxhash64("a"), parts.cast("long")).cast("int").alias("side"),
    )
    dealt = shared.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "sig", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"),
        "side", "own", "k1", "a", "n", "bits",
    )
    return materialize(group_edges(dealt, by).distinct(), "edges")


def links_between(docs: DataFrame, sets: DataFrame, by: Similarity) -> DataFrame | None:
    """(node, root): components over the smallest documents of the classes of equal sets.

    None when no two sets may link.
    """
    plan, bounds = band_plan(sets, by)
    classes = (
        sets.where("n_shingles > 0 and doc_id is not null")
        .groupBy("k1", "k2").agg(F.min("doc_id").alias("a"), F.max("n_shingles").alias("n"), F.max("bits").alias("bits"))
        .drop("k2")
    )
    edges = candidates(docs, classes, by, plan, bounds)
    if edges.isEmpty():
        return None
    wanted = edges.select("k1", "a").union(edges.select("k1b", "b")).distinct()
    bodies = stored_sets(docs, wanted, by)
    # Each set is checked against the smallest one it has an edge to; what that leaves apart, in blocks.
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    first = materialize(both.groupBy("a").agg(F.min("b").alias("b")).where("b < a"), "first")
    linked = materialize(edge_links(bodies, first, by), "links")
    clusters = components(edges)
    roots = clusters.select(F.col("node").alias("a"), F.col("root").alias("cluster")).join(
        components(linked).withColumnRenamed("node", "a"), "a", "left"
    ).withColumn("root", F.coalesce("root", "a")).join(bodies.select("a", (F.length("shingles") / 8).alias("n")), "a")
    open_ = roots.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("size"), F.sum("n").alias("held"), F.min("root").alias("r0"), F.max("root").alias("r1")
    ).where("size > 2 and r0 <> r1").select("cluster", "size", "held")
    members = bodies.join(materialize(roots.drop("n").join(open_, "cluster"), "open"), "a")
    more = materialize(block_links(members, by).distinct(), "links")
    return components(linked.union(more))


def near_groups(docs: DataFrame, by: Similarity = Similarity()) -> DataFrame:
    """doc_id, n_shingles, component_id of every document (see the module's contract)."""
    sets = materialize(describe(docs, by), "described")
    roots = links_between(docs, sets, by)
    classes = sets.where("n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("node"))
    if roots is None:
        rooted = classes.withColumn("root", F.col("node"))
    else:
        rooted = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = rooted.groupBy("root").agg(F.min("node").alias("component"))
    named = rooted.join(lowest, "root").select("k1", "k2", "component")
    return sets.join(named, ["k1", "k2"], "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component"))
        .alias("component_id"),
    )


def keep_first(docs: DataFrame, by: Similarity = Similarity()) -> DataFrame:
    """One document, the smallest doc_id, of each component; documents without words stay."""
    gone = near_groups(docs, by).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
