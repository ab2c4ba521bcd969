"""Prefix tries, source mixing and spelling variants against brute force, and on odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plaudit.llm import jaccard, mixing, ranks, trie, variants
from plaudit.llm.components import components

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size long, pos long, word string"


# -- positions and running sums ------------------------------------------------------------------


def test_positions_and_running_sums_of_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(ranks, "BLOCK", 7)
    rng = random.Random(4)
    data = [(1 if rng.random() < 0.7 else rng.randint(2, 9), rng.random(), rng.randint(0, 9)) for _ in range(400)]
    df = spark.createDataFrame(data, "g long, x double, v long").repartition(9)
    placed = ranks.positions(df, ["g"], ["x"])
    for backwards in (False, True):
        got = {(r.g, r.pos): (r.x, r.total) for r in ranks.running(placed, "g", "pos", {"total": F.col("v")}, backwards).collect()}
        want = {}
        for g in {d[0] for d in data}:
            group = sorted(d[1:] for d in data if d[0] == g)
            for i, (x, _) in enumerate(group):
                want[g, i + 1] = (x, sum(v for _, v in (group[i:] if backwards else group[: i + 1])))
        assert got == want
    alone = [(r.pos, r.x) for r in ranks.positions(df.select("x"), [], ["x"]).collect()]
    assert sorted(alone) == list(enumerate(sorted(d[1] for d in data), 1))


# -- prefix trie ---------------------------------------------------------------------------------


def brute_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in turns.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(turns.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:])
    members, below = defaultdict(list), defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    for seq in members:
        if seq:
            below[seq[:-1]].append(seq)
    leaves, saved, out = {}, {}, set()
    for seq in sorted(members, key=len, reverse=True):
        m = members[seq]
        leaves[seq] = sum(leaves[k] for k in below[seq]) or 1
        saved[seq] = sum(saved[k] for k in below[seq]) + (len(m) - 1) * (len(seq[-1][1].encode()) if seq else 0)
        ends = ",".join(map(str, sorted(c for c in m if len(rebuilt[c]) == len(seq))))
        parent = min(members[seq[:-1]]) if seq else None
        out.add((min(m), len(seq), parent, len(m), len(below[seq]), leaves[seq], saved[seq], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(-12, 60), 1000, 1001]:
        if rng.random() < 0.15:
            continue
        n = 40 if c == 7 else rng.randint(1, 14)
        turns = [None, *range(n)] if rng.random() < 0.2 else range(n)
        rows += [(c, t, rng.choice(["user", "assistant", None]) if t else "user", rng.choice(["a", "é", "", None]) if t != 1 else "b") for t in turns]
    return rows + [(None, 0, "user", "x"), (None, None, None, None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(ranks, "BLOCK", 5)
    monkeypatch.setattr(trie, "CHUNK_CHARS", 9)
    rows = conversations(seed)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"depth": F.lit(3), "pos": F.lit("p")})
    found = trie.prefix_trie(df.repartition(5))
    got = [tuple(r) for r in found.collect()]
    assert set(got) == brute_trie(rows) and len(got) == len(set(got))
    assert [t for _, t in found.dtypes] == ["bigint"] * 7 + ["string"]


def test_trie_takes_another_base_when_fingerprints_collide(spark, monkeypatch):
    """Base 1 forgets the order of turns: a, b and b, a collide and are told apart by verification."""
    bases = trie._bases
    monkeypatch.setattr(trie, "_bases", lambda seed: [1, 1, 1] if seed == 1 else bases(seed))
    rows = [(c, t, "user", x) for c, xs in ((10, "ab"), (15, "ba"), (20, "abab"), (25, "baba")) for t, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert {tuple(r) for r in trie.prefix_trie(df).collect()} == brute_trie(rows)


def test_trie_of_nothing_and_of_repeated_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert trie.prefix_trie(spark.createDataFrame([], schema)).collect() == []
    rows = [(5, 0, "user", "x" * 50_000)] * 3 + [(6, None, None, None)]
    assert {tuple(r) for r in trie.prefix_trie(spark.createDataFrame(rows, schema)).collect()} == brute_trie(rows)


def test_trie_refuses_turns_of_one_digest_that_differ(spark):
    rows = [(1, 1, 1, 1, "a"), (1, 1, 1, 1, "b")]
    with pytest.raises(ValueError):
        trie.check_digests(spark.createDataFrame(rows, "d1 long, d2 long, d3 long, d4 long, body string"))


# -- mixing --------------------------------------------------------------------------------------


def level_targets(sizes):
    """Targets by repeated sharing, as the contract words it."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    fixed, total = {}, 1.5 * sum(sizes.values())
    while True:
        left, w = total - sum(fixed.values()), sum(weight[s] for s in names if s not in fixed)
        goal = {s: fixed.get(s, left * weight[s] / w if w else 0) for s in names}
        over = {s: 2.0 * sizes[s] for s in names if s not in fixed and goal[s] > 2 * sizes[s]}
        if not over:
            return goal
        fixed |= over


def mixed_documents(seed):
    rng = random.Random(seed)
    text = lambda n: " ".join("w" for _ in range(n))
    rows = [(i, text(min(4000, int(rng.paretovariate(0.9) * 5))), rng.choice(["a", "a", "a", "b", "c", None, "d", "e"])) for i in range(700)]
    rows += [(800 + i, text(9), "many") for i in range(300)] + [(1200, "", "none"), (1201, None, "none"), (1202, " \n\t", None), (None, text(7), "b")]
    return rows + [(1300 + i, text(3000), "tiny") for i in range(1)] + rows[:5]


def test_mix_meets_targets(spark):
    rows = mixed_documents(5)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit("x"), "number": F.lit(1), "rate": F.lit(None)})
    found = mixing.mix(df.repartition(7)).collect()
    again = mixing.mix(df.repartition(3)).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(found, key=key) == sorted(again, key=key) and len(found) == len(rows)
    source = {d: s for d, _, s in rows if d is not None} | {None: "b"}
    sizes, got, texts = Counter(), Counter(), {d: len((t or "").split()) for d, t, _ in rows}
    for d, t, s in rows:
        sizes[s] += len((t or "").split())
    goal = level_targets(sizes)
    for r in found:
        assert r["size"] == texts[r.doc_id] and r.source_size == sizes[source[r.doc_id]]
        assert r.target == pytest.approx(goal[source[r.doc_id]]) and 0 <= r.taken <= 2 * r["size"]
        assert r["size"] == 0 or r.taken % r["size"] == 0
        got[source[r.doc_id]] += r.taken
    for s, target in goal.items():
        assert abs(got[s] - target) <= max(9, 0.005 * target) or s == "tiny"


def test_rates_are_the_tilted_ones(spark):
    """One multiplier per source, found here by bisection."""
    rows = mixed_documents(6)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    by_source = defaultdict(list)
    source = {d: s for d, _, s in rows if d is not None} | {None: "b"}
    for r in mixing.mix(df).collect():
        if r["size"]:
            by_source[source[r.doc_id]].append((r["size"], r.rate, r.target))
    for group in by_source.values():
        total, target = sum(g[0] for g in group), group[0][2]
        if target >= 2 * total:
            assert {g[1] for g in group} == {2.0}
            continue
        low, high = -50.0, 50.0
        for _ in range(200):
            mid = (low + high) / 2
            f = sum(g[0] * min(2.0, math.exp(min(1.0, mid * g[0] / 100))) for g in group)
            low, high = (mid, high) if f < target else (low, mid)
        for size, rate, _ in group:
            assert rate == pytest.approx(min(2.0, math.exp(min(1.0, low * size / 100))), rel=1e-4)


def test_mix_of_nothing(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], schema)).collect() == []
    wordless = spark.createDataFrame([(1, None, None), (2, "", "a")], schema)
    assert sorted(tuple(r) for r in mixing.mix(wordless).collect()) == [(1, 0, 0, 0.0, 0, 0.0), (2, 0, 0, 0.0, 0, 0.0)]


# -- spelling variants -----------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_forms(counts):
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 2 * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return out


@pytest.mark.parametrize("letters, most", [("ab", 8), ("abé", 3), ("abcdefgh", 4096)])
def test_variants_of_any_vocabulary(spark, letters, most):
    """Few letters make every block hot, so that they are divided to the end."""
    rng = random.Random(len(letters))
    vocab = {"".join(rng.choice(letters) for _ in range(rng.randint(5, 9))): rng.randint(3, 60) for _ in range(400)}
    long = "x" * 3000
    vocab |= {long: 9, long[:-1]: 3, long[:1500] + "y" + long[1501:]: 4, "q" + long: 50}
    df = spark.createDataFrame(list(vocab.items()), "word string, n long").repartition(5)
    assert {tuple(r) for r in variants.grouped(df, most).collect()} == brute_forms(vocab)
    pairs = variants.near_words(df, most).collect()
    assert len(pairs) == len({(p.word, p.near) for p in pairs}) == sum(one_edit(a, b) for a in vocab for b in vocab)


def test_vocabulary_counts_whole_texts(spark):
    rng = random.Random(8)
    names = ["Étage", "étage", "LETTER", "letter", "lettre", "aaaaaaa", "x×yzuv", "naïveté"]
    docs = [(i, " ".join(rng.choice(names) for _ in range(200)) + ";z1zzzzz_", None, None, 1, 1, 1, "w") for i in range(40)]
    docs += [(None, "letter " * 5, None, None, 1, 1, 1, "w"), (50, None, None, None, 1, 1, 1, "w"), (51, "", None, None, 1, 1, 1, "w"), docs[0]]
    want, table = Counter(), str.maketrans(variants.UPPER, variants.LOWER)
    for d, text, *_ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(table)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            want[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    df = spark.createDataFrame(docs, COLUMNS)
    assert {r.word: r.n for r in variants.vocabulary(df).collect()} == {w: n for w, n in want.items() if len(w) >= 5 and n >= 3}
    assert variants.variants(df.limit(0)).collect() == []


def test_texts_of_few_wanted_sets_are_not_shuffled(spark, monkeypatch):
    # Tables whose guessed sizes are far beyond a broadcast; ten rows are left of each.
    some = spark.range(10**7).where("id % 1000000 = 0")
    docs = some.select(F.col("id").alias("doc_id"), F.concat(F.lit("a b c d "), "id").alias("text"))
    keys = {i: jaccard.set_key(jaccard.shingle_sets([f"a b c d {i}"], 3)[0], 11) for i in range(0, 10**7, 10**6)}
    key = F.create_map(*[F.lit(x) for pair in keys.items() for x in pair])
    plans, run = [], jaccard.map_tasks
    monkeypatch.setattr(jaccard, "map_tasks", lambda df, *rest: plans.append(df) or run(df, *rest))
    stored = jaccard.stored_sets(docs, some.select(F.col("id").alias("a"), F.element_at(key, F.col("id")).alias("k1")), jaccard.Similarity())
    assert sorted(r.a for r in stored.collect()) == sorted(keys)
    plan = plans[0]._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_links_of_near_copies_leave_their_blocks_as_stars(spark, monkeypatch):
    base = np.arange(100, dtype=np.uint64)
    sets = [np.union1d(base, np.uint64([1000 + i])) for i in range(40)] + [np.arange(500, 600, dtype=np.uint64)]
    rows = [(i, 0, len(sets), float(sum(map(len, sets))), 100 + i // 2, s.tobytes()) for i, s in enumerate(sets)]
    members = spark.createDataFrame(rows, "a long, cluster long, size long, held double, root long, shingles binary")
    found = [(r.a, r.b) for r in jaccard.block_links(members, jaccard.Similarity()).collect()]
    assert sorted(found) == [(100, b) for b in range(101, 120)]  # of 760 links; the last set has none
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    dealt = jaccard.block_links(members, jaccard.Similarity())
    roots = {r.root for r in components(dealt).collect()}
    assert len(roots) == 1 and {r.node for r in components(dealt).collect()} == set(range(100, 120))
