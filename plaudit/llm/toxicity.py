"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as the embedding of its spelling (frequent words only) beside a vector of its
bytes by place; a longer stretch than there are places enters as several words, first cut at
punctuation and then by length.  The network reads windows of ``window`` words, each overlapping the next by
a quarter; a text scores as its most toxic window.  Training takes a bounded sample of labelled
documents (``positives`` and ``negatives`` of at most ``longest`` characters, the first by a hash
of their id) to the driver; the network it gives has a fixed size.  Scoring reads every whole text.

Multiple-instance training: only the document is labelled, so each round scores all windows and
learns from the highest one of a toxic document and the highest few of any other.

Contract: null counts as empty; a text without words gets the score of an empty window.  Only
``text`` is an input of a score.  Repeated rows are scored each alone; of several labels of one
document the highest counts, null labels do not.  Without labels of both kinds every score is near 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaudit.llm.batches import column_of, groups_by_size, map_tasks, rows, texts_of

STRIP = b".,;:!?*&%$#|<>()[]{}\"'`-_=+/\\~^@"
_APART = bytes.maketrans(STRIP, b" " * len(STRIP))
CLASSES = 29 + 128  # none, letters, digits, other ASCII, each byte beyond ASCII
Params = dict[str, np.ndarray]


@dataclass(frozen=True)
class Setup:
    window: int = 32
    hidden: int = 8
    word_dims: int = 8
    char_dims: int = 8
    places: int = 10
    positives: int = 600
    negatives: int = 2400
    longest: int = 4000
    frequent: int = 4
    hardest: int = 3
    epochs: int = 6
    updates: int = 240  # at least so many, in more epochs where the sample is small
    rate: float = 0.02
    threshold: float = 0.3
    seed: int = 7


# -- words -------------------------------------------------------------------------------------


def words_in(text: str) -> list[bytes]:
    return [w.strip(STRIP) for w in text.lower().encode("utf-8", "surrogatepass").split()]


def pieces(words: list[bytes], places: int) -> list[bytes]:
    """The words, those of more than ``places`` bytes in pieces, so that no byte is left out."""
    out: list[bytes] = []
    for w in words:
        if len(w) <= places:
            out.append(w)
            continue
        for part in w.translate(_APART).split():
            out += [part[i : i + places] for i in range(0, len(part), places)]
    return out


def vocabulary(texts: list[list[bytes]], at_least: int) -> dict[bytes, int]:
    """Words of at least so many documents, numbered from 1; 0 is every other word."""
    met = Counter(w for words in texts for w in set(words))
    return {w: i + 1 for i, w in enumerate(sorted(w for w, n in met.items() if n >= at_least and w))}


def spelling(words: list[bytes], places: int) -> np.ndarray:
    """Of each word, of at most ``places`` bytes, the class of every byte: 1-26 letters, 27 digits,
    28 other ASCII, above that one for each byte beyond ASCII, 0 none."""
    raw = np.frombuffer(b"".join(w.ljust(places, b"\0") for w in words), np.uint8)
    table = np.full(256, 28, np.int64)
    table[0] = 0
    table[128:] = np.arange(29, CLASSES)
    table[ord("a") : ord("z") + 1] = np.arange(1, 27)
    table[ord("0") : ord("9") + 1] = 27
    return table[raw].reshape(len(words), places)


def window_starts(n: int, window: int) -> list[int]:
    """Windows overlap by a quarter; the last one ends with the text."""
    if n <= window:
        return [0]
    return [*range(0, n - window, window * 3 // 4), n - window]


@dataclass
class Windows:
    """Windows of several texts over their distinct words; entry 0 of ``spelled`` is padding."""

    known: np.ndarray  # vocabulary number of each distinct word
    spelled: np.ndarray
    at: np.ndarray  # (window, position) -> distinct word, 0 past the end
    text: np.ndarray  # text of each window


def windows_of(texts: list[list[bytes]], vocab: dict[bytes, int], setup: Setup) -> Windows:
    number: dict[bytes, int] = {b"": 0}
    texts = [pieces(t, setup.places) for t in texts]
    coded = [np.fromiter((number.setdefault(w, len(number)) for w in t), np.int64, len(t)) for t in texts]
    distinct = list(number)
    cuts, owner = [], []
    for i, ids in enumerate(coded):
        if len(ids) < setup.window:
            ids = np.pad(ids, (0, setup.window - len(ids)))
        starts = np.array(window_starts(len(ids), setup.window))
        cuts.append(ids[starts[:, None] + np.arange(setup.window)])
        owner += [i] * len(starts)
    return Windows(
        np.array([vocab.get(w, 0) for w in distinct]),
        spelling(distinct, setup.places),
        np.concatenate(cuts) if cuts else np.zeros((0, setup.window), np.int64),
        np.array(owner, np.int64),
    )


# -- network -----------------------------------------------------------------------------------


def fresh(n_words: int, s: Setup) -> Params:
    rng = np.random.default_rng(s.seed)
    d, h = s.word_dims + s.char_dims, s.hidden
    draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
    out = {
        "word": np.concatenate([np.zeros((1, s.word_dims), np.float32), draw(n_words, s.word_dims)]),
        "char": draw(s.places, CLASSES, s.char_dims),
        "att": draw(2 * h, h), "att_v": draw(h), "out": draw(2 * h), "bias": np.full(1, -1, np.float32),
    }
    for way in "fb":
        out |= {f"x{way}": draw(d, 3 * h), f"h{way}": draw(h, 3 * h), f"c{way}": np.zeros(3 * h, np.float32)}
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-x))


def word_vectors(p: Params, known: np.ndarray, spelled: np.ndarray) -> np.ndarray:
    chars = p["char"][np.arange(spelled.shape[1]), spelled].sum(axis=1)
    return np.concatenate([p["word"][known], np.tanh(chars)], axis=1)


def read(steps: np.ndarray, at: np.ndarray, u: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Gated recurrent states (position, window, hidden); ``steps``: input terms per word."""
    h = np.zeros((at.shape[0], u.shape[0]), np.float32)
    n = u.shape[0]
    states = np.empty((at.shape[1], *h.shape), np.float32)
    for t, words in enumerate(np.ascontiguousarray(at.T)):
        x, g = steps[words], h @ u
        zr = _sigmoid(x[:, : 2 * n] + g[:, : 2 * n])
        z, r = zr[:, :n], zr[:, n:]
        new = np.tanh(x[:, 2 * n :] + r * g[:, 2 * n :])
        if keep is not None:
            keep.append((h, z, r, new, g[:, 2 * n :]))
        h = new + z * (h - new)
        states[t] = h
    return states


def attend(p: Params, states: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, ...]:
    """(logit, weights, pooled, inner) of each window; ``there``: (position, window) not padding."""
    inner = np.tanh(states @ p["att"])
    score = np.where(there, inner @ p["att_v"], -1e9)
    weight = np.exp(score - score.max(axis=0)) * there
    weight = weight / np.maximum(weight.sum(axis=0), 1e-9)
    pooled = (weight[:, :, None] * states).sum(axis=0)
    return pooled @ p["out"] + p["bias"][0], weight, pooled, inner


def forward(p: Params, w: Windows, chosen: np.ndarray | None = None) -> np.ndarray:
    at = w.at if chosen is None else w.at[chosen]
    vectors = word_vectors(p, w.known, w.spelled)
    ahead = read(vectors @ p["xf"] + p["cf"], at, p["hf"])
    back = read(vectors @ p["xb"] + p["cb"], at[:, ::-1], p["hb"])[::-1]
    return attend(p, np.concatenate([ahead, back], axis=2), (at > 0).T)[0]


def gradients(p: Params, w: Windows, chosen: np.ndarray, truth: np.ndarray, weight: np.ndarray) -> Params:
    """Of the weighted cross-entropy over the chosen windows, by backpropagation through time."""
    at, n = w.at[chosen], p["hf"].shape[0]
    vectors = word_vectors(p, w.known, w.spelled)
    kept: dict[str, list] = {"f": [], "b": []}
    ahead = read(vectors @ p["xf"] + p["cf"], at, p["hf"], kept["f"])
    back = read(vectors @ p["xb"] + p["cb"], at[:, ::-1], p["hb"], kept["b"])[::-1]
    states, there = np.concatenate([ahead, back], axis=2), (at > 0).T
    logit, att, pooled, inner = attend(p, states, there)
    d_logit = ((_sigmoid(logit) - truth) * weight / len(truth)).astype(np.float32)
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["out"], g["bias"][0] = pooled.T @ d_logit, d_logit.sum()
    d_pooled = d_logit[:, None] * p["out"]
    d_states = att[:, :, None] * d_pooled
    d_att = (states * d_pooled).sum(axis=2)
    d_score = att * (d_att - (att * d_att).sum(axis=0))
    g["att_v"] = np.einsum("tb,tbh->h", d_score, inner)
    d_inner = d_score[:, :, None] * p["att_v"] * (1 - inner**2)
    g["att"] = np.einsum("tbs,tbh->sh", states, d_inner)
    d_states = d_states + d_inner @ p["att"].T
    d_vectors = np.zeros_like(vectors)
    for way, order, part in (("f", at, d_states[:, :, :n]), ("b", at[:, ::-1], d_states[::-1, :, n:])):
        d_h = np.zeros((len(at), n), np.float32)
        d_steps = np.zeros((len(vectors), 3 * n), np.float32)
        for t in range(at.shape[1] - 1, -1, -1):
            h, z, r, new, hn = kept[way][t]
            d_h = d_h + part[t]
            d_z = d_h * (h - new) * z * (1 - z)
            d_n = d_h * (1 - z) * (1 - new**2)
            d_r = d_n * hn * r * (1 - r)
            d_u = np.concatenate([d_z, d_r, d_n * r], axis=1)
            g[f"h{way}"] += h.T @ d_u
            np.add.at(d_steps, order[:, t], np.concatenate([d_z, d_r, d_n], axis=1))
            d_h = d_h * z + d_u @ p[f"h{way}"].T
        g[f"x{way}"], g[f"c{way}"] = vectors.T @ d_steps, d_steps.sum(axis=0)
        d_vectors += d_steps @ p[f"x{way}"].T
    size = p["word"].shape[1]
    np.add.at(g["word"], w.known, d_vectors[:, :size])
    g["word"][0] = 0
    d_chars = d_vectors[:, size:] * (1 - vectors[:, size:] ** 2)
    for place in range(w.spelled.shape[1]):
        np.add.at(g["char"][place], w.spelled[:, place], d_chars)
    return g


def fit(texts: list[str], toxic: list[int], setup: Setup = Setup()) -> tuple[Params, dict[bytes, int]]:
    """Parameters and vocabulary; Adam over the highest window of each document."""
    words = [words_in(t) for t in texts]
    vocab = vocabulary([pieces(t, setup.places) for t in words], setup.frequent)
    p = fresh(len(vocab), setup)
    truth = np.array(toxic, np.float32)
    if len(set(toxic)) < 2:
        p["out"][:], p["bias"][0] = 0, -30
        return p, vocab
    w = windows_of(words, vocab, setup)
    rng = np.random.default_rng(setup.seed)
    share = truth.mean()
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    steps = 0
    per_epoch = -(-(setup.hardest * len(texts)) // 128)
    epochs = max(setup.epochs, -(-setup.updates // per_epoch))
    for epoch in range(epochs):
        # At first any window of a document may hold the reason for its label.
        logit = forward(p, w) if epoch else rng.standard_normal(len(w.text)).astype(np.float32)
        order = np.lexsort((logit, w.text))
        last = np.searchsorted(w.text[order], np.arange(len(texts)), "right")
        rank = last[w.text[order]] - np.arange(len(order))
        top = order[rank <= np.where(truth[w.text[order]] > 0, 1, setup.hardest)]
        chosen = rng.permutation(top if epoch else order)
        for start in range(0, len(chosen), 128):
            some = chosen[start : start + 128]
            y = truth[w.text[some]]
            part = _part(w, some)
            g = gradients(p, part, np.arange(len(some)), y, np.where(y > 0, 0.5 / share, 1.0))
            steps += 1
            rate = setup.rate * (0.3 if epoch > epochs * 2 // 3 else 1.0)
            for k in p:
                first[k] += 0.1 * (g[k] - first[k])
                second[k] += 0.01 * (g[k] ** 2 - second[k])
                up = first[k] / (1 - 0.9**steps) / (np.sqrt(second[k] / (1 - 0.99**steps)) + 1e-6)
                p[k] -= (rate * up).astype(np.float32)
    return p, vocab


def _part(w: Windows, chosen: np.ndarray) -> Windows:
    """The chosen windows over their own distinct words."""
    used, at = np.unique(np.append(0, w.at[chosen]), return_inverse=True)
    return Windows(w.known[used], w.spelled[used], at[1:].reshape(len(chosen), -1), w.text[chosen])


def score(texts: list[str], p: Params, vocab: dict[bytes, int], setup: Setup) -> list[float]:
    """The highest window of each text, 0 to 1."""
    out: list[float] = []
    for part in groups_by_size([len(t) for t in texts], 1 << 18):
        w = windows_of([words_in(t) for t in texts[part]], vocab, setup)
        best = np.full(part.stop - part.start, -np.inf)
        for start in range(0, len(w.at), 2048):
            some = np.arange(start, min(start + 2048, len(w.at)))
            np.maximum.at(best, w.text[some], forward(p, _part(w, some)))
        out += _sigmoid(best).tolist()
    return out


# -- Spark -------------------------------------------------------------------------------------


def is_held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, setup: Setup = Setup()) -> tuple[list[str], list[int]]:
    """The bounded training sample, never from held-out documents."""
    known = (
        labels.where("doc_id is not null and toxic is not null").where(~is_held_out())
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("order", F.xxhash64("doc_id"))
    )
    texts = docs.select("doc_id", "text").where(F.length("text").between(1, setup.longest))
    got = []
    for toxic, n in ((1, setup.positives), (0, setup.negatives)):
        # Ids first, with spares for texts that are too long: no text is shuffled.
        some = known.where(F.col("toxic") == toxic).orderBy("order", "doc_id").limit(3 * n)
        both = texts.join(F.broadcast(some), "doc_id").orderBy("order", "doc_id", "text").limit(n)
        got += both.select("text", "toxic").collect()
    return [r.text for r in got], [int(r.toxic) for r in got]


def trained(docs: DataFrame, labels: DataFrame, setup: Setup = Setup()) -> tuple[Params, dict[bytes, int]]:
    return fit(*sample(docs, labels, setup), setup)


def toxicity(docs: DataFrame, labels: DataFrame, setup: Setup = Setup()) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    params, vocab = trained(docs, labels, setup)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield rows(
                schema, doc_id=column_of(batch, "doc_id"), held_out=column_of(batch, "held_out"),
                score=score(texts_of(batch), params, vocab, setup),
            )

    scored = map_tasks(
        docs.select("doc_id", is_held_out().alias("held_out"), "text"), task,
        "doc_id long, held_out boolean, score double",
    )
    return scored.withColumn("predicted", (F.col("score") >= setup.threshold).cast("int"))


def keep_civil(docs: DataFrame, labels: DataFrame, setup: Setup = Setup()) -> DataFrame:
    """The documents that are not predicted toxic, all their columns as they are."""
    params, vocab = trained(docs, labels, setup)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = [x < setup.threshold for x in score(texts_of(batch), params, vocab, setup)]
            yield batch.filter(pa.array(fine, pa.bool_()))

    return map_tasks(docs, task, docs.schema)
