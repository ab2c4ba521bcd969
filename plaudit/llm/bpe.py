"""BPE of long unsplit text by tree concatenation, and its inverse.

Words are encoded each on its own (``tokens``).  A stretch that no pattern splits and that is
longer than ``leaf`` bytes is halved until the halves are short; the halves are encoded apart, in
parallel when they belong to ``long_words``, and joined pairwise up the tree.  At a join, growing
windows around it are encoded again until the first token of the window agrees with a token of the
left side and the last with one of the right side.  Merging never looks beyond neighbours: ids are
the encoding of their text as soon as every two neighbouring ids are the encoding of theirs.  So a
window that agrees at both ends settles the join; a window that has grown to both whole sides is
their encoding itself.

Contract: null counts as empty, which has no ids and decodes to an empty text.  Repeated rows are
encoded each.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaudit.llm.batches import column_of, map_tasks, rows, texts_of
from plaudit.llm.tokens import END, WordEncoder, byte_of, library, word_encoder

LEAF = 2048  # bytes
LONG_TEXT = 50_000  # characters
WINDOW = 4  # tokens taken from either side at first

Merge = Callable[[bytes], list[int]]


def join_sides(left: list[int], right: list[int], merge: Merge, bytes_of: Callable[[int], bytes], window: int = WINDOW) -> list[int]:
    """The ids of two neighbouring stretches together."""
    n = window
    while True:
        a, b = left[-n:], right[:n]
        again = merge(b"".join(map(bytes_of, a + b)))
        whole_left, whole_right = len(a) == len(left), len(b) == len(right)
        # The outermost ids must be the ones that stand there already.
        if (whole_left or again[0] == a[0]) and (whole_right or again[-1] == b[-1]):
            return left[: len(left) - len(a)] + again + right[len(b) :]
        n *= 2


def tree(piece: bytes, merge: Merge, bytes_of: Callable[[int], bytes], leaf: int = LEAF, end: bytes = b"") -> list[int]:
    """Ids of a stretch and its end mark: halves first, then their join."""
    if len(piece) <= leaf:
        return merge(piece + end)
    cut = len(piece) // 2
    return join_sides(
        tree(piece[:cut], merge, bytes_of, leaf),
        tree(piece[cut:], merge, bytes_of, leaf, end),
        merge, bytes_of,
    )


def climb(leaves: list[list[int]], merge: Merge, bytes_of: Callable[[int], bytes]) -> list[int]:
    """Neighbouring leaves joined in pairs, level by level."""
    while len(leaves) > 1:
        pairs = [leaves[i : i + 2] for i in range(0, len(leaves), 2)]
        leaves = [join_sides(*p, merge, bytes_of) if len(p) == 2 else p[0] for p in pairs]
    return leaves[0]


def halves(piece: bytes, leaf: int) -> list[bytes]:
    """The leaves of a stretch, in order."""
    if len(piece) <= leaf:
        return [piece]
    cut = len(piece) // 2
    return halves(piece[:cut], leaf) + halves(piece[cut:], leaf)


@lru_cache(maxsize=1)
def _token_bytes(vocabulary: str) -> list[bytes]:
    """The bytes of every id, the end-of-word mark as one byte."""
    words, table = library(vocabulary), byte_of()
    out = []
    for i in range(words.get_vocab_size()):
        token = words.id_to_token(i)
        body, mark = (token[:-4], END) if token.endswith("</w>") else (token, b"")
        out.append(bytes(table.get(c, 0) for c in body) + mark)
    return out


class Coder:
    """Encodes and decodes whole texts; one per worker."""

    def __init__(self, vocabulary: str, leaf: int) -> None:
        self.words: WordEncoder = word_encoder(vocabulary)
        self.leaf = leaf
        self.token_bytes = _token_bytes(vocabulary).__getitem__
        self.token = [self.words.exact.id_to_token(i) for i in range(self.words.exact.get_vocab_size())]
        self.shown: dict[bytes, bytes] = {}

    def long(self, part: str) -> bytes:
        """Ids of a stretch longer than a leaf."""
        ids: list[int] = []
        for piece in self.words.pieces(part):
            if isinstance(piece, int):
                ids.append(piece)
            else:
                ids += tree(piece, self.words.merge, self.token_bytes, self.leaf, END)
        return np.array(ids, "<u4").tobytes()

    def parts(self, text: str) -> list[bytes]:
        if len(text) <= self.leaf:
            return self.words.parts(text)
        out: list[bytes] = []
        for part in self.words.cut_blanks(text):
            out += [self.long(part)] if len(part) > self.leaf else self.words.parts(part)
        return out

    def decoded(self, parts: list[bytes]) -> bytes:
        """As the library decodes: the token strings, one space between."""
        out, shown = [], self.shown
        for ids in parts:
            if not ids:
                continue
            text = shown.get(ids)
            if text is None:
                if len(shown) > 300_000:
                    shown.clear()
                text = " ".join([self.token[i] for i in np.frombuffer(ids, "<u4").tolist()]).encode()
                if len(ids) < 128:
                    shown[ids] = text
            out.append(text)
        return b" ".join(out)


@lru_cache(maxsize=1)
def coder(vocabulary: str, leaf: int) -> Coder:
    return Coder(vocabulary, leaf)


_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
)
_COLUMNS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digest(parts: list[bytes], decoded: bytes) -> tuple[int, str, str]:
    ids = b"".join(parts)
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()


def short_texts(docs: DataFrame, vocabulary: str, leaf: int) -> DataFrame:
    """Digests of texts that one task encodes each."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(vocabulary, leaf)
        for batch in batches:
            found = []
            for text in texts_of(batch):
                parts = code.parts(text)
                found.append(_digest(parts, code.decoded(parts)))
            n, ids, shown = zip(*found) if found else ((), (), ())
            yield rows(
                _SCHEMA, doc_id=column_of(batch, "doc_id"), n_tokens=n, ids_sha256=ids, decoded_sha256=shown
            )

    return map_tasks(docs.select("doc_id", "text"), task, _COLUMNS)


def long_texts(docs: DataFrame, vocabulary: str, leaf: int) -> DataFrame:
    """Digests of long texts: their leaves are encoded in parallel, then joined up the tree.

    A leaf is part of a word, or up to ``leaf`` characters of whole words.
    """
    cut_schema = pa.schema(
        [("key", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int32()), ("leaf", pa.int32())]
        + [("body", pa.binary()), ("kind", pa.int32())]
    )
    WORDS, INNER, LAST, DONE = range(4)

    def leaves_of(text: str, words: WordEncoder) -> Iterator[tuple[int, int, bytes, int]]:
        part, held, size = 0, [], 0
        for stretch in [*words.cut_blanks(text), ""]:
            long = len(stretch) > leaf
            if held and (long or size > leaf or not stretch):
                yield part, 0, " ".join(held).encode("utf-8", "surrogatepass"), WORDS
                part, held, size = part + 1, [], 0
            if not long:
                if stretch:
                    held.append(stretch)
                    size += len(stretch)
                continue
            for piece in words.pieces(stretch):
                if isinstance(piece, int):
                    yield part, 0, np.array([piece], "<u4").tobytes(), DONE
                else:
                    cuts = halves(piece, leaf)
                    for i, body in enumerate(cuts):
                        yield part, i, body, LAST if i + 1 == len(cuts) else INNER
                part += 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_encoder(vocabulary)
        for batch in batches:
            keys, ids = column_of(batch, "key").to_pylist(), column_of(batch, "doc_id").to_pylist()
            for key, doc, text in zip(keys, ids, texts_of(batch)):
                found = list(leaves_of(text, words)) or [(0, 0, b"", WORDS)]
                found = [(key, doc, *x) for x in found]
                yield rows(cut_schema, **dict(zip(cut_schema.names, zip(*found))))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_encoder(vocabulary)
        for batch in batches:
            bodies = []
            for body, kind in zip(column_of(batch, "body").to_pylist(), column_of(batch, "kind").to_pylist()):
                if kind == WORDS:
                    bodies.append(words.encode(body.decode("utf-8", "surrogatepass")))
                elif kind == DONE:
                    bodies.append(body)
                else:
                    ids = words.merge(body + (END if kind == LAST else b""))
                    bodies.append(np.array(ids, "<u4").tobytes())
            at = batch.schema.get_field_index("body")
            yield batch.set_column(at, "body", pa.array(bodies, pa.binary()))

    def join(group: pa.Table) -> pa.Table:
        code = coder(vocabulary, leaf)
        group = group.sort_by([("part", "ascending"), ("leaf", "ascending")])
        by_part: dict[int, list[bytes]] = {}
        for part, body in zip(group.column("part").to_pylist(), group.column("body").to_pylist()):
            by_part.setdefault(part, []).append(body)
        parts = []
        for leaves in by_part.values():
            if len(leaves) > 1:
                lists = [np.frombuffer(x, "<u4").tolist() for x in leaves]
                leaves = [np.array(climb(lists, code.words.merge, code.token_bytes), "<u4").tobytes()]
            parts += leaves
        n, ids, shown = _digest(parts, code.decoded(parts))
        doc = group.column("doc_id")[0].as_py()
        return pa.Table.from_batches(
            [rows(_SCHEMA, doc_id=[doc], n_tokens=[n], ids_sha256=[ids], decoded_sha256=[shown])]
        )

    schema = "key long, doc_id long, part int, leaf int, body binary, kind int"
    keyed = docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text")
    dealt = map_tasks(keyed, cut, schema).repartition("key", "part", "leaf")
    return map_tasks(dealt, encode, schema).groupBy("key").applyInArrow(join, _COLUMNS)


def digests(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", leaf: int = LEAF, long_text: int = LONG_TEXT) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document.

    The leaves of texts of over ``long_text`` characters are spread over tasks.
    """
    long = F.coalesce(F.length("text") > long_text, F.lit(False))
    return short_texts(docs.where(~long), vocabulary, leaf).unionByName(
        long_texts(docs.where(long), vocabulary, leaf)
    )
