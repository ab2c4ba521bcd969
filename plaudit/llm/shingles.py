"""Words between ASCII blanks and 64-bit hashes of word runs, for many texts at once.

A run of k words is the stretch of text from its first to its last byte, words joined by one
space.  Its polynomial hash comes from prefix sums over the bytes, so no run is ever built.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up, down = (np.full(n, b, np.uint64) for b in (_BASE, _INVERSE))
        up[0] = down[0] = 1
        return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


@dataclass
class Words:
    """Words of several texts: byte ranges in one buffer and the first word of each text."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # one more entry than texts
    prefix: np.ndarray

    def hashes(self, k: int, at: np.ndarray) -> np.ndarray:
        """Of the runs of ``k`` words that begin at words ``at``."""
        return self.stretch(at, at + (k - 1))

    def stretch(self, at: np.ndarray, last: np.ndarray) -> np.ndarray:
        begin = self.starts[at]
        down = _powers(_room(len(self.prefix)))[1]
        with np.errstate(over="ignore"):
            return mix((self.prefix[self.ends[last]] - self.prefix[begin]) * down[begin])

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all runs of ``k`` words inside a text, and the text of each."""
        counts = np.maximum(np.diff(self.first) - (k - 1), 0)
        text = np.repeat(np.arange(len(counts)), counts)
        skipped = np.cumsum(counts) - counts
        return np.arange(counts.sum()) - skipped[text] + self.first[:-1][text], text


def _room(n: int) -> int:
    return 1 << max(16, int(n).bit_length())


def words_of(texts: list[bytes]) -> Words:
    """``bytes.split`` cuts at exactly space, tab, newline, vertical tab, form feed, return."""
    split = [t.split() for t in texts]
    counts = np.array([len(s) for s in split], np.int64)
    buffer = np.frombuffer(b" ".join(b" ".join(s) for s in split if s) + b" ", np.uint8)
    ends = np.flatnonzero(buffer == 32)
    if not counts.sum():
        ends = ends[:0]
    starts = np.concatenate([np.zeros(min(1, len(ends)), np.int64), ends[:-1] + 1])
    with np.errstate(over="ignore"):
        terms = buffer.astype(np.uint64) * _powers(_room(len(buffer) + 1))[0][: len(buffer)]
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
    return Words(starts, ends, np.concatenate([[0], np.cumsum(counts)]), prefix)
