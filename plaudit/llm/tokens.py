"""Token ids exactly as the tokenizers library gives them, with each distinct word encoded once.

Both vocabularies treat the stretches between blanks independently of each other, so a text is
cut into such stretches, and a cache per worker maps a stretch to its ids.  Stretches that the
cache lacks are split by the vocabulary's own pattern and merged by rank; whatever is unusual
(special token strings, characters outside ASCII and Latin-1 letters, odd blanks) goes to the
tokenizers library itself.
"""

from __future__ import annotations

import base64
import json
import re
import struct
from collections.abc import Callable
from functools import lru_cache

import public_tokenizers
import regex
import tiktoken
from tokenizers import Tokenizer

CACHE_WORDS = 400_000  # in each of two generations
#: The pattern by which word_bpe_49k cuts words (as its file states it).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
# A run of blanks gives all but its last blank as one stretch; the last goes with what follows.
_STRETCHES = re.compile(r"[ \n]+(?=[ \n][^ \n])| ?[^ \n]+|[ \n]+")
_OTHER_BLANK = re.compile(r"[^\S \n]")
_BLANK = regex.compile(r"\p{White_Space}+")
_SEPARATORS = re.compile("[\x1c-\x1f]")  # blanks for str.split alone
_SPECIAL = re.compile(r"(<\|startoftext\|>|<\|endoftext\|>)")
END = b"\xff"  # stands for the end of a word; never a byte of UTF-8


def token_file(name: str) -> str:
    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def library(name: str) -> Tokenizer:
    out = Tokenizer.from_file(token_file(name))
    out.no_padding()
    out.no_truncation()
    return out


@lru_cache(maxsize=2)
def byte_of() -> dict[str, int]:
    """The printable characters in which byte-level vocabularies write bytes, in order: printable
    bytes stand for themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def word_merger(name: str) -> tiktoken.Encoding:
    """The word vocabulary by merge rank, the end-of-word mark as one byte.

    Single bytes with the mark come before every other merge, as they are symbols of their own.
    """
    with open(token_file(name)) as f:
        model = json.load(f)["model"]
    end, table = model["end_of_word_suffix"], byte_of()
    ranks: dict[bytes, int] = {}
    for token, i in model["vocab"].items():
        body, mark = (token[: -len(end)], END) if token.endswith(end) else (token, b"")
        if all(c in table for c in body) and body:
            ranks[bytes(table[c] for c in body) + mark] = i
    ranks = {k: v for k, v in ranks.items() if len(k) == 1 or not k.startswith(b"<|")}
    return tiktoken.Encoding(name, pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})


def packed(ids: list[int]) -> bytes:
    """Little-endian 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Cache(dict):
    """Ids of stretches, each encoded when it is first asked for.

    Two generations: a full cache becomes the older one, and what is asked for again moves over.
    """

    def __init__(self, encode: Callable[[str], list[int]]) -> None:
        super().__init__()
        self.encode = encode
        self.older: dict[str, bytes] = {}

    def __missing__(self, part: str) -> bytes:
        ids = self.older.get(part)
        if ids is None:
            ids = packed(self.encode(part))
        if len(part) < 64:
            if len(self) >= CACHE_WORDS:
                self.older = dict(self)
                self.clear()
            self[part] = ids
        return ids


class WordEncoder:
    """Ids by word_bpe_49k: lower case, blanks dropped."""

    def __init__(self, name: str = "word_bpe_49k.json") -> None:
        self.exact = library(name)
        self.merge = word_merger(name)._core_bpe.encode_single_piece
        self.cut = regex.compile(WORD_PATTERN)
        self.cache = Cache(self.stretch)

    def piece(self, word: str) -> list[int]:
        return self.merge(word.encode() + END)

    def stretch(self, part: str) -> list[int]:
        if _LETTERS.fullmatch(part):
            return self.piece(part.lower())
        if _PLAIN.fullmatch(part) and "<|" not in part:
            return [i for w in self.cut.findall(part.lower()) for i in self.piece(w)]
        return self.exact.encode(part, add_special_tokens=False).ids

    def pieces(self, part: str) -> list[bytes | int]:
        """What a stretch is merged from: words as bytes, special strings as ids."""
        out: list[bytes | int] = []
        table = byte_of()
        for section in _SPECIAL.split(part):
            if section and (i := self.exact.token_to_id(section)) is not None and section.startswith("<|"):
                out.append(i)
                continue
            plain = self.exact.normalizer.normalize_str(section)
            for word, _ in self.exact.pre_tokenizer.pre_tokenize_str(plain):
                out.append(bytes(table[c] for c in word))
        return out

    @staticmethod
    def cut_blanks(text: str) -> list[str]:
        """Stretches between blanks, as the vocabulary's own pattern sees blanks."""
        return _BLANK.split(text) if _SEPARATORS.search(text) else text.split()

    def parts(self, text: str) -> list[bytes]:
        """Ids of each stretch as little-endian 32-bit integers."""
        return list(map(self.cache.__getitem__, self.cut_blanks(text)))

    def encode(self, text: str) -> bytes:
        return b"".join(self.parts(text))


class ByteEncoder:
    """Ids by byte_bpe_50k: every byte kept, special strings as the library takes them."""

    def __init__(self, name: str = "byte_bpe_50k.json") -> None:
        self.exact = library(name)
        with open(token_file(name.replace(".json", ".tiktoken")), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        merger = tiktoken.Encoding(
            name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.plain = merger.encode_ordinary
        self.cache = Cache(self.plain)

    def encode(self, text: str) -> bytes:
        if "<|" in text:
            return packed(self.exact.encode(text, add_special_tokens=False).ids)
        if _OTHER_BLANK.search(text):
            return packed(self.plain(text))
        return b"".join(map(self.cache.__getitem__, _STRETCHES.findall(text)))


@lru_cache(maxsize=1)
def word_encoder(name: str = "word_bpe_49k.json") -> WordEncoder:
    return WordEncoder(name)


@lru_cache(maxsize=1)
def byte_encoder(name: str = "byte_bpe_50k.json") -> ByteEncoder:
    return ByteEncoder(name)
