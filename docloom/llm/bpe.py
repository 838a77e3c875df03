"""BPE encoding and decoding by forced boundaries.

Merges only ever make tokens of the vocabulary, so a pair of neighbouring bytes that occurs inside no token is a certain cut: nothing merges
across it. A text is cut first where the tokenizer's pattern cuts, then at every forced boundary; the fragments are encoded each
on its own and their ids are concatenated. Fragments repeat, so each worker keeps a bounded memory of what it encoded.

The vocabulary is a parameter (a file of the tokenizers library with a byte-level BPE model); nothing is trained.

Nulls and edge cases: a null text is read as empty and has no ids; special tokens' strings in a text become their ids, as in the
library; null ids, repeated rows and empty tables are no special cases; input columns stay in the struct `row`. Nothing is shuffled.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_texts, packed

# Fixed value: the pattern by which byte-level BPE cuts text before any merge.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of each generation of a worker's memory, for pieces of text and for fragments: at most twice as many are held.
REMEMBER_PIECES, REMEMBER_FRAGMENTS = 300_000, 400_000
#: Ids have fewer bits than this.
SHIFT = 24
MASK = (1 << SHIFT) - 1
NONE = 1 << 62


def byte_letters() -> dict[str, int]:
    """The printable stand-in of every byte in the vocabulary file: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Memory(dict):
    """A bounded memory in two generations: when the young one is full the old one is forgotten. A miss is made by `make`."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > 64:
                return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class ByteBpe:
    """A byte-level BPE read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        to_bytes = lambda token: bytes(letters[c] for c in token)
        ids = spec["model"]["vocab"]
        vocabulary = {to_bytes(t): i for t, i in ids.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        #: A pair of ids, as one number, leads to rank and new id, as one number: the least of these is the merge to make.
        self.merges = {ids[a] << SHIFT | ids[b]: rank << SHIFT | ids[a + b] for rank, (a, b) in enumerate(pairs)}
        self.byte_id = [vocabulary[bytes([b])] for b in range(256)]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.tokens = [b""] * size
        for token, i in vocabulary.items():
            self.tokens[i] = token
        for content, i in self.special.items():
            self.tokens[i] = content.encode()
        self.allowed = {pair for token in vocabulary for pair in zip(token, token[1:])}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pattern = regex.compile(PATTERN)
        self.fragments = Memory(self.merge, REMEMBER_FRAGMENTS)
        self.pieces = Memory(self.spaced, REMEMBER_PIECES)
        self.starts = Memory(self.piece, REMEMBER_PIECES // 8)
        self.line_feed = self.merge(b"\n")

    def forced_cuts(self, data: bytes) -> list[bytes]:
        """data in fragments, cut between every two bytes that stand together in no token."""
        out, begin = [], 0
        if not self.allowed.issuperset(zip(data, data[1:])):
            for i in range(1, len(data)):
                if (data[i - 1], data[i]) not in self.allowed:
                    out.append(data[begin:i])
                    begin = i
        out.append(data[begin:])
        return out

    def merge(self, fragment: bytes) -> bytes:
        """Ids of one fragment as little-endian 32-bit integers: always the leftmost pair of least rank is merged."""
        parts = [self.byte_id[b] for b in fragment]
        if len(parts) > 64:
            return array("I", self._merge_long(parts)).tobytes()
        find = self.merges.get
        ways = [find(a << SHIFT | b, NONE) for a, b in zip(parts, parts[1:])]
        while ways and (least := min(ways)) != NONE:
            i = ways.index(least)
            parts[i : i + 2] = [least & MASK]
            del ways[i]
            if i:
                ways[i - 1] = find(parts[i - 1] << SHIFT | parts[i], NONE)
            if i < len(ways):
                ways[i] = find(parts[i] << SHIFT | parts[i + 1], NONE)
        return array("I", parts).tobytes()

    def _merge_long(self, parts: list[int]) -> list[int]:
        """As merge(), with a heap and links: time near n log n for a fragment without any boundary. A part that is gone is -1."""
        n, find = len(parts), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(way, i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (way := find(a << SHIFT | b)) is not None]
        heapq.heapify(heap)
        while heap:
            way, i = heapq.heappop(heap)
            j = after[i] if parts[i] >= 0 else n
            if j >= n or find(parts[i] << SHIFT | parts[j]) != way:
                continue
            parts[i], parts[j] = way & MASK, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (way := find(parts[a] << SHIFT | parts[b])) is not None:
                    heapq.heappush(heap, (way, a))
        return [p for p in parts if p >= 0]

    def piece(self, text: str) -> bytes:
        """Ids of a piece of text that begins and ends at a certain cut of the pattern."""
        known, cuts = self.fragments, self.forced_cuts
        return b"".join([known[f] for part in self.pattern.findall(text) for f in cuts(part.encode("utf-8", "replace"))])

    def spaced(self, word: str) -> bytes | None:
        """Ids of a blank and a word after it; None if white space is beside the blank, where the pattern's cuts depend on more."""
        return None if not word or word[0].isspace() or word[-1].isspace() else self.piece(" " + word)

    def plain(self, text: str) -> bytes:
        """Ids of a text without special tokens.

        The pattern always cuts before and after a line feed, and before a blank, if no other white space is beside it. Where there is,
        or one of the separators that only Python takes for white space, the text is cut at the pattern's every match.
        """
        if not _ODD.search(text):
            known, out = self.pieces, []
            try:
                for line in text.split("\n"):
                    first, *rest = line.split(" ")
                    if not first or first[0].isspace() or first[-1].isspace():
                        raise TypeError
                    out.append(self.starts[first])
                    out += [known[w] for w in rest]
                    out.append(self.line_feed)
                out.pop()
                return b"".join(out)
            except TypeError:  # a None among the ids
                pass
        return b"".join([self.piece(p) for p in _PIECES.findall(text)]) if not _ODD.search(text) else self.piece(text)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if self.at_special is None or not self.at_special.search(text):
            return self.plain(text)
        return b"".join(array("I", [self.special[x]]).tobytes() if x in self.special else self.plain(x) for x in self.at_special.split(text) if x)

    def decode(self, ids: bytes) -> str:
        """The text of ids; special tokens appear as their strings, bytes that are no UTF-8 as replacement characters."""
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


_ODD = re.compile("[\x1c-\x1f]")
_PIECES = re.compile(r"\s*\S+|\s+")
_LOADED: dict[str, ByteBpe] = {}


def loaded(path: str) -> ByteBpe:
    """The tokenizer of this worker process for a file."""
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


ENCODED = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.StringType())])


def encode(docs: DataFrame, path: str, decode: bool = True) -> DataFrame:
    """row, doc_id, ids (little-endian 32-bit), n_tokens, and decoded, the text made of those ids again."""

    def compute(texts: list[str]) -> dict:
        bpe = loaded(path)
        ids = [bpe.encode(t) for t in texts]
        return {"ids": ids, "n_tokens": [len(i) // 4 for i in ids], "decoded": [bpe.decode(i) if decode else None for i in ids]}

    return map_texts(packed(docs), compute, ENCODED, ("row", "doc_id"))
