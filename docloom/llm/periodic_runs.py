"""Periodic runs of words, by recursive frequency splitting and lag scans.

A run is a stretch of words with smallest period q and at least max(LEAST, TIMES * q) words that no neighbouring word extends. Each of its words
occurs TIMES times or more inside it. So a word that is rarer than that within its segment can be in no run of the segment, and splits it; pieces are
split again by their own counts until nothing changes. What survives is scanned by lags: words that equal the word q places on, in stretches
of max(LEAST, TIMES * q) - q. Lags up to SMALL are all scanned. Beyond, a run of period q in [b, 2b) holds a block of b words that begins at a multiple of b
and comes again q words later, so only lags at which some such block comes again are scanned. All hits are compared word by word.

All steps are array operations over the words of a whole slice of documents at once; segments are kept apart by marks that equal no word.

Nulls and edge cases: a null, empty or blank text has no words and no runs; null ids and repeated rows are rows like any other; an empty table gives an empty
result; very long texts are worked through whole, in memory in proportion to their length; input columns stay in the struct `row`, so no name can clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, named, packed

#: Words of a run at least, and periods of a run at least.
LEAST, TIMES = 6, 4
#: Lags that are scanned without asking whether a block comes again.
SMALL = 8
#: Comparisons of blocks made in one go; bounds memory, not what is found.
CELLS = 1 << 20
RADIX = np.uint64(0x9E3779B97F4A7C15)


def word_ids(texts: list[str]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """The words of each text, a number for each word of all texts (equal words, equal numbers), and the text of each."""
    words = [t.encode("utf-8", "surrogatepass").split() for t in texts]  # bytes are split at ASCII white space only
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for row in words for w in row), np.int64, sum(map(len, words)))
    return words, ids, np.repeat(np.arange(len(words)), [len(row) for row in words])


def survivors(ids: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places that no split has removed, in order, and a number for the segment of each; words of one segment stand side by side."""
    place = np.arange(len(ids))
    while True:
        if not len(place):
            return place, segment
        order = np.lexsort((ids[place], segment))
        key_segment, key_word = segment[order], ids[place][order]
        first = np.concatenate([[True], (key_segment[1:] != key_segment[:-1]) | (key_word[1:] != key_word[:-1])])
        count = np.diff(np.concatenate([np.flatnonzero(first), [len(order)]]))
        frequent = np.empty(len(order), bool)
        frequent[order] = np.repeat(count >= TIMES, count)
        left, seg = place[frequent], segment[frequent]
        new = np.concatenate([[True], (np.diff(left) != 1) | (np.diff(seg) != 0)]) if len(left) else np.zeros(0, bool)
        size = np.diff(np.concatenate([np.flatnonzero(new), [len(left)]]))
        enough = np.repeat(size >= LEAST, size)
        again, number = left[enough], np.repeat(np.arange(len(size)), size)[enough]
        if len(again) == len(place):
            return again, number
        place, segment = again, number


def _spaced(ids: np.ndarray, place: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of segments one after another with a mark of its own behind each segment, and their places (marks: -1)."""
    ends = np.flatnonzero(np.diff(segment, append=-1)) + 1
    return np.insert(ids[place], ends, -1 - np.arange(len(ends))), np.insert(place, ends, -1)


def _lags(words: np.ndarray, block: int, covered: np.ndarray) -> np.ndarray:
    """The lags from block to 2 * block - 1 at which a block of words that begins at a multiple of block comes again.

    covered: for each word, how many words from it on lie in one run of a smaller period that is known already. A block that comes again within
    such a run says nothing: what holds both has a smaller period.
    """
    with np.errstate(over="ignore"):
        h = words.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(1)
        h ^= h >> np.uint64(31)
        power, size = RADIX, 1
        while size < block:  # the hash of 2k words is made from those of k words, as block is a power of two
            h = h[:-size] * power + h[size:]
            power *= power
            size *= 2
    found = np.zeros(block, bool)
    rows = max(0, len(h) // block - 1)
    for at in range(0, rows, max(1, CELLS // block)):
        to = min(rows, at + max(1, CELLS // block))
        again = h[(at + 1) * block : (to + 1) * block].reshape(-1, block) == h[at * block : to * block : block, None]
        known = covered[at * block : to * block : block] - 2 * block
        for i in np.flatnonzero(known >= 0).tolist():
            again[i, : int(known[i]) + 1] = False
        found |= again.any(axis=0)
    rest = h[(rows + 1) * block :]
    if len(rest):
        again = rest[:block] == h[rows * block]
        again[: max(0, int(covered[rows * block]) - 2 * block + 1)] = False
        found[: len(again)] |= again
    return block + np.flatnonzero(found)


def find(ids: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Start, end (exclusive) and period of all runs, as places in ids, ordered by start and period; row tells texts apart."""
    place, segment = survivors(ids, row)
    runs: list[np.ndarray] = []
    block, lags = 1, np.arange(1, SMALL)
    while len(place):
        words, at = _spaced(ids, place, segment)
        for q in lags.tolist():
            if q >= len(words):
                break
            same = np.concatenate([[False], words[q:] == words[:-q], [False]])
            edge = np.flatnonzero(same[1:] != same[:-1])
            begin, end = edge[::2], edge[1::2]
            long = end - begin + q >= max(LEAST, TIMES * q)
            first = at[begin[long]]
            runs.append(np.stack([first, first + (end - begin)[long] + q, np.full(len(first), q)], axis=1))
        block = SMALL if block == 1 else block * 2
        size = np.bincount(segment)
        wide = size[segment] >= TIMES * block
        place, segment = place[wide], segment[wide]
        if len(place):
            words, at = _spaced(ids, place, segment)
            known = np.concatenate(runs)
            known = known[np.argsort(known[:, 0], kind="stable")]
            reach = np.concatenate([[0], np.maximum.accumulate(known[:, 1])])
            lags = _lags(words, block, reach[np.searchsorted(known[:, 0], at, side="right")] - at)
    found = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    if len(found):  # one stretch has one smallest period, and its multiples find it again
        found = found[np.concatenate([[True], (np.diff(found[:, 0]) != 0) | (np.diff(found[:, 1]) != 0)])]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))
ADDED = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])


def _compute(texts: list[str]) -> dict[str, list]:
    words, ids, row = word_ids(texts)
    begins = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    found = find(ids, row)
    change = np.zeros(len(ids) + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 1], -1)
    kept = np.cumsum(change[:-1]) == 0
    bounds = np.searchsorted(found[:, 0], begins)
    out: dict[str, list] = {"n_words": [len(w) for w in words], "runs": [], "collapsed": []}
    for i, line in enumerate(words):
        mine = found[bounds[i] : bounds[i + 1]]
        out["runs"].append([{"start": s - int(begins[i]), "length": e - s, "period": q} for s, e, q in mine.tolist()])
        stay = line if not len(mine) else [w for w, k in zip(line, kept[begins[i] : begins[i + 1]].tolist()) if k]
        out["collapsed"].append(b" ".join(stay).decode("utf-8", "surrogatepass"))
    return out


def runs(docs: DataFrame, keep_rows: bool = True) -> DataFrame:
    """row (if asked for), doc_id, n_words, runs (start, length and period in words, by start and period) and collapsed: the text with each run cut to its first period."""
    return map_texts(packed(docs), _compute, ADDED, ("row", "doc_id") if keep_rows else ("doc_id",))


def longest(found: F.Column) -> F.Column:
    """The run of greatest length (ties: smallest start, then period), or null."""
    best = F.array_max(F.transform(found, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(best.isNotNull(), F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))


def listed(found: F.Column) -> F.Column:
    """A line of start, length and period for each run."""
    return F.array_join(F.transform(found, lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")


def with_planted_repeats(docs: DataFrame) -> DataFrame:
    """docs with the texts whose id has a crc32 that ends in 0 made periodic from some word on; a null id is never planted.

    The crc32 of the decimal id gives where (its tenth, modulo the number of words) and the period (so that it comes 3 to 10 times, rounded).
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size("_words").cast("long")
    g = F.floor(h / 10)
    a = F.pmod(g, n)
    p = F.floor((n - a) / (F.pmod(g, F.lit(8)) + 3)) + 1
    head = F.slice("_words", F.lit(1), F.col("_a").cast("int"))
    piece = F.slice("_words", (F.col("_a") + 1).cast("int"), F.col("_p").cast("int"))
    times = F.ceil((F.col("_n") - F.col("_a")) / F.col("_p")).cast("int")
    text = F.array_join(F.slice(F.concat(head, F.flatten(F.array_repeat(piece, times))), F.lit(1), F.col("_n").cast("int")), " ")
    rest = [F.col("row")[c].alias(c) for c in docs.columns if c != "text"]
    due = F.coalesce(h, F.lit(1)) % 10 == 0
    rows = docs.select(F.struct(*[named(c) for c in docs.columns]).alias("row"), F.when(due, words).alias("_words"), "doc_id", "text")
    sized = rows.withColumns({"_n": n, "_a": a, "_p": p})
    return sized.select(*rest, F.when(F.size("_words") > 0, text).otherwise(F.col("row.text")).alias("text"))
