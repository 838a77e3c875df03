"""Joins on "text contains term" through grams, without comparing all texts with all terms.

A few terms (HELD characters in all) are sent to every task, which looks for the rarest gram of each in a slice of texts and compares whole terms where it stands; no row is made for a
gram. More terms than that meet the texts through an index: a text that contains a term contains all its grams (runs of GRAM characters; a shorter term is its own gram). Each term is looked up by the gram that the fewest texts have; texts that
have it meet the term by equality, and only these are searched. A term with a gram that no text has is nowhere.

Nulls and edge cases: null and empty terms are left out; a null text contains nothing; repeated terms are one; keys of texts must be unique, a null key is a key; an empty table gives
an empty result; columns are named in the docstrings, others are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import drop, written

GRAM = 4
#: Characters of terms that every task may hold; texts, and characters, that are searched together; bits of a gram's hash.
HELD, SLICE_ROWS, SLICE_CHARS, HASH_BITS = 4 << 20, 512, 1 << 20, 18


def plain(text: Column) -> Column:
    """Lower case, white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def _grams(text: Column, size: Column) -> Column:
    last = F.length(text) - size + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(text, i, size))))


class _Terms:
    """Terms of one gram length n, as code points in one array."""

    def __init__(self, terms: list[tuple[int, str]], n: int) -> None:
        self.n, self.ids = n, np.array([i for i, _ in terms])
        self.size = np.array([len(t) for _, t in terms])
        self.points = np.concatenate([_points(t) for _, t in terms])
        self.start = np.cumsum(self.size) - self.size
        each = self.size - n + 1  # grams of each term
        self.first = np.cumsum(each) - each
        self.at = np.arange(each.sum()) - np.repeat(self.first, each)
        self.grams = _hashes(self.points, n)[np.repeat(self.start, each) + self.at]

    def search(self, text: np.ndarray, of: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Pairs (row of a text, number of a term) in texts that follow each other: their code points, the row of each and the end of each row."""
        if len(text) < self.n:
            return np.zeros((0, 2), np.int64)
        here = _hashes(text, self.n)
        counts = np.bincount(here, minlength=1 << HASH_BITS)
        cost = counts[self.grams]
        rarest = np.flatnonzero(cost == np.repeat(np.minimum.reduceat(cost, self.first), np.diff(np.append(self.first, len(cost)))))
        rarest = rarest[np.searchsorted(rarest, self.first)]  # the first such gram of each term
        order = np.argsort(self.grams[rarest], kind="stable")
        keys, begin, many = np.unique(self.grams[rarest][order], return_index=True, return_counts=True)
        slot = np.full(1 << HASH_BITS, -1, np.int32)
        slot[keys] = np.arange(len(keys))
        found, places = [], np.flatnonzero(slot[here] >= 0)
        for part in np.array_split(places, 1 + int(many[slot[here[places]]].sum()) // SLICE_CHARS):  # a place meets all terms of its gram
            k = slot[here[part]]
            n = many[k]
            term = order[np.repeat(begin[k], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            start = np.repeat(part, n) - self.at[rarest][term]
            inside = start >= 0
            start, term = start[inside], term[inside]
            inside = start + self.size[term] <= ends[of[start]]
            start, term, depth = start[inside], term[inside], 0
            done = []
            while len(start):
                over = self.size[term] == depth
                done.append(np.stack([of[start[over]], self.ids[term[over]]], 1))
                start, term = start[~over], term[~over]
                same = text[start + depth] == self.points[self.start[term] + depth]
                start, term, depth = start[same], term[same], depth + 1
            found.append(np.unique(np.concatenate(done), axis=0) if done else np.zeros((0, 2), np.int64))
        return np.unique(np.concatenate(found), axis=0)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _hashes(points: np.ndarray, n: int) -> np.ndarray:
    """A hash of the gram of n code points at each place."""
    size = len(points) - n + 1
    h = np.zeros(max(size, 0), np.uint32)
    for k in range(n):
        h = (h ^ points[k : k + size]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return (h >> np.uint32(32 - HASH_BITS)).astype(np.int64)


def _searched(texts: DataFrame, terms: list[str]) -> DataFrame:
    """key and term as containing(): the texts in slices against all terms."""
    sizes = sorted({min(GRAM, len(t)) for t in terms})
    sent = texts.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_terms = sent.value
        groups = [_Terms([(i, t) for i, t in enumerate(all_terms) if min(GRAM, len(t)) == n], n) for n in sizes]
        names = pa.array(all_terms, pa.string())
        for batch in batches:
            column, keys = batch.column(batch.schema.get_field_index("text")), batch.column(batch.schema.get_field_index("key"))
            for at, end in _slices(column):
                each = [_points(t or "") for t in column.slice(at, end - at).to_pylist()]
                size = np.array([len(x) for x in each])
                text, of, ends = np.concatenate(each), np.repeat(np.arange(len(each)), size), np.cumsum(size)
                for group in groups:
                    found = group.search(text, of, ends)
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(found[:, 0] + at)), names.take(pa.array(found[:, 1]))], names=["key", "term"])

    return texts.select("key", "text").mapInArrow(run, T.StructType([texts.schema["key"], T.StructField("term", T.StringType())]))


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Begin and end of runs of SLICE_ROWS texts and SLICE_CHARS bytes at most; a longer text is a run of its own."""
    at, held = 0, 0
    for i, size in enumerate(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()):
        if i > at and (i - at == SLICE_ROWS or held + size > SLICE_CHARS):
            yield at, i
            at, held = i, 0
        held += size
    if at < len(texts):
        yield at, len(texts)


def containing(texts: DataFrame, terms: DataFrame, held: int = HELD) -> DataFrame:
    """key and term for each text (key, text) that contains each term (term)."""
    terms = terms.select("term").where(F.length("term") > 0).distinct()
    few = _few(terms, held)
    return _searched(texts, few) if few is not None else _joined(texts, terms)


def _few(terms: DataFrame, held: int) -> list[str] | None:
    """The terms, if they have `held` characters at most."""
    size = terms.agg(F.coalesce(F.sum(F.length("term")), F.lit(0))).first()[0]
    return sorted(r.term for r in terms.collect()) if size <= held else None


def _joined(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """key and term as containing(), through an index of grams."""
    size = F.least(F.lit(GRAM), F.length("term"))
    of_terms = written(terms.select("term", F.explode(_grams(F.col("term"), size)).alias("gram")))
    sizes = [r.n for r in of_terms.select(F.length("gram").alias("n")).distinct().collect()]  # 1 to GRAM at most
    of_texts = texts.select("key", F.explode(F.array_distinct(F.concat(*[F.coalesce(_grams(F.col("text"), F.lit(n)), F.array().cast("array<string>")) for n in sizes] or [F.array().cast("array<string>")]))).alias("gram"))
    postings = written(of_texts.join(of_terms.select("gram").distinct(), "gram", "left_semi"))
    held = of_terms.join(postings.groupBy("gram").agg(F.count("*").alias("n")), "gram", "left")
    rarest = held.groupBy("term").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).where("r.n > 0").select("term", "r.gram")
    met = rarest.join(postings, "gram").select("key", "term").withColumnRenamed("key", "k")
    found = written(met.join(texts.select("key", "text"), F.col("k").eqNullSafe(F.col("key"))).where(F.contains("text", "term")).select("key", "term"))
    drop(of_terms, postings)
    return found


def mentions(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """key and term for each text that names each term: case and white space don't matter, and a plural s at the term's end may be missing."""
    stem = F.regexp_replace(plain(F.col("term")), "s$", "")
    forms = terms.where("term IS NOT NULL").select("term", stem.alias("stem")).distinct()
    found = containing(texts.select("key", plain(F.col("text")).alias("text")), forms.select(F.col("stem").alias("term")))
    return found.withColumnRenamed("term", "stem").join(forms, "stem").select("key", "term")


def unmentioned(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """The distinct terms that no text names; null and empty ones are left out."""
    found = mentions(texts, terms).select("term").distinct()
    return terms.select("term").where(F.length(plain(F.col("term"))) > 0).distinct().join(found, "term", "left_anti")
