"""Benchmark decontamination by a prefix-filtered set join.

A window is `size` consecutive words of a benchmark item (an item of fewer words is one window). Containment must be whole, so
one necessary prefix token of a window is enough: its rarest shingle of up to PIECE words. The steps:

1. A bit filter of bounded size tells which document positions may begin a shingle of the benchmark; only these leave the document
   scan, with the words around them. A false positive costs a row, never a wrong result.
2. Shingles are ordered by rarity among these positions, and each distinct window is joined on its rarest shingle.
3. Positional bound: the window's place follows from that of the shingle and must begin in the document. Length bound: it must
   end there too. Then the words themselves are compared.

Nulls and edge cases: a null or empty text has no words, so no hit; an item without words (or null) has no window; null ids are
kept, and a null item_id counts in n_items but can't be listed; repeated items or documents are items or documents like any
other; an empty benchmark leaves every document clean; input columns stay in the struct `row`.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, packed, written

SIZE = 10
PIECE = 5
#: The filter has 2048 bits for each distinct shingle, but from 2**20 to 2**29: what is broadcast stays within 64 MiB for any benchmark.
MIN_BITS, MAX_BITS, BITS_EACH = 20, 29, 2048

_WORD_BYTES = frozenset([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: Bytes of words: digits, letters in lower case, all beyond ASCII; every other byte becomes a blank.
FOLD = bytes(c if c in _WORD_BYTES else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
RADIX = 0x9E3779B97F4A7C15
#: Words that are hashed in one go.
PART = 1 << 17


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


def slice_hashes(data: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[begin:end] for each pair, from prefix sums of a polynomial; equal bytes have equal hashes anywhere."""
    raw = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        power = np.full(len(raw), RADIX, np.uint64)
        back = np.full(len(raw), pow(RADIX, -1, 1 << 64), np.uint64)
        power[:1] = back[:1] = 1
        raw *= np.multiply.accumulate(power)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(raw, dtype=np.uint64)])
        h = (sums[end] - sums[begin]) * np.multiply.accumulate(back)[begin]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def shingle_hashes(rows: list[list[bytes]], sizes: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each size: hash and position (over all words of all rows, one row after the other) of every shingle within a row."""
    words = [w for r in rows for w in r]
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    found: dict[int, list] = {k: [(np.zeros(0, np.uint64), np.zeros(0, np.int64))] for k in sizes}
    for first in range(0, len(words), PART):
        part = words[first : first + PART + max(sizes, default=1) - 1]
        data = b" ".join(part)
        length = np.fromiter(map(len, part), np.int64, len(part))
        end = np.cumsum(length + 1) - 1
        begin = end - length
        for k in sizes:
            at = np.arange(max(0, min(PART, len(part) - k + 1)))
            at = at[row[first + at] == row[first + at + k - 1]]
            found[k].append((slice_hashes(data, begin[at], end[at + k - 1]), first + at))
    return {k: tuple(np.concatenate(x) for x in zip(*parts)) for k, parts in found.items()}


def item_words(text: F.Column) -> F.Column:
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


class Benchmark:
    """The windows of a benchmark: classes of equal items, distinct windows, the shingles of each, and the bit filter."""

    def __init__(self, benchmark: DataFrame, size: int = SIZE):
        self.size = size
        # Items of the same words are one class, so copies of an item don't multiply matches.
        self.classes = written(
            benchmark.select(F.col("item_id").cast("string").alias("item_id"), item_words(F.col("text")).alias("words")).where(F.size("words") > 0)
            .groupBy("words").agg(F.array_sort(F.collect_list("item_id")).alias("ids"), F.count("*").alias("n_copies"))
            .withColumn("class_id", F.monotonically_increasing_id()), "classes"
        )
        span = F.least(F.lit(size), F.size("words"))
        self.windows = (
            self.classes.select("class_id", "words", span.alias("n"), F.explode(F.sequence(F.lit(0), F.size("words") - span)).alias("at"))
            .select("class_id", "n", F.array_join(F.slice("words", F.col("at") + 1, F.col("n")), " ").alias("window")).distinct()
        )
        k = F.least(F.lit(PIECE), F.col("n"))
        self.shingles = written(
            self.windows.select("window", "n").distinct().select("window", "n", k.alias("k"), F.explode(F.sequence(F.lit(0), F.col("n") - k)).alias("off"))
            .select("window", "n", "k", "off", F.array_join(F.slice(F.split("window", " "), F.col("off") + 1, F.col("k")), " ").alias("shingle")), "shingles"
        )
        self.sizes = sorted(r.k for r in self.shingles.select("k").distinct().collect())  # 1 to PIECE at most
        self.bits, self.filter = self._filter()

    def _filter(self) -> tuple[int, np.ndarray]:
        distinct = self.shingles.select(F.col("shingle").alias("text")).distinct()
        bits = int(np.clip(np.ceil(np.log2(max(1, distinct.count()) * BITS_EACH)), MIN_BITS, MAX_BITS))

        def compute(texts: list[str]) -> dict:
            data = [t.encode("utf-8", "surrogatepass") for t in texts]
            end = np.cumsum(np.fromiter((len(d) + 1 for d in data), np.int64, len(data))) - 1
            begin = end - np.fromiter(map(len, data), np.int64, len(data))
            return {"bit": (slice_hashes(b" ".join(data), begin, end) >> np.uint64(64 - bits)).astype(np.int64)}

        marked = map_texts(distinct, compute, T.StructType([T.StructField("bit", T.LongType())]), ())
        word, mask = F.shiftright("bit", 6), F.expr("shiftleft(1L, cast(bit & 63 as int))")
        rows = marked.groupBy(word.alias("word")).agg(F.bit_or(mask).alias("mask")).toArrow()  # at most 2**bits / 64 rows
        out = np.zeros(1 << (bits - 6), np.uint64)
        out[rows.column("word").to_numpy()] = rows.column("mask").to_numpy().astype(np.int64).view(np.uint64)
        return bits, out


HITS = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("k", T.IntegerType()), T.StructField("lead", T.IntegerType()), T.StructField("near", T.StringType())]))


def scan(docs: DataFrame, bench: Benchmark, keep_rows: bool = False) -> DataFrame:
    """doc_id, rid, n_words and the candidate positions of every document (and row, if asked for), written once."""
    shared, bits, sizes, size = docs.sparkSession.sparkContext.broadcast(bench.filter), bench.bits, bench.sizes, bench.size

    def compute(texts: list[str]) -> dict:
        rows = [words_of(t) for t in texts]
        bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        hits: list[list[tuple]] = [[] for _ in rows]
        for k, (h, at) in shingle_hashes(rows, sizes).items():
            bit = h >> np.uint64(64 - bits)
            at = at[(shared.value[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1]
            before, after = (size - k, size) if k == PIECE else (0, k)
            for d, p in zip((np.searchsorted(bounds, at, side="right") - 1).tolist(), at.tolist()):
                p -= int(bounds[d])
                lead = min(p, before)
                hits[d].append((p, k, lead, b" ".join(rows[d][p - lead : p + after]).decode("utf-8", "surrogatepass")))
        return {"n_words": [len(r) for r in rows], "hits": [[dict(zip(("pos", "k", "lead", "near"), h)) for h in x] for x in hits]}

    added = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hits", HITS)])
    found = map_texts(packed(docs), compute, added, ("row", "doc_id") if keep_rows else ("doc_id",))
    return written(found.withColumn("rid", F.monotonically_increasing_id()), "scan")


def contamination(scanned: DataFrame, bench: Benchmark) -> DataFrame:
    """rid, n_hit, n_items and items (sorted ids, joined by commas) of the documents that hold a window; no others."""
    hits = scanned.where(F.size("hits") > 0).select("rid", "n_words", F.explode("hits").alias("h")).select(
        "rid", "n_words", "h.pos", "h.k", "h.lead", F.split("h.near", " ").alias("near")
    ).withColumn("shingle", F.array_join(F.slice("near", F.col("lead") + 1, F.col("k")), " "))
    frequency = hits.groupBy("shingle").agg(F.count("*").alias("f"))
    prefix = (
        bench.shingles.join(frequency, "shingle")
        .groupBy("window", "n").agg(F.min(F.struct("f", "shingle", "off")).alias("p"), F.count("*").alias("n_found"))
        .where(F.col("n_found") == F.col("n") - F.least(F.lit(PIECE), F.col("n")) + 1)  # a window with a shingle that is nowhere is nowhere
        .select("window", "n", "p.shingle", "p.off")
    )
    first = F.col("pos") - F.col("off")
    matched = (
        hits.join(prefix, "shingle")
        .where((first >= 0) & (first + F.col("n") <= F.col("n_words")))
        .where(F.array_join(F.slice("near", F.col("lead") - F.col("off") + 1, F.col("n")), " ") == F.col("window"))
        .select("rid", first.alias("first"), (first + F.col("n")).alias("end"), "window")
    )
    matched = written(matched, "matched")
    reached = F.max("end").over(Window.partitionBy("rid").orderBy("first", "end").rowsBetween(Window.unboundedPreceding, -1))
    covered = (
        matched.select("rid", "first", "end").distinct()
        .select("rid", F.greatest(F.lit(0), F.col("end") - F.greatest("first", F.coalesce(reached, F.lit(0)))).alias("fresh"))
        .groupBy("rid").agg(F.sum("fresh").cast("long").alias("n_hit"))
    )
    classes = matched.select("rid", "window").distinct().join(bench.windows, "window").select("rid", "class_id").distinct()
    listed = (
        classes.join(bench.classes.select("class_id", "ids", "n_copies"), "class_id")
        .groupBy("rid").agg(F.sum("n_copies").alias("n_items"), F.array_join(F.array_sort(F.flatten(F.collect_list("ids"))), ",").alias("items"))
    )
    return covered.join(listed, "rid")


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, keep_rows: bool = False) -> DataFrame:
    """doc_id, rid, n_words, n_hit, n_items, items and contaminated for every row of docs (and row, if asked for)."""
    bench = Benchmark(benchmark, size)
    scanned = scan(docs, bench, keep_rows)
    base = scanned.drop("hits")
    if not bench.sizes:
        return base.select("*", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.lit("").alias("items"), F.lit(False).alias("contaminated"))
    zero = F.lit(0).cast("long")
    return base.join(contamination(scanned, bench), "rid", "left").select(
        *base.columns, F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items", F.lit("")).alias("items"), F.col("n_hit").isNotNull().alias("contaminated")
    )
