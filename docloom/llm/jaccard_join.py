"""N-gram Jaccard join with adaptive prefixes that must match several times.

Documents of equal shingle sets are one class; classes are joined. Shingles are put in one order, rarest first by a counting sketch over all documents
(any one order gives right results; a good one gives few candidates). If two sets reach the threshold, then for every l their prefixes of
size - needed + l shingles share l of them. A longer prefix costs more rows of the join and, as more must be shared, saves verifications; each class
takes the l of least estimated cost. A pair must share the smaller l of its two, each of them early enough that the rest can still reach the
overlap that the two sizes need. Sizes meet by bands of the threshold's ratio. Every candidate is verified on whole sets.

Large groups of near copies: classes with shingles that many prefixes hold are first verified against one leader, a class that has such shingles earliest. Classes that
these links join need no further links between each other, so only prefix shingles that different components share are joined; `pairs` has all links.

Shingles are told apart by 64-bit hashes. Nulls and edge cases: a null, empty or blank text has no shingles, links with nothing and is its own
component; a text of fewer words than a shingle is one shingle of all; rows with a null doc_id take part, but a component takes its id from the ids there are
(none: null); repeated rows and ids are rows like any other; an empty table gives an empty result; other columns stay out of the way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_BYTES, SLICE_ROWS, drop, map_texts, packed, slices, written
from .components import components
from .decontaminate import slice_hashes

SHINGLE = 3
#: Similarity in hundredths.
THRESHOLD = 90
#: Counters of the sketch are two to this power; 16 MiB are broadcast.
BITS = 22
#: Counters in a row of the sketch, and rows that are added up in one go.
CHUNK, FAN = 1 << 16, 64
#: The longest prefix asks for so many shared shingles.
MOST = 4
#: Shingles in more prefixes than this have their holders verified against a leader first.
CROWD = 2
#: Cost of verifying one shingle, against one row of the join.
VERIFY = 0.004
SKETCH = pa.schema([("chunk", pa.int32()), ("part", pa.int32()), ("counts", pa.binary())])


def shingles(texts: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and text number of all shingles, text by text with repeats, and the number of words of each text."""
    lines = [b" ".join(t.encode("utf-8", "surrogatepass").lower().split()) for t in texts]  # ASCII letters and ASCII white space only, as for bytes
    n_words = np.array([x.count(b" ") + 1 if x else 0 for x in lines], np.int64)
    data = b" ".join(x for x in lines if x)
    if not data:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), n_words
    end = np.append(np.flatnonzero(np.frombuffer(data, np.uint8) == 0x20), len(data))
    begin = np.concatenate([[0], end[:-1] + 1])
    row = np.repeat(np.arange(len(texts)), n_words)
    last_of = np.cumsum(n_words)[row] - 1
    at = np.arange(len(end))
    last = np.minimum(at + size - 1, last_of)
    short = n_words[row] < size
    whole = (at + size - 1 <= last_of) | short & (at == last_of - n_words[row] + 1)
    return slice_hashes(data, begin[whole], end[last[whole]]), row[whole], n_words


def needed(size: F.Column | np.ndarray, other: F.Column | np.ndarray, threshold: int = THRESHOLD):
    """The least overlap with which sets of these sizes reach the threshold."""
    both = (size + other) * threshold + 99 + threshold
    return F.floor(both / (100 + threshold)) if isinstance(both, F.Column) else both // (100 + threshold)


# The sketch: how many documents hold the shingles of each bucket, over all documents


def _packed_counts(counts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(counts.astype("<u8").tobytes())


def _counts(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), "<u8")


def sketch(docs: DataFrame, size: int = SHINGLE, bits: int = BITS) -> np.ndarray:
    """Documents with a shingle of each bucket (the first bits of its hash). Each task counts its documents; counts are added FAN at a time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(1 << bits, np.uint64)
        for batch in batches:
            for at, end in slices(batch.column(0), SLICE_ROWS, SLICE_BYTES):
                h, row, _ = shingles([t or "" for t in batch.column(0).slice(at, end - at).to_pylist()], size)
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])]) if len(h) else np.zeros(0, bool)
                total += np.bincount((h[new] >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint64)
        task = TaskContext.get().partitionId()
        for c in range(max(1, (1 << bits) // CHUNK)):
            part = total[c * CHUNK : (c + 1) * CHUNK]
            if part.any():
                yield pa.RecordBatch.from_pydict({"chunk": [c], "part": [task], "counts": [_packed_counts(part)]}, SKETCH)

    def add(group: pa.Table) -> pa.Table:
        total = sum(_counts(b.as_py()) for b in group.column("counts"))
        return pa.table({"chunk": [group.column("chunk")[0].as_py()], "part": [group.column("part")[0].as_py() // FAN], "counts": [_packed_counts(total)]}, SKETCH)

    now = written(docs.select("text").mapInArrow(count, "chunk int, part int, counts binary"), "sketch")
    while (now.agg(F.max("part")).first()[0] or 0) > 0:
        last, now = now, written(now.groupBy("chunk", F.floor(F.col("part") / FAN).alias("next")).applyInArrow(add, now.schema), "sketch")
        drop(last)
    out = np.zeros(1 << bits, np.uint64)
    for r in now.groupBy("chunk").applyInArrow(add, now.schema).select("chunk", "counts").toLocalIterator():  # a fixed number of rows
        part = _counts(r.counts)
        out[r.chunk * CHUNK : r.chunk * CHUNK + len(part)] = part
    drop(now)
    return np.minimum(out, 0xFFFFFFFF).astype(np.uint32)


# Classes and their prefixes


def _sorted_sets(texts: list[str], size: int, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text in the common order (without counts: by hash), with their counts; and where each text's end."""
    h, row, n_words = shingles(texts, size)
    count = counts[(h >> np.uint64(64 - int(len(counts)).bit_length() + 1)).astype(np.int64)] if counts is not None else np.zeros(len(h), np.uint32)
    order = np.lexsort((h, count, row))
    h, row, count = h[order], row[order], count[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])]) if len(h) else np.zeros(0, bool)
    return h[new].view(np.int64), count[new], np.searchsorted(row[new], np.arange(len(texts) + 1))


def prefix_lengths(count: np.ndarray, bounds: np.ndarray, load: float, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """How many shared shingles each set asks for, and the length of its prefix: of the estimated costs of 1 to MOST the least.

    A prefix of l makes a row of the join for each other holder of its shingles; at most one pair for each l of these rows is verified.
    """
    n = np.diff(bounds)
    first = n - -(-n * threshold // 100) + 1
    others = np.concatenate([[0.0], np.cumsum(np.maximum(count.astype(np.float64) - load - 1, 0.0))])
    asked = np.arange(1, MOST + 1)[:, None]
    length = np.minimum(first[None, :] + asked - 1, n[None, :])
    rows = others[bounds[:-1][None, :] + length] - others[bounds[:-1]][None, :]
    cost = np.where(asked <= np.maximum(1, n - first + 1)[None, :], rows * (1 + VERIFY * n[None, :] / asked), np.inf)
    best = np.argmin(cost, axis=0)
    return best + 1, np.where(n > 0, length[best, np.arange(len(n))], 0)


def sets_of(docs: DataFrame, counts: np.ndarray, size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, class (a digest of the set; null: no shingles), n (its size), asked and prefix of every document, written once."""
    shared, load = docs.sparkSession.sparkContext.broadcast(counts), float(counts.mean(dtype=np.float64))

    def compute(texts: list[str]) -> dict:
        h, count, bounds = _sorted_sets(texts, size, shared.value)
        asked, length = prefix_lengths(count, bounds, load, threshold)
        begins, ends = bounds[:-1].tolist(), bounds[1:].tolist()
        digest = [hashlib.blake2b(np.sort(h[a:b]).tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(begins, ends)]
        return {"class": digest, "n": np.diff(bounds), "asked": asked, "prefix": [h[a : a + k] for a, k in zip(begins, length.tolist())]}

    longs = T.ArrayType(T.LongType())
    added = T.StructType([T.StructField("class", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("asked", T.LongType()), T.StructField("prefix", longs)])
    return written(map_texts(packed(docs), compute, added, ("doc_id",)), "prefixes")


def _bits(wanted: DataFrame) -> tuple[int, np.ndarray]:
    """A bit filter of the hashes in the column h: 64 to 128 bits for each, but 2**16 to 2**29, so what is collected and broadcast stays within 64 MiB."""
    bits = int(np.clip(np.ceil(np.log2(max(1, wanted.count()))) + 6, 16, 29))
    bit = F.shiftrightunsigned("h", 64 - bits)
    rows = wanted.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - bits}) & 63 as int))")).alias("mask")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("mask").to_numpy().astype(np.int64).view(np.uint64)
    return bits, out


def _whole_sets(docs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """class and shingles of the given classes (class, doc_id of one member), from the texts of the documents with these ids; a class may come more than once.

    A bit filter tells in the scan which documents may be meant, so no text is shuffled; what it lets through in error meets no pair.
    """
    bits, words = _bits(classes.select(F.xxhash64("doc_id").alias("h")))
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)
            asked = np.flatnonzero(shared.value[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1))
            text = batch.column(1).take(pa.array(asked))
            for at, end in slices(text, SLICE_ROWS, SLICE_BYTES):
                h, _, bounds = _sorted_sets([t or "" for t in text.slice(at, end - at).to_pylist()], size, None)
                each = [x for x in (np.sort(h[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())) if len(x)]
                digest = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in each]
                yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(each, pa.list_(pa.int64()))], names=["class", "shingles"])

    return written(packed(docs).select(F.xxhash64("doc_id").alias("h"), "text").mapInArrow(run, "class binary, shingles array<long>"), "sets")


class Join:
    """Classes, postings and verified links of documents; tables stay until the innermost scratch() ends."""

    def __init__(self, docs: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD, bits: int = BITS, all_links: bool = False):
        self.threshold, self.docs, self.size = threshold, docs, size
        each = sets_of(docs, sketch(docs, size, bits), size, threshold)
        self.documents = written(each.select("doc_id", "class", "n"), "members")
        rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
        grouped = each.where(F.col("class").isNotNull()).groupBy("class").agg(F.min(rank).alias("least"), F.first(F.struct("n", "asked", "prefix")).alias("set"))
        classes = written(grouped.select("class", F.col("least.doc_id").alias("doc_id"), "set.*").withColumn("id", F.monotonically_increasing_id()), "classes")
        self.classes = written(classes.drop("prefix"), "classes")
        drop(each)
        tokens = classes.select("id", F.posexplode("prefix").alias("pos", "token"))
        shared = tokens.groupBy("token").agg(F.count("*").alias("holders")).where("holders > 1")
        found = tokens.join(shared, "token").join(self.classes.select("id", "n", "asked"), "id")
        self.postings = written(found, "postings")
        drop(classes)
        if all_links:
            self.links = written(self._linked(self.postings.withColumn("root", F.col("id"))), "links")
            return
        led = written(self._led(), "links")
        roots = components(led)
        placed = self.postings.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        mixed = placed.groupBy("token").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r != s").select("token")
        self.links = written(led.unionByName(self._linked(placed.join(mixed, "token"))), "links")

    def _early(self, n, pos, asked, other_n, other_pos, other_asked) -> F.Column:
        """Whether a shingle at these positions may be one of the first that two sets share so that the rest still reaches the overlap they need."""
        enough = needed(n, other_n, self.threshold)
        return (enough <= F.least(n, other_n)) & (F.least(n - pos, other_n - other_pos) >= enough - F.least(asked, other_asked) + 1)

    def _led(self) -> DataFrame:
        """Links between classes and their leaders: for each shingle of more than CROWD classes the one that has it earliest, and of these the one of most shingles."""
        first = F.min(F.struct((F.col("pos") / F.col("n")).alias("share"), "id", "n", "pos", "asked")).alias("y")
        leaders = self.postings.where(F.col("holders") > CROWD).groupBy("token").agg(first)
        early = self._early(*(F.col(c) for c in ("n", "pos", "asked", "y.n", "y.pos", "y.asked")))
        met = self.postings.where(F.col("holders") > CROWD).join(leaders, "token").where((F.col("id") != F.col("y.id")) & early)
        best = met.groupBy("id", F.col("y.id").alias("leader")).agg(F.count("*").alias("times")).groupBy("id").agg(F.max(F.struct("times", "leader")).alias("m"))
        return self._verified(best.select(F.col("id").alias("a"), F.col("m.leader").alias("b")))

    def _linked(self, postings: DataFrame) -> DataFrame:
        """Links between classes of different roots, by the shingles that their prefixes share."""
        band = F.floor(F.log("n") / float(np.log(100 / self.threshold)) + 1e-9)
        index = postings.select("token", band.alias("band"), F.struct("n", "id", "pos", "asked", "root").alias("y"))
        probe = postings.select("token", F.explode(F.array(band - 1, band, band + 1)).alias("band"), F.struct("n", "id", "pos", "asked", "root").alias("x"))
        x, y, asked = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}")), F.least("x.asked", "y.asked")
        ordered = (x("n") < y("n")) | ((x("n") == y("n")) & (x("id") < y("id")))
        early = self._early(x("n"), x("pos"), x("asked"), y("n"), y("pos"), y("asked"))
        met = probe.join(index, ["token", "band"]).where(ordered & (x("root") != y("root")) & early)
        pairs = met.groupBy(x("id").alias("a"), y("id").alias("b")).agg(F.count("*").alias("times"), F.min(asked).alias("asked")).where("times >= asked").select("a", "b")
        return self._verified(pairs)

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of class ids that reach the threshold, by their whole sets."""
        of = self.classes.select("id", "class", "doc_id")
        named = pairs.join(of.select(F.col("id").alias("a"), F.col("class").alias("one")), "a").join(of.select(F.col("id").alias("b"), F.col("class").alias("two")), "b")
        named = written(named, "pairs")
        asked = named.select(F.col("a").alias("id")).union(named.select("b")).distinct()
        sets = _whole_sets(self.docs, of.join(asked, "id"), self.size)
        shared = F.size(F.array_intersect("s", "t"))
        met = named.join(sets.select(F.col("class").alias("one"), F.col("shingles").alias("s")), "one").join(sets.select(F.col("class").alias("two"), F.col("shingles").alias("t")), "two")
        found = written(met.where(100 * shared >= self.threshold * (F.size("s") + F.size("t") - shared)).select("a", "b").distinct(), "verified")
        drop(named, sets)
        return found

    def components(self) -> DataFrame:
        """doc_id, n_shingles and component_id (the least doc_id that can be reached over links) of every document."""
        named = self.classes.select("class", "doc_id", "id").join(components(self.links).withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        by_class = named.select("class", "root").join(least, "root").select("class", "component_id")
        found = self.documents.select("doc_id", F.col("n").alias("n_shingles"), "class").join(by_class, "class", "left")
        return found.select("doc_id", "n_shingles", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD, bits: int = BITS) -> DataFrame:
    """doc_id, n_shingles and component_id of every document; threshold in hundredths."""
    return Join(docs, size, threshold, bits).components()


def pairs(docs: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """All links (a, b) between classes of different sets, each named by a member's doc_id (copies aren't expanded), and the membership (doc_id, class_doc_id)."""
    join = Join(docs, size, threshold, bits, all_links=True)
    name = join.classes.select("id", "doc_id")
    linked = join.links.join(name.select(F.col("id").alias("a"), F.col("doc_id").alias("x")), "a").join(name.select(F.col("id").alias("b"), F.col("doc_id").alias("y")), "b")
    members = join.documents.join(join.classes.select("class", F.col("doc_id").alias("class_doc_id")), "class").select("doc_id", "class_doc_id")
    return linked.select(F.col("x").alias("a"), F.col("y").alias("b")), members
