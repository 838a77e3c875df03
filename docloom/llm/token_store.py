"""Token ids in a content-addressed store.

Texts are encoded by the tokenizers library; a rolling hash over the last WINDOW ids cuts each document's stream into chunks where its low bits are
zero, so equal passages give equal chunks wherever they stand. The store, a folder in shared storage, has three tables:

* chunks(hash, n, data): each distinct chunk once, in buckets by hash; data is Zstandard over little-endian ids of 2 bytes (4 if the vocabulary needs
  them), with the store's dictionary;
* recipes(ix, doc_id, start, n_tokens, hashes, root): documents in ascending doc_id order (null first; ties by content), each with the hashes
  of its chunks, their Merkle root, and the number of ids before it; ix grows with that order;
* manifest(block, n_docs, n_tokens, root): the Merkle root over the recipes of each block of BLOCK documents;
* layout(width, buckets, dictionary): how ids and chunks are laid out, one row.

Reading puts every distinct document together from its chunks, and verifies every chunk against its hash, every document against its root and count and
every block against the manifest; it fails if anything is wrong. Equal documents have one root, and are put together once.

Nulls and edge cases: a null text is read as empty, so its stream is the end id alone; null ids come first; repeated rows are documents
of their own that share chunks; an empty table makes an empty store.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from array import array
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, env_single_thread, map_texts, new_path, packed

WINDOW = 4
#: A cut has 1 in MEAN places on average, but a chunk has LEAST ids at least and MOST at most.
MEAN, LEAST, MOST = 512, 128, 4096
#: Documents of a block of the manifest; a range of the recipes is cut into such blocks.
BLOCK = 4096
#: Words whose ids a worker remembers in each of two generations, and the length up to which a word outlives its first one.
REMEMBER, SHORT = 120_000, 64

#: Documents encoded together.
SLICE = 512
#: The compression dictionary has so many bytes, and comes from the chunks of so many documents, those of least hash of the id; chunks don't depend on it.
DICTIONARY, DICTIONARY_DOCS, DICTIONARY_BYTES = 112_640, 500, 65_536
LEVEL = 3
#: Bytes of ids in a bucket; buckets that Spark lets a table have, beyond which they grow; references to one chunk from which on Spark may split its join by skew.
BUCKET_BYTES, MOST_BUCKETS, HOT = 16 << 20, 100_000, 1_000_000

_LOADED: dict[str, WordEncoder] = {}
_ODD = re.compile("[\x1c-\x1f]")
#: Below U+0100 the library and Python agree on lower case, and nothing is decomposed.
_WIDE = re.compile("[^\0-\xff]")
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def _lowered(text: str) -> str:
    """In lower case where that changes no id: not where a special token may stand, which is matched as it is."""
    return text.lower() if "<|" not in text and (text.isascii() or not _WIDE.search(text)) else text


class WordEncoder:
    """Encodes texts by the library, and each distinct word once.

    No pattern of the tokenizer matches over white space, so the ids of a text are those of its words, one after the other. A word of Latin
    letters with ASCII marks after it is a match of letters and one of marks, so those are encoded apart. Letters without
    marks are one match, and the last token of a match has the tokenizer's word end; that is how the ids of many words encoded
    in one call are told apart. Such letters are in lower case and composed already, so the library gets them without its normalizer, cut at
    blanks alone. Any other word is encoded as it is.
    """

    def __init__(self, path: str):
        env_single_thread()
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for t in (self.tokenizer, self.plain):
            t.no_truncation()
            t.no_padding()
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _unknown(self, wanted: set[str]) -> list[str]:
        """What of wanted the young memory lacks after taking over from the old one."""
        young, old, missing = self.young, self.old, []
        for w in wanted.difference(young):
            if (ids := old.get(w)) is not None:
                young[w] = ids
            else:
                missing.append(w)
        return missing

    def _learn(self, wanted: set[str]) -> None:
        known = self.young
        letters, other, split = set(), set(), []
        for w in self._unknown(wanted):
            if w.isascii() and w.isalpha() and w.islower():
                letters.add(w)
            elif m := _SIMPLE.fullmatch(w):
                core, tail = m[1].lower(), m[2]
                split.append((w, core, tail))
            else:
                other.add(w)
        letters.update(self._unknown({core for _, core, _ in split}))
        other.update(self._unknown({tail for _, _, tail in split if tail}))
        if letters:
            new = list(letters)
            ids = np.asarray(self.plain.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * (np.flatnonzero(self.is_end[ids]) + 1)).tolist()
            if len(ends) != len(new):
                raise ValueError("the tokenizer has no word ends, or cuts letters")
            data, begin = ids.tobytes(), 0
            for w, end in zip(new, ends):
                known[w] = data[begin:end]
                begin = end
        for e, w in zip(self.tokenizer.encode_batch_fast(rest := list(other), add_special_tokens=False), rest):
            known[w] = array("I", e.ids).tobytes()
        for w, core, tail in split:
            known[w] = known[core] + known[tail] if tail else known[core]

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text begins and the last ends.

        Arrow cuts the words and numbers the distinct ones, so a Python object is made for each distinct word only.
        """
        # Of the characters that Python and Arrow take for white space the library takes all but these four: such a text is read as one word.
        odd = {i: t for i, t in enumerate(texts) if _ODD.search(t)}
        rows = pc.utf8_split_whitespace(pa.array(["" if i in odd else _lowered(t) for i, t in enumerate(texts)], pa.large_string()))
        coded = rows.values.dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._learn({*words, *odd.values()})
        ids_of = self.young.__getitem__
        known = [*map(ids_of, words), *map(ids_of, odd.values())]
        flat = np.frombuffer(b"".join(known), "<u4")
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        first = np.cumsum(size) - size
        word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        begins = rows.offsets.to_numpy().astype(np.int64)
        if odd:
            at = np.fromiter(odd, np.int64, len(odd))  # rows that hold one empty word so far
            word[begins[at]] = len(words) + np.arange(len(odd))
        long = [w for w in words if len(w) > SHORT]
        for w in {*long, *odd.values()}:
            self.young.pop(w, None)
        if len(self.young) > REMEMBER:
            self.young, self.old = {}, self.young
        n = size[word]
        ends = np.cumsum(n)
        ids = flat[np.repeat(first[word] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.append(0, ends)[begins]


def encoder(path: str) -> WordEncoder:
    if path not in _LOADED:
        _LOADED[path] = WordEncoder(path)
    return _LOADED[path]


def _mix() -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (np.arange(1 << 16, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(30)
        return (x * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32)


#: A random number for each id's low 16 bits.
_MIX = _mix()


def places(ids: np.ndarray) -> np.ndarray:
    """Where the rolling hash allows a cut: after 1 id in MEAN, decided by the last WINDOW ids alone."""
    mixed = _MIX[ids & np.uint32(0xFFFF)]
    if len(ids) and ids.max() >> 16:
        mixed ^= ids >> np.uint32(16)
    h = mixed.copy()
    for k in range(1, WINDOW):
        h[k:] += mixed[:-k] << np.uint32(5 * k)
    return np.flatnonzero(h >> np.uint32(23) == 0) + 1


def cuts(allowed: list[int], n: int) -> list[int]:
    """Ends of the chunks of a stream of n ids, from the places that allow a cut; the last is n.

    No place before LEAST matters, so what stood before the stream when places were sought (fewer than WINDOW ids back) doesn't either.
    """
    ends, begin = [], 0
    for p in [*allowed, n]:
        while p - begin > MOST:
            begin += MOST
            ends.append(begin)
        if p - begin >= LEAST or p == n:
            if p > begin:
                ends.append(p)
            begin = p
    return ends


def merkle(hashes: list[bytes]) -> bytes:
    """Root of a binary hash tree; a node without a partner moves up as it is. No leaves: the hash of nothing."""
    if not hashes:
        return hashlib.sha256(b"").digest()
    level = [hashlib.sha256(b"\0" + h).digest() for h in hashes]
    while len(level) > 1:
        pairs = [hashlib.sha256(b"\1" + a + b).digest() for a, b in zip(level[::2], level[1::2])]
        level = pairs + level[len(level) - len(level) % 2 :]
    return level[0]


LOOSE = T.StructType([
    T.StructField("n_tokens", T.LongType()), T.StructField("hashes", T.ArrayType(T.BinaryType())), T.StructField("root", T.BinaryType()),
    T.StructField("chunks", T.ArrayType(T.StructType([T.StructField("hash", T.BinaryType()), T.StructField("n", T.IntegerType()), T.StructField("data", T.BinaryType())]))),
])


def _streams(texts: list[str], path: str, end_id: int, width: int):
    """Of each text: its number of ids and its chunks, as bytes."""
    ids, bounds = encoder(path).encode_all(texts)
    ids = np.insert(ids, bounds[1:], np.uint32(end_id))
    bounds = bounds + np.arange(len(bounds))
    allowed = places(ids)
    data = ids.astype(f"<u{width}").tobytes()
    at = np.searchsorted(allowed, bounds, side="right")
    for d, (left, right) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
        ends = cuts((allowed[at[d] : at[d + 1]] - left).tolist(), right - left)
        yield right - left, [data[width * (left + a) : width * (left + b)] for a, b in zip([0, *ends], ends)]


def _dictionary(docs: DataFrame, path: str, end_id: int, width: int) -> bytes:
    """A compression dictionary from the chunks of a bounded sample of documents; none where those are too few to make one."""
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = [r.doc_id for r in each.select("doc_id").where("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(DICTIONARY_DOCS).collect()]  # ids alone travel
    texts = [r.text for r in each.where(F.col("doc_id").isin(ids) & (F.octet_length("text") <= DICTIONARY_BYTES)).limit(DICTIONARY_DOCS).collect()] if ids else []
    found = {c for _, chunks in _streams(texts, path, end_id, width) for c in chunks} if texts else set()
    try:
        return zstandard.train_dictionary(DICTIONARY, sorted(found)).as_bytes() if len(found) >= 100 else b""
    except zstandard.ZstdError:
        return b""


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def _decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def _loose(docs: DataFrame, path: str, end_id: int, width: int, dictionary: bytes) -> DataFrame:
    """Each document's count, chunk hashes and root, and those chunks that it is the first of its slice to have."""

    shared = docs.sparkSession.sparkContext.broadcast(dictionary)  # DICTIONARY bytes

    def compute(texts: list[str]) -> dict:
        press = _compressor(shared.value)
        out: dict[str, list] = {f: [] for f in LOOSE.names}
        seen: set[bytes] = set()
        for n, parts in _streams(texts, path, end_id, width):
            hashes, chunks = [hashlib.sha256(p).digest() for p in parts], []
            for h, p in zip(hashes, parts):
                if h not in seen:
                    seen.add(h)
                    chunks.append({"hash": h, "n": len(p) // width, "data": press.compress(p)})
            for f, v in zip(LOOSE.names, (n, hashes, merkle(hashes), chunks)):
                out[f].append(v)
        return out

    return map_texts(packed(docs), compute, LOOSE, ("doc_id",), SLICE)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, vocabulary: int = 1 << 16) -> None:
    """Encode docs and write the store to the new folder `path`.

    Texts are read and encoded once, into loose chunks beside narrow recipes; the chunks are then merged by hash, and the loose ones are
    deleted. Recipes are dealt by ranges of doc_id, and starts come from sums over the ranges: no single task sees all documents.
    """
    spark = docs.sparkSession
    width = 2 if vocabulary <= 1 << 16 else 4
    tmp = new_path(spark, "loose")
    dictionary = _dictionary(docs, tokenizer, end_id, width)
    loose = _loose(docs, tokenizer, end_id, width, dictionary)
    loose.write.option("compression", "zstd").parquet(tmp)
    loose = spark.read.schema(loose.schema).parquet(tmp)
    chunk = loose.select(F.explode("chunks").alias("c")).select("c.hash", "c.n", "c.data")
    total = width * (loose.agg(F.sum("n_tokens")).first()[0] or 0)
    buckets = min(MOST_BUCKETS, max(spark.sparkContext.defaultParallelism, -(-total // BUCKET_BYTES)))
    merged = chunk.repartition(buckets, "hash").groupBy("hash").agg(F.first("n").alias("n"), F.first("data").alias("data"))
    with _named(spark) as name:
        merged.write.format("parquet").bucketBy(buckets, "hash").option("path", f"{path}/chunks").option("compression", "none").saveAsTable(name)
    spark.createDataFrame([(width, buckets, bytearray(dictionary))], LAYOUT).coalesce(1).write.parquet(f"{path}/layout")
    recipes = loose.select("doc_id", "n_tokens", "hashes", "root").repartitionByRange("doc_id", "root", F.xxhash64("hashes")).sortWithinPartitions("doc_id", "root")
    recipes = recipes.withColumn("part", F.spark_partition_id()).withColumn("ix", F.monotonically_increasing_id())
    placed = new_path(spark, "placed")
    recipes.write.option("compression", "zstd").parquet(placed)
    discard(spark, tmp)
    recipes = spark.read.schema(recipes.schema).parquet(placed)
    sums = recipes.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each range
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("part", F.coalesce(F.sum("n").over(earlier.orderBy("part")), F.lit(0)).alias("base"))
    within = F.coalesce(F.sum("n_tokens").over(earlier.partitionBy("part").orderBy("ix")), F.lit(0))
    final = recipes.withColumn("within", within).join(before, "part").withColumn("start", F.col("base") + F.col("within"))
    final.select("ix", "doc_id", "start", "n_tokens", "hashes", "root").write.option("compression", "zstd").parquet(f"{path}/recipes")
    discard(spark, placed)
    _blocks(spark.read.parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")


LAYOUT = "width int, buckets int, dictionary binary"


@contextmanager
def _named(spark: SparkSession):
    """A name for a table of the session's catalog, that is gone afterwards; its files stay."""
    name = f"docloom_{uuid.uuid4().hex}"
    try:
        yield name
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _chunks(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    """The chunks as a table whose buckets Spark knows, so that a join by hash moves no chunk."""
    with _named(spark) as name:
        spark.sql(f"CREATE TABLE {name} (hash BINARY, n INT, data BINARY) USING parquet CLUSTERED BY (hash) INTO {buckets} BUCKETS LOCATION '{path}/chunks'")
        return spark.table(name)


def _block(ix: F.Column) -> F.Column:
    return F.shiftrightunsigned(ix, BLOCK.bit_length() - 1)


def _blocks(recipes: DataFrame) -> DataFrame:
    """block, n_docs, n_tokens and the Merkle root of each block; a block has BLOCK documents at most."""
    grouped = recipes.groupBy(_block(F.col("ix")).alias("block")).agg(
        F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("ix", "root"))).alias("docs")
    )

    def roots(batches):
        for b in batches:
            docs = b.column(3).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([merkle([d["root"] for d in x]) for x in docs], pa.binary())], names=["block", "n_docs", "n_tokens", "root"])

    return grouped.mapInArrow(roots, "block long, n_docs long, n_tokens long, root binary")


def _check_manifest(spark: SparkSession, path: str) -> None:
    now, then = _blocks(spark.read.parquet(f"{path}/recipes")), spark.read.parquet(f"{path}/manifest")
    wrong = now.exceptAll(then).unionAll(then.exceptAll(now)).limit(1).collect()
    if wrong:
        raise ValueError(f"recipes and manifest disagree, first at block {wrong[0].block}")


def _put_together(spark: SparkSession, path: str) -> DataFrame:
    """root, n_tokens and ids (little-endian, 4 bytes each) of every distinct document, from its chunks in order, verified.

    References go to the chunks' buckets and come back with the data, sorted by document and place; a task puts one document together at a time.
    Where a chunk has over HOT references the chunks are dealt anew instead, so that Spark can split such a group.
    """
    layout = spark.read.schema(LAYOUT).parquet(f"{path}/layout").first()
    width, dictionary = layout.width, spark.sparkContext.broadcast(bytes(layout.dictionary))  # DICTIONARY bytes
    distinct = spark.read.parquet(f"{path}/recipes").groupBy("root", "n_tokens").agg(F.min("ix").alias("ix"), F.first("hashes").alias("hashes"))
    refs = distinct.select("ix", "root", "n_tokens", F.posexplode("hashes").alias("pos", "hash"))
    hottest = refs.groupBy("hash").count().agg(F.max("count")).first()[0] or 0
    chunks = _chunks(spark, path, layout.buckets) if hottest <= HOT else spark.read.parquet(f"{path}/chunks")
    found = refs.join(chunks.hint("merge"), "hash", "left").select("ix", "pos", "root", "n_tokens", "hash", "n", "data")
    names = ["root", "n_tokens", "ids"]

    def join(batches):
        press, now, root, n_tokens, hashes, parts = _decompressor(dictionary.value), None, b"", 0, [], []

        def done():
            ids = b"".join(parts)
            if len(ids) != 4 * n_tokens or merkle(hashes) != root:
                raise ValueError(f"document {root.hex()} can't be put together from the store")
            return root, n_tokens, ids

        for b in batches:
            rows = []
            for ix, _, r, total, h, n, data in zip(*(c.to_pylist() for c in b.columns)):
                if ix != now:
                    if now is not None:
                        rows.append(done())
                    now, root, n_tokens, hashes, parts = ix, r, total, [], []
                if data is None:
                    raise ValueError(f"document {r.hex()} can't be put together from the store")
                part = press.decompress(data, max_output_size=n * width)
                if hashlib.sha256(part).digest() != h or len(part) != n * width:
                    raise ValueError(f"chunk {h.hex()} does not match its hash")
                hashes.append(h)
                parts.append(part if width == 4 else np.frombuffer(part, "<u2").astype("<u4").tobytes())
            yield _rows(rows)
        if now is not None:
            yield _rows([done()])

    def _rows(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 3, (pa.binary(), pa.int64(), pa.binary()))], names=names)

    return found.repartition("ix").sortWithinPartitions("ix", "pos").mapInArrow(join, "root binary, n_tokens long, ids binary")


def _of_documents(spark: SparkSession, path: str, made: DataFrame, column: str) -> DataFrame:
    """doc_id, start, n_tokens and a column of what was put together, for every document."""
    recipes = spark.read.parquet(f"{path}/recipes").select("doc_id", "start", "n_tokens", "root")
    return recipes.join(made.select("root", "n_tokens", column), ["root", "n_tokens"], "left").select("doc_id", "start", "n_tokens", column)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian, 4 bytes each) of every document, put together from its chunks and verified."""
    _check_manifest(spark, path)
    return _of_documents(spark, path, _put_together(spark, path), "ids")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document: as read(), but only CRCs of the streams go on to equal documents."""
    _check_manifest(spark, path)
    made = _put_together(spark, path).select("root", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return _of_documents(spark, path, made, "ids_crc32")
