"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within radius r share a variant within r/2 of both. So every distinct fingerprint emits all its variants within half
the radius (65 of 64 bits at radius 2), equal variants meet in a shuffle, and members of a meeting are linked to its least member after
the distance is verified. A meeting holds at most 65 distinct fingerprints, whatever the number of documents, because
equal fingerprints were merged before; links between all pairs of a meeting aren't made, as a star connects the same nodes.

Nulls and edge cases: a null or empty text has fingerprint zero and links like any other; documents with a null doc_id take part, but a
component takes its id from the ids there are (none: null); repeated rows are rows like any other; an empty table gives an
empty result; a document of fewer words than a shingle is one shingle of all its words.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, packed, written
from .components import components

SHINGLE = 3
SEED = 42


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash as a signed integer: a bit is 1 if set in over half of the hashes of all word shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # ASCII letters and ASCII white space only, as for bytes
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return int(np.uint64(xxhash.xxh64_intdigest(line, seed)).astype(np.int64))
    starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])
    n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        end = min(n, at + (1 << 16))
        places = zip(starts[at:end].tolist(), (starts[at + shingle : end + shingle] - 1).tolist())
        part = np.fromiter((digest(line[a:b], seed) for a, b in places), np.uint64, end - at).astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view("<u8")[0].astype(np.int64))


def fingerprints(docs: DataFrame, keep_rows: bool = False, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, uid and fp (and row, if asked for) of every document, written once: later steps need no text and no Python."""
    added = T.StructType([T.StructField("fp", T.LongType())])
    found = map_texts(packed(docs), lambda texts: {"fp": [fingerprint(t, shingle) for t in texts]}, added, ("row", "doc_id") if keep_rows else ("doc_id",))
    return written(found.withColumn("uid", F.monotonically_increasing_id()), "fingerprints")


def variants(fp: F.Column, radius: int) -> F.Column:
    """All 64-bit words at most `radius` bits from fp, as an array."""
    masks = {0}
    for _ in range(radius):
        masks |= {x ^ (1 << i) for x in masks for i in range(64)}
    signed = [x - (1 << 64) if x >> 63 else x for x in sorted(masks)]
    return F.transform(F.array(*[F.lit(x).cast("long") for x in signed]), lambda mask: fp.bitwiseXOR(mask))


def links(distinct_fp: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (a, b) between distinct fingerprints at most `radius` bits apart that connect what all such pairs connect."""
    if radius % 2:
        raise ValueError("the radius must be even: each side takes half of it")
    met = distinct_fp.select("fp", F.explode(variants(F.col("fp"), radius // 2)).alias("variant"))
    edges = met.withColumn("root", F.min("fp").over(Window.partitionBy("variant"))).where(F.col("fp") != F.col("root"))
    return edges.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("root"))) <= radius).select(F.col("fp").alias("a"), F.col("root").alias("b")).distinct()


def near_duplicates(prints: DataFrame, radius: int = 2) -> DataFrame:
    """The rows of fingerprints() with component_id, the least doc_id that can be reached over links, and representative (one row of each component).

    Components are found among distinct fingerprints, so a large group of copies is one node; its rows get their component by a join that
    Spark can split.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")
    each = written(prints.groupBy("fp").agg(F.min(rank).alias("least")), "distinct")
    roots = components(links(each.select("fp"), radius))
    named = each.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = named.groupBy("root").agg(F.min("least").alias("first"))
    by_fp = named.select("fp", "root").join(first, "root").select("fp", F.col("first.doc_id").alias("component_id"), F.col("first.uid").alias("first_uid"))
    return prints.join(by_fp, "fp").withColumn("representative", F.col("uid") == F.col("first_uid")).drop("first_uid")


def hex_fingerprint(fp: F.Column) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
