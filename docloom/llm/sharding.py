"""Sharding by a two-pass external shuffle, in DataFrame expressions alone.

Pass 1 scatters records by seeded hashes: rendezvous hashing of doc_id over the shards (the shard of the highest hash wins, so one more
shard takes rows only into itself), then a second hash over doc_id and text into buckets that fit in memory, one bucket for each partition. Pass 2
shuffles each bucket by Fisher-Yates (Spark's shuffle() of the bucket's sorted array) and writes it, in order, with each record's place. A record's
slot is the number of records in earlier buckets of its shard plus its place in its own; a table with a row for each bucket beside the shards has those
numbers.

How many buckets there are follows from the bytes of all texts, so a bucket holds about `bucket_bytes` at every size of input. Rows equal in id and
text share a hash; where such a group has over HOT times bucket_bytes, its rows are dealt over all buckets of their shard by their place in
the scan. Equal rows are interchangeable, so how many go where is all that this decides.

The seed and the input decide everything else: buckets are sorted before they are shuffled and stand in a fixed order.

Nulls and edge cases: a null text has size 1 and the CRC of nothing; a null doc_id is hashed as such, so all rows without an id share a
shard, but not a bucket; repeated rows each get a slot of their own; an empty table gives no rows; equal texts under
other ids may go to other shards; input columns stay in the struct `row`. One text longer than bucket_bytes makes its bucket that much larger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, packed

SEED = 20_240_607
BUCKET_BYTES = 32 << 20
#: Buckets' worth of equal rows from which on they are split.
HOT = 4
#: Rows of the table of buckets up to which it is broadcast; beyond, Spark chooses the join.
BROADCAST_BUCKETS = 500_000


def rendezvous(key: Column, n_shards: int, seed: int = SEED) -> Column:
    """The shard of a key among n_shards: that of the highest hash of seed, shard and key."""
    ranked = [F.struct(F.xxhash64(F.lit(seed), F.lit(i), key).alias("h"), F.lit(i).alias("i")) for i in range(n_shards)]
    return F.greatest(*ranked)["i"] if n_shards > 1 else F.lit(0)


def _plan(base: DataFrame, n_shards: int, bucket_bytes: int) -> tuple[int, list]:
    """Buckets of each shard, and the groups of equal rows to split: fewer than there are buckets, as each has over HOT buckets' bytes."""
    groups = base.groupBy("doc_id", F.xxhash64("text").alias("h")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    hot = F.when((F.col("bytes") > HOT * bucket_bytes) & (F.col("n") > 1), F.struct("doc_id", "h"))
    total, split = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.collect_list(hot)).first()
    return max(1, -(-total // (n_shards * bucket_bytes))), split


def scatter(docs: DataFrame, n_shards: int = 8, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, int]:
    """row, doc_id, size, shard, bucket and grown_shard of every row of docs, and the number of buckets of all shards. One pass over sizes sets it."""
    base = packed(docs).withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1)
    each, split = _plan(base, n_shards, bucket_bytes)
    shard = rendezvous(F.col("doc_id"), n_shards, seed)
    salt = F.lit(0).cast("long")
    if split:
        known = base.sparkSession.createDataFrame([tuple(r) for r in split], "hot_id long, hot_h long").withColumn("hot", F.lit(True))
        base = base.withColumn("h", F.xxhash64("text")).join(F.broadcast(known), F.col("doc_id").eqNullSafe(F.col("hot_id")) & (F.col("h") == F.col("hot_h")), "left")
        salt = F.when(F.col("hot"), F.monotonically_increasing_id()).otherwise(salt)
    within = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "text", salt), F.lit(each)).cast("int")
    return base.select("row", "doc_id", F.xxhash64("text").alias("tie"), "size", shard.alias("shard"), (shard * each + within).alias("bucket"), rendezvous(F.col("doc_id"), n_shards + 1, seed).alias("grown_shard")), n_shards * each


def shuffle_buckets(docs: DataFrame, n_shards: int = 8, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """row, doc_id, size, grown_shard, shard, bucket and place (in the bucket) of every row of docs, in the order in which they are to be written.

    Each bucket is a partition of its own and is gathered there; nothing larger comes together in a task.
    """
    scattered, n_buckets = scatter(docs, n_shards, seed, bucket_bytes)
    record = F.struct("doc_id", "tie", "size", "grown_shard", "row")
    return (
        scattered.repartitionById(n_buckets, F.col("bucket")).groupBy("shard", "bucket")
        .agg(F.collect_list(record).alias("records"))
        .select("shard", "bucket", F.posexplode(F.shuffle(F.array_sort("records", _by_id), seed)).alias("place", "r"))
        .select("r.row", "r.doc_id", "r.size", "r.grown_shard", "shard", "bucket", "place")
        .sortWithinPartitions("shard", "bucket", "place")
    )


def _by_id(a: Column, b: Column) -> Column:
    """Order by doc_id (null first), then by a hash of the text."""
    key = lambda x: F.struct(x["doc_id"], x["tie"])
    return F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)


def write_shards(docs: DataFrame, path: str, n_shards: int = 8, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Write the shuffled records as Parquet under path/records/shard=k, a file for each bucket, and path/buckets with the records before each."""
    shuffled = shuffle_buckets(docs, n_shards, seed, bucket_bytes)
    shuffled.write.partitionBy("shard").option("compression", "zstd").parquet(f"{path}/records")
    counts = docs.sparkSession.read.schema(shuffled.schema).parquet(f"{path}/records").groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    counts.select("bucket", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")).coalesce(1).write.parquet(f"{path}/buckets")


def read_shards(spark: SparkSession, path: str, schema) -> DataFrame:
    """row, doc_id, size, grown_shard, shard, bucket and slot of every record; schema is that of the documents that were written."""
    fields = f"row {schema.simpleString()}, doc_id long, size long, grown_shard int, bucket int, place int, shard int"
    records = spark.read.schema(fields).parquet(f"{path}/records")
    buckets = spark.read.schema("bucket int, n long, before long").parquet(f"{path}/buckets").select("bucket", "before")
    if buckets.count() <= BROADCAST_BUCKETS:
        buckets = F.broadcast(buckets)
    return records.join(buckets, "bucket").select("row", "doc_id", "size", "grown_shard", "shard", "bucket", (F.col("before") + F.col("place")).alias("slot"))


def shards_of(docs: DataFrame, n_shards: int = 8, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write docs in shards to a new folder in shared storage and read them back."""
    spark, path = docs.sparkSession, new_path(docs.sparkSession, "shards")
    write_shards(docs, path, n_shards, seed, bucket_bytes)
    return read_shards(spark, path, docs.schema)
