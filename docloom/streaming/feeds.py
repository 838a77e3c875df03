"""Streaming forms of the feed operators.

Nulls and edge cases: a null key is a key of its own; a null time is late for a watermark, and is rejected by the limiter; an empty stream gives an
empty result, and applies no batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import limits


def once_each(stream: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """The first event of each key that comes; the state forgets a key when the watermark has passed its event by delay."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def counts_by_window(stream: DataFrame, keys: list[str], ts: str, width: str, delay: str) -> DataFrame:
    """n events of each key and tumbling window; a window is given out once the watermark has passed it, later events are dropped."""
    found = stream.withWatermark(ts, delay).groupBy(*keys, F.window(ts, width).alias("w")).agg(F.count("*").alias("n"))
    return found.select(*keys, F.col("w.start").alias("window_start"), "n")


def apply_changes(stream: DataFrame, key: str, order: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Keep the newest change of each key, removals included, in tables path/v=<batch>; the highest one is the state.

    A batch reads the table of the one before and writes its own, so a batch that is run again after a loss writes the same rows over.
    A reader drops rows whose column `removed` is true.
    """
    rest = [c for c in stream.columns if c != key]

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch if number == 0 else batch.unionByName(spark.read.schema(batch.schema).parquet(f"{path}/v={number - 1}"))
        newest = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row")).select(key, "row.*")
        newest.select(*batch.columns).write.mode("overwrite").parquet(f"{path}/v={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


BUCKETS = 64


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _manifest(spark: SparkSession, path: str, number: int) -> dict[int, int]:
    """The version of each bucket after a batch; none before the first."""
    return {} if number < 0 else {r.bucket: r.version for r in spark.read.schema("bucket int, version long").parquet(f"{path}/manifest/v={number}").collect()}  # BUCKETS rows at most


def _rows(spark: SparkSession, path: str, schema: T.StructType, versions: dict[int, int]) -> DataFrame:
    return spark.read.schema(schema).parquet(*[f"{path}/rows/v={v}/bucket={b}" for b, v in sorted(versions.items())]) if versions else spark.createDataFrame([], schema)


def _merged(batch: DataFrame, number: int, key: str, order: list[str], path: str, keep: Column | None) -> None:
    spark, schema = batch.sparkSession, batch.schema
    before = _manifest(spark, path, number - 1)
    touched = [r.b for r in batch.select(_bucket(key).alias("b")).distinct().collect()]  # BUCKETS at most
    rows = batch.unionByName(_rows(spark, path, schema, {b: before[b] for b in touched if b in before}))
    rest = [c for c in batch.columns if c != key]
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row")).select(key, "row.*").select(*batch.columns)
    if keep is not None:
        newest = newest.where(keep)
    newest.withColumn("bucket", _bucket(key)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows/v={number}")
    found = {r.bucket for r in spark.read.schema(T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(f"{path}/rows/v={number}").select("bucket").distinct().collect()} if touched else set()
    now = {b: v for b, v in before.items() if b not in touched} | {b: number for b in found}
    spark.createDataFrame(sorted(now.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/v={number}")


def apply_in_buckets(stream: DataFrame, key: str, order: list[str], path: str, checkpoint: str, forget: str | None = None) -> StreamingQuery:
    """As apply_changes(), with the state in BUCKETS buckets of keys, of which a batch writes those anew that it touches; a manifest tells the version of each.

    A removal stays as a row, so that an older change that comes later can't undo it, until its bucket is written after the SQL condition `forget` holds for it
    (for instance: removed AND ts < ...). state() gives the rows that aren't removed. A batch that is run again writes the same files over.
    """
    keep = None if forget is None else ~F.coalesce(F.expr(forget), F.lit(False))
    return stream.writeStream.foreachBatch(lambda batch, number: _merged(batch, number, key, order, path, keep)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state(spark: SparkSession, path: str, schema: T.StructType, number: int) -> DataFrame:
    """The rows after batch `number` that aren't removed."""
    return _rows(spark, path, schema, _manifest(spark, path, number)).where(~F.col("removed"))


def relist(listing: DataFrame, known: DataFrame, key: str, ts: str, at: Column) -> DataFrame:
    """The changes that bring a known state to a full listing whose token was taken at a time: all that is listed, and a removal at that time of what isn't, unless it is newer.

    For when a token has expired: apply them as one more batch, then go on from the new token; a change made between token and listing comes again and is newer.
    """
    gone = known.join(listing.select(key), key, "left_anti").where(F.col(ts) < at)
    return listing.unionByName(gone.withColumns({ts: at, "removed": F.lit(True)}).select(*listing.columns))


def limited_within(stream: DataFrame, key: str, ts: str, event: str, limits_: list[tuple[int, int]], delay: str) -> DataFrame:
    """key, event, ts and accepted of every event under several limits (number, seconds) of accepted ones; an event without a time is rejected.

    The state of a key holds at most the greatest number of accepted times, and is dropped by a timer once the watermark has passed the last of them by the longest limit.
    """
    spans = [(number, seconds * 1_000_000) for number, seconds in limits_]
    longest = max(s for _, s in spans)
    source = stream.withWatermark(ts, delay).select(F.col(key).cast("long").alias("key"), F.col(event).cast("long").alias("event"), F.col(ts).alias("ts"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"))

    def step(_, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        recent = list(held.get[0]) if held.exists else []
        rows = pd.concat(parts).sort_values(["at", "event"], kind="stable")
        rows["accepted"] = [limits.accept_within(recent, None if pd.isna(at) else int(at), spans) for at in rows["at"]]
        held.update((recent,))
        if recent:
            held.setTimeoutTimestamp(max(recent[-1] + longest, held.getCurrentWatermarkMs() * 1000) // 1000 + 1)
        yield rows[["key", "event", "at", "accepted"]]

    found = source.groupBy("key").applyInPandasWithState(step, "key long, event long, at long, accepted boolean", "recent array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(F.col("key").alias(key), F.col("event").alias(event), F.timestamp_micros("at").alias(ts), "accepted")


def silences(stream: DataFrame, key: str, ts: str, seconds: int, delay: str) -> DataFrame:
    """key and since of each silence of a key of so many seconds or more: the sign for another one to take over.

    A timer tells it when the watermark passes the end, so no event is needed; where the event that ends a silence comes in the batch in which the timer
    would fire, it is told with that event, so the rows don't depend on how events fall into batches. Events without a time don't count.
    """
    source = stream.withWatermark(ts, delay).select(F.col(key).cast("long").alias("key"), F.col(ts).alias("ts"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at")).where("at IS NOT NULL")

    def step(group: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            last = held.get[0]
            held.remove()
            yield pd.DataFrame({"key": pd.array([group[0]], dtype="Int64"), "since": [last]})
            return
        times = sorted([*pd.concat(parts)["at"].astype("int64"), *([held.get[0]] if held.exists else [])])
        ended = [a for a, b in zip(times, times[1:]) if b - a >= seconds * 1_000_000]
        held.update((times[-1],))
        held.setTimeoutTimestamp(max(times[-1] // 1000 + seconds * 1000, held.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": pd.array([group[0]] * len(ended), dtype="Int64"), "since": pd.Series(ended, dtype="int64")})

    found = source.groupBy("key").applyInPandasWithState(step, "key long, since long", "last long", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(F.col("key").alias(key), F.timestamp_micros("since").alias("since"))


def rate_limited(stream: DataFrame, key: str, ts: str, event: str, limit: int, seconds: int) -> DataFrame:
    """key, event, ts and accepted of every event, where a key has `limit` accepted ones in any `seconds` at most and rejected ones don't count.

    State is the accepted times of the last `seconds`, so at most `limit` of them for a key. Inside a micro-batch events are
    taken in order of time and id; over micro-batches in order of arrival. ts has the precision of microseconds.
    """
    source = stream.select(F.col(key).cast("long").alias("key"), F.col(event).cast("long").alias("event"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"))

    def step(_, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        rows = pd.concat(parts).sort_values(["at", "event"], kind="stable")
        rows["accepted"] = [limits.accept(recent, None if pd.isna(at) else int(at), limit, seconds * 1_000_000) for at in rows["at"]]
        state.update((recent,))
        yield rows

    found = source.groupBy("key").applyInPandasWithState(step, "key long, event long, at long, accepted boolean", "recent array<long>", "append", GroupStateTimeout.NoTimeout)
    return found.select(F.col("key").alias(key), F.col("event").alias(event), F.timestamp_micros("at").alias(ts), "accepted")
