"""A limiter whose rejected events don't count, over tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def accept(recent: list[int], at: int | None, limit: int, span: int) -> bool:
    """Whether an event at this time is let in; recent holds the accepted times less than span back, and is brought up to date."""
    if at is None:
        return False
    while recent and at - recent[0] >= span:
        recent.pop(0)
    if len(recent) >= limit:
        return False
    recent.append(at)
    return True


def accept_within(recent: list[int], at: int | None, limits: list[tuple[int, int]]) -> bool:
    """As accept(), under several limits (number, span) at once; recent holds the accepted times less than the longest span back."""
    if at is None:
        return False
    longest = max(span for _, span in limits)
    while recent and at - recent[0] >= longest:
        recent.pop(0)
    if any(sum(at - t < span for t in recent) >= limit for limit, span in limits):
        return False
    recent.append(at)
    return True


def rate_limited(events: DataFrame, key: str, ts: str, event: str, limit: int, seconds: int) -> DataFrame:
    """key, event, ts and accepted of every event: a key has `limit` accepted events in any `seconds` at most, and rejected ones don't count.

    Events of a key are taken in order of time, then id. What is accepted depends on all before, but a pause of `seconds`
    or more forgets everything, so a key is split at its pauses and the runs between are spread over tasks. A task goes through its
    runs row by row and holds `limit` times at most, however long a run is.

    Nulls and edge cases: a null key is a key of its own; an event without a time is rejected; repeated rows are events of their own; columns
    beyond these three are not read.
    """
    return limited_within(events, key, ts, event, [(limit, seconds)])


def limited_within(events: DataFrame, key: str, ts: str, event: str, limits: list[tuple[int, int]]) -> DataFrame:
    """As rate_limited(), under several limits (number, seconds) at once: an event is accepted if all of them let it in. A pause of the longest one forgets everything."""
    spans = [(number, seconds * 1_000_000) for number, seconds in limits]
    span = max(s for _, s in spans)
    rows = events.select(F.col(key).alias("_k"), F.col(event).alias("_e"), F.col(ts).alias("_t"), F.unix_micros(F.col(ts).cast("timestamp")).alias("_at"))
    in_order = Window.partitionBy("_k").orderBy("_at", "_e")
    pause = F.col("_at") - F.lag("_at").over(in_order) >= span
    runs = rows.withColumn("_run", F.sum(F.when(pause, 1).otherwise(0)).over(in_order))
    dealt = runs.repartition("_k", "_run").sortWithinPartitions("_k", "_run", "_at", "_e")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, recent = None, []
        for b in batches:
            taken = []
            for k, run, at in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("_k", "_run", "_at"))):
                if (k, run) != now:
                    now, recent = (k, run), []
                taken.append(accept_within(recent, at, spans))
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in ("_k", "_e", "_t")] + [pa.array(taken, pa.bool_())], names=["_k", "_e", "_t", "accepted"])

    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema.fields}
    found = dealt.mapInArrow(walk, f"_k {kinds['_k']}, _e {kinds['_e']}, _t {kinds['_t']}, accepted boolean")
    return found.select(F.col("_k").alias(key), F.col("_e").alias(event), F.col("_t").alias(ts), "accepted")
