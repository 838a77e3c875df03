"""Budgets that requests are admitted to one after another, and places in lanes that wait for free slots.

A request that doesn't fit is passed over and later ones may still fit, so no running sum tells who is admitted: what is used depends on every answer before. Requests of a job are
read in order from a sorted partition, with three numbers as the only state, so memory doesn't grow with a job.

Nulls and edge cases: null sizes count as 0; a null job is a job; places must be unique in a job (ties have no defined order); an empty table gives an empty result; an
input column named like an added one is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .running import grouped_running

# Fixed value: bytes that are held for each priority request that is announced.
HELD_BYTES = 4 << 20
REQUEST, PRIORITY, RELEASE = "request", "priority", "release"


def admitted(requests: DataFrame, most: int, most_bytes: int, held_bytes: int = HELD_BYTES) -> DataFrame:
    """job, place, kind, admitted, used and used_bytes (after the row) of rows (job, place, kind, bytes, announced).

    A priority request fits within both limits. Another one must also leave room for the priority requests that are announced (the job's greatest value of announced) and have not
    been admitted yet, each of held_bytes. A release gives one place and its bytes back.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used, size, pending = None, 0, 0, 0
        for batch in batches:
            answers = []
            for job, kind, need, announced in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4))):
                if (job,) != now:
                    now, used, size, pending = (job,), 0, 0, announced
                if kind == RELEASE:
                    used, size, fits = max(0, used - 1), max(0, size - need), None
                else:
                    held = 0 if kind == PRIORITY else pending
                    fits = used + held + 1 <= most and size + held * held_bytes + need <= most_bytes
                    used, size = used + fits, size + need * fits
                    pending -= fits and kind == PRIORITY and pending > 0
                answers.append((fits, used, size))
            columns = [pa.array([a[i] for a in answers], t) for i, t in enumerate((pa.bool_(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *columns], names=["job", "place", "kind", "admitted", "used", "used_bytes"])

    announced = requests.groupBy(F.col("job").alias("of")).agg(F.coalesce(F.max("announced"), F.lit(0)).cast("long").alias("announced"))
    rows = requests.select("job", "place", "kind", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes")).join(announced, F.col("job").eqNullSafe(F.col("of")))
    dealt = rows.select(F.col("job").cast("string").alias("job"), F.col("place").cast("long").alias("place"), "kind", "bytes", "announced").repartition("job").sortWithinPartitions("job", "place")
    return dealt.mapInArrow(walk, "job string, place long, kind string, admitted boolean, used long, used_bytes long")


def queue_positions(waiting: DataFrame, lanes: DataFrame) -> DataFrame:
    """id, lane and position of rows (id, lane, at): how many jobs must end before each starts; 0 for those that a free slot takes.

    lanes has lane, running and slots. Places come from running sums in ranges, so a lane may hold most of the table.
    """
    line = grouped_running(waiting.select("id", "lane", "at", F.lit(1).alias("one")), ["lane"], ["at", "id"], {"n": "one"})
    ahead, free = F.col("n") - 1, F.col("slots") - F.col("running")
    position = F.when(ahead < free, 0).otherwise(ahead + F.greatest(F.lit(1), 1 - free))
    return line.join(lanes, "lane").select("id", "lane", position.cast("long").alias("position"))
