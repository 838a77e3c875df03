"""Joins of intervals, and their acceptance one after another, without comparing all with all.

An interval lies in one or two cells of the grid whose cells are as wide as its length, rounded up to a power of two. Two intervals that overlap share a cell of the wider one's
grid, so intervals meet by an equality join on keys, grid and cell; the narrower one goes into the grids of all widths that there are. A pair is taken in the first cell
that both have, so none comes twice. Acceptance reads a key's intervals in order and keeps one number; in a key of more than HOT intervals it is a chain: each interval points to the
first one that begins where it has ended, and chains are followed in doubling steps.

Nulls and edge cases: intervals are half open and of integers; one with a null bound or of no length meets nothing and is not accepted; null keys are a key of their own; repeated
intervals are intervals like any other, but where rows are told apart by an id it must be unique; an empty table gives an empty result; input columns stay in structs, so no name can clash.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chains import reached
from .running import carried
from .scratch import written

#: Intervals of a key that one task reads in order at most; intervals of small keys that are counted together.
HOT, AT_ONCE = 1_000_000, 1 << 16


def _placed(df: DataFrame, keys: list[str], start: str, stop: str) -> DataFrame:
    """key (a struct), lo, hi, grid (the power of two of the width) and row of the intervals that have a length."""
    lo, hi = F.col(start).cast("long"), F.col(stop).cast("long")
    rows = df.select(F.struct("*").alias("row"), F.struct(*keys).alias("key"), lo.alias("lo"), hi.alias("hi")).where("lo < hi")
    return rows.withColumn("grid", F.length(F.bin(F.col("hi") - F.col("lo") - 1)) * (F.col("hi") - F.col("lo") > 1).cast("int"))


def _cell(at: Column, grid: Column) -> Column:
    return F.call_function("shiftright", at, grid.cast("int"))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], start: str = "start", stop: str = "stop") -> DataFrame:
    """All pairs (structs left and right) of one key whose intervals share a place."""
    a, b = _placed(left, keys, start, stop), _placed(right, keys, start, stop)
    grids = a.select("grid").union(b.select("grid")).distinct().agg(F.sort_array(F.collect_set("grid")).alias("grids"))  # 64 at most

    def wide(x: DataFrame, name: str) -> DataFrame:
        cells = F.sequence(_cell(F.col("lo"), F.col("grid")), _cell(F.col("hi") - 1, F.col("grid")))
        return x.select("key", "grid", F.explode(cells).alias("cell"), F.struct("row", "lo", "hi").alias(name))

    def narrow(x: DataFrame, name: str, also_equal: bool) -> DataFrame:
        fits = (lambda g: g >= F.col("grid")) if also_equal else (lambda g: g > F.col("grid"))
        each = x.join(F.broadcast(grids)).select("key", "lo", "hi", "row", F.explode(F.filter("grids", fits)).alias("grid"))
        return wide(each, name)

    def met(x: DataFrame, y: DataFrame) -> DataFrame:
        one, two = F.col("one"), F.col("two")
        first = F.greatest(_cell(one["lo"], F.col("grid")), _cell(two["lo"], F.col("grid"))) == F.col("cell")
        return x.join(y, ["key", "grid", "cell"]).where(first & (one["lo"] < two["hi"]) & (two["lo"] < one["hi"])).select(one["row"].alias("left"), two["row"].alias("right"))

    return met(wide(a, "one"), narrow(b, "two", True)).unionByName(met(narrow(a, "one", False), wide(b, "two")))


def containing(inner: DataFrame, outer: DataFrame, keys: list[str], start: str = "start", stop: str = "stop") -> DataFrame:
    """The pairs of overlapping() in which the right interval holds the left one."""
    return overlapping(inner, outer, keys, start, stop).where((F.col(f"right.{start}") <= F.col(f"left.{start}")) & (F.col(f"left.{stop}") <= F.col(f"right.{stop}")))


def overlap_counts(df: DataFrame, keys: list[str], id: str, start: str = "start", stop: str = "stop", hot: int = HOT) -> DataFrame:
    """id, n_overlapping and n_containing: the intervals of another id and the same key that share a place with those of the id, and those that hold one of them whole.

    One shuffle by key, behind which intervals are counted by their order, so no row is made for a pair; keys of more than `hot` intervals are joined as overlapping() does.
    """
    rows = df.select(F.struct(*keys).alias("key"), F.col(id).alias("id"), F.col(start).cast("long").alias("lo"), F.col(stop).cast("long").alias("hi"))
    real, zero = rows.where("lo < hi"), F.lit(0).cast("long")
    found = rows.where("NOT coalesce(lo < hi, false)").select("id", zero.alias("n"), zero.alias("whole"))
    large = real.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("key")
    if large.isEmpty():
        found = found.unionByName(_counted(real))
    else:
        large = written(large)
        joined = written(real.join(large, "key", "left_semi"))
        whole = (F.col("right.lo") <= F.col("left.lo")) & (F.col("left.hi") <= F.col("right.hi"))
        pairs = overlapping(joined, joined, ["key"], "lo", "hi").where("NOT left.id <=> right.id").groupBy(F.col("left.id").alias("id")).agg(F.count("*").alias("n"), F.count_if(whole).alias("whole"))
        found = found.unionByName(_counted(real.join(large, "key", "left_anti"))).unionByName(joined.select("id", zero.alias("n"), zero.alias("whole"))).unionByName(pairs)
    return found.groupBy("id").agg(F.sum("n").alias("n_overlapping"), F.sum("whole").alias("n_containing")).withColumnRenamed("id", id)


def _counted(rows: DataFrame) -> DataFrame:
    """id, n and whole of each interval, counted among those of its key: a task reads keys one after the other and counts some whole ones at once."""
    line = rows.withColumn("first", F.row_number().over(Window.partitionBy("key").orderBy("lo")) == 1).sortWithinPartitions("key", "lo").select("id", "lo", "hi", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in itertools.chain(batches, [None]):
            begins = [] if batch is None else np.flatnonzero(batch["first"].to_numpy(zero_copy_only=False))
            if batch is not None:
                held.append(batch)
                n += len(batch)
            if held and (batch is None or n >= AT_ONCE and len(begins)):
                t = pa.Table.from_batches(held)
                done = n if batch is None else n - len(batch) + int(begins[-1])
                lo, hi, first = (t[c].to_numpy()[:done] for c in ("lo", "hi", "first"))
                ids = t["id"].slice(0, done).combine_chunks()
                key = np.cumsum(first)
                found, whole = _among(key, lo, hi)
                code = np.asarray(ids.dictionary_encode(null_encoding="encode").indices, np.int64)
                own, n_own = np.unique(key * done + code, return_inverse=True, return_counts=True)[1:]
                met, held_by = np.ones(done, np.int64), np.ones(done, np.int64)  # each interval meets itself
                again = n_own[own] > 1
                met[again], held_by[again] = _among(own[again], lo[again], hi[again])
                yield pa.RecordBatch.from_arrays([ids, pa.array(found - met), pa.array(whole - held_by)], names=["id", "n", "whole"])
                held, n = t.slice(done).to_batches(), n - done

    schema = T.StructType([rows.schema["id"], T.StructField("n", T.LongType()), T.StructField("whole", T.LongType())])
    return line.mapInArrow(run, schema)


def _among(key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each interval how many of its key, itself included, share a place with it, and how many hold it whole."""
    n = len(key)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, places = np.unique(key, return_inverse=True)[1], np.unique(np.concatenate([lo, hi]), return_inverse=True)[1]
    begin, end = key * (2 * n) + places[:n], key * (2 * n) + places[n:]  # in order of keys, then places
    met = np.searchsorted(np.sort(begin), end) - np.searchsorted(np.sort(end), begin, side="right")
    # those that hold an interval stand before it by start and falling end, and end no sooner: counted bit by bit from the highest on
    order = np.lexsort((-end, begin))
    bound = np.unique(end, return_inverse=True)[1]
    value, b, e = bound[order], begin[order], end[order]
    last = np.append(np.flatnonzero((b[1:] != b[:-1]) | (e[1:] != e[:-1])), n - 1)  # of equal intervals
    right = (last + 1)[np.searchsorted(last, np.arange(n))]
    left, asked, whole = np.zeros(n, np.int64), value, np.zeros(n, np.int64)
    for bit in range(int(bound.max()).bit_length() - 1, -1, -1):
        one = (value >> bit & 1).astype(bool)
        zeros = np.append(0, np.cumsum(~one))
        l0, r0, low = zeros[left], zeros[right], (asked >> bit & 1) == 0
        l1, r1 = zeros[-1] + left - l0, zeros[-1] + right - r0
        whole += np.where(low, r1 - l1, 0)
        left, right = np.where(low, l0, l1), np.where(low, r0, r1)
        value = np.concatenate([value[~one], value[one]])
    found = np.empty(n, np.int64)
    found[order] = whole + right - left
    return met, found


def clear_of(df: DataFrame, occupied: DataFrame, keys: list[str], id: str, start: str = "start", stop: str = "stop") -> DataFrame:
    """The rows of df (told apart by id) that meet no occupied interval of their key."""
    met = overlapping(df, occupied, keys, start, stop).select(F.col(f"left.{id}").alias(id)).distinct()
    return df.join(met, id, "left_anti")


def accepted(df: DataFrame, keys: list[str], id: str, start: str = "start", stop: str = "stop", hot: int = HOT) -> DataFrame:
    """The rows of df that are accepted in order of start, stop and id: each that meets none accepted before it. Keys of more than `hot` intervals are spread over ranges."""
    rows = df.select(F.struct("*").alias("row"), F.struct(*keys).alias("key"), F.col(id).alias("id"), F.col(start).cast("long").alias("lo"), F.col(stop).cast("long").alias("hi")).where("lo < hi")
    large = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("key")
    if large.isEmpty():
        return _scanned(rows)
    large = written(large)
    return _scanned(rows.join(large, "key", "left_anti")).unionByName(_chained(written(rows.join(large, "key", "left_semi"))))


def _scanned(rows: DataFrame) -> DataFrame:
    """What accepted() takes of rows: one shuffle by key, read in order with the last stop as state."""
    by = Window.partitionBy("key").orderBy("lo", "hi", "id")
    line = rows.withColumn("first", F.row_number().over(by) == 1).sortWithinPartitions("key", "lo", "hi", "id").select("row", "lo", "hi", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = None
        for batch in batches:
            row, *sides = (batch.column(batch.schema.get_field_index(c)) for c in ("row", "lo", "hi", "first"))
            taken = []
            for lo, hi, first in zip(*(s.to_pylist() for s in sides)):
                taken.append(first or lo >= end)
                if taken[-1]:
                    end = hi
            yield pa.RecordBatch.from_arrays([row.filter(pa.array(taken, pa.bool_()))], names=["row"])

    return line.mapInArrow(run, rows.select("row").schema).select("row.*")


def _chained(rows: DataFrame) -> DataFrame:
    """As _scanned(), where a key may be larger than a task.

    Those accepted begin with the first of a key, and each is followed by the first that begins at or behind its stop. The rows that a round reaches double, so
    the rounds are the logarithm of the longest chain; a round is an equality join of rows in proportion to the table, and a hot key is spread over ranges.
    """
    # As-of: behind each stop, the next interval in order; an interval that begins there counts, so stops come before starts.
    begins = rows.select("key", F.col("lo").alias("at"), F.lit(1).alias("kind"), F.struct("lo", "hi", "id").alias("order"))
    ends = rows.select("key", F.col("hi").alias("at"), F.lit(0).alias("kind"), F.struct("lo", "hi", "id").alias("order"))
    line = begins.unionByName(ends).withColumn("begin", F.when(F.col("kind") == 1, F.col("order")))
    found = carried(line, ["key"], ["at", "kind", "order"], {"next": "begin"}, back=True).where("kind = 0")
    steps = found.select(F.col("key").alias("doc"), F.col("order").alias("id"), F.col("next").alias("to"))
    taken = reached(rows.groupBy(F.col("key").alias("doc")).agg(F.min(F.struct("lo", "hi", "id")).alias("id")), steps)
    return rows.withColumn("order", F.struct("lo", "hi", "id")).join(taken.select(F.col("doc").alias("key"), F.col("id").alias("order")), ["key", "order"], "left_semi").select("row.*")
