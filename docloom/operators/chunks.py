"""Chunks of texts by their lines: a row for each line, windows over a text's lines, then one greedy pass over the lengths of its pieces.

A fence and neighbouring rows of a table stay together up to MOST characters; a longer one falls into lines, and a longer line is cut behind the last sentence that ends in it,
else at MOST. A chunk ends before a section and before a piece that would take it beyond TARGET characters; it is exactly what stands between its offsets.

Nulls and edge cases: a null, empty or blank text has no chunks; repeated rows are chunked each for itself (`row_id` tells them apart); blank chunks are left out and take no
place; an empty table gives no rows; input columns named like an added one are an error.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that a chunk aims at and may have, the least part of a cut line, a heading's length; what begins a section, a fence and a table; where a sentence ends.
TARGET, MOST, LEAST, HEADING = 1500, 3000, 750, 80
SECTION, FENCE, TABLE = r"^(?:#{1,6}\s+\S|--- Page \d+ ---\s*$)", r"^\s*```", r"^\s*\|"
ENDS = "[.!?。！？]"
ADDED = ("row_id", "place", "start", "stop", "heading", "text")


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def greedy_groups(starts: pd.Series, stops: pd.Series, breaks: pd.Series, limit: pd.Series) -> pd.Series:
    """The group of each piece in order: a new one begins at a break and where a piece would stop more than the limit behind its group's start."""

    def one(begin, end, hard, most):
        found, group, origin = [], -1, None
        for b, e, h in zip(begin, end, hard):
            if origin is None or h or e - origin > most:
                group, origin = group + 1, b
            found.append(group)
        return found

    return pd.Series([one(*row) for row in zip(starts, stops, breaks, limit)])


def packs_of(sizes: Column, target: int) -> Column:
    """The pack of each size in order: a pack is closed when the next size would take it beyond the target; a size beyond it has its own."""
    # Each size runs from the sum of those before it to the sum with it.
    upto = F.transform(sizes, lambda _, i: F.aggregate(F.slice(sizes, F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, x: a + x))
    return greedy_groups(F.transform(upto, lambda u, i: u - F.get(sizes, i)), upto, F.transform(sizes, lambda _: F.lit(False)), F.lit(target))


def _cuts(line: Column) -> Column:
    """Where the parts of a line begin: 0 alone for one of MOST characters at most."""
    last_end = rf"(?s)^(.{{{LEAST - 1},}}{ENDS})(?:\s.*)?$"  # greedy: behind the last sentence that ends in the part and leaves LEAST characters at least

    def step(state: Column, _: Column) -> Column:
        part = F.substr(line, state["at"] + 1, F.lit(MOST))
        cut = F.length(F.regexp_extract(part, last_end, 1))
        following = state["at"] + F.when(cut > 0, cut).otherwise(MOST)
        done = F.length(line) - state["at"] <= MOST
        return F.when(done, state).otherwise(F.struct(following.alias("at"), F.concat(state["cuts"], F.array(following)).alias("cuts")))

    start = F.struct(F.lit(0).alias("at"), F.array(F.lit(0)).alias("cuts"))
    found = F.aggregate(F.sequence(F.lit(1), F.ceil(F.length(line) / LEAST).cast("int")), start, step, lambda s: s["cuts"])
    return F.when(F.length(line) > MOST, found).otherwise(F.array(F.lit(0)))


def pieces_of(docs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, row_id, at and the pieces of each text that aren't split any further: start, stop, section, label and text."""
    by_line = Window.partitionBy("row_id").orderBy("i")
    numbered = docs.select(*keys, "text", F.monotonically_increasing_id().alias("row_id"))
    each = numbered.select(*keys, "row_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    each = each.withColumns({
        "start": F.coalesce(F.sum(F.length("line") + 1).over(by_line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"),
        "mark": F.col("line").rlike(FENCE),
        "fences": F.sum(F.col("line").rlike(FENCE).cast("int")).over(by_line),
    })
    fenced = F.col("mark") | (F.col("fences") % 2 == 1)
    kind = F.when(fenced, F.concat(F.lit("fence "), F.ceil(F.col("fences") / 2))).when(F.col("line").rlike(TABLE), "table")
    each = each.withColumns({"kind": kind, "before": F.lag(kind).over(by_line)})
    each = each.withColumn("unit", F.sum((F.col("kind").isNull() | ~F.col("kind").eqNullSafe(F.col("before"))).cast("int")).over(by_line))
    of_unit = Window.partitionBy("row_id", "unit")
    size = F.max(F.col("start") + F.length("line")).over(of_unit) - F.min("start").over(of_unit)
    each = each.withColumns({"whole": size <= MOST, "lines": F.count("*").over(of_unit)})
    single = F.col("kind").isNull() & F.col("line").rlike(SECTION)
    parts = each.select(*keys, "row_id", "i", F.when(F.col("whole"), F.col("unit")).alias("unit"), "start", "line", single.alias("single"), F.posexplode(_cuts(F.col("line"))).alias("k", "cut"), _cuts(F.col("line")).alias("cuts"))
    upto = F.coalesce(F.get("cuts", F.col("k") + 1), F.length("line"))
    parts = parts.select(
        *keys, "row_id", "i", "k", "unit", (F.col("start") + F.col("cut")).alias("start"), (F.col("start") + upto).alias("stop"), F.substr("line", F.col("cut") + 1, upto - F.col("cut")).alias("text"),
        (F.col("single") & (F.col("k") == 0)).alias("section"), F.when(F.col("single"), F.col("line")).alias("title"),
    ).where((F.col("stop") > F.col("start")) | F.col("unit").isNotNull())
    together = F.coalesce(F.concat(F.lit("u"), F.col("unit")), F.concat_ws(" ", "i", "k"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), "\n")  # a piece of several lines has no part of one
    found = parts.groupBy(*keys, "row_id", together.alias("together")).agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.max("section").alias("section"), F.max("title").alias("title"), text.alias("text"), F.min(F.struct("i", "k")).alias("at")
    )
    label = F.substring(F.trim(F.regexp_replace(F.regexp_replace("title", r"^#{1,6}\s+|^---\s*|\s*---\s*$", ""), r"\s+", " ")), 1, HEADING)
    return found.select(*keys, "row_id", "at", "start", "stop", "section", F.when(F.col("section"), F.nullif(label, F.lit(""))).alias("label"), "text")


def chunks_of(docs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, row_id, place, start, stop, heading (of the section it stands in) and text of the chunks of each row's text; offsets are in code points."""
    if clash := sorted(set(keys) & set(ADDED)):
        raise ValueError(f"columns {clash} of the input would be lost")
    in_order = Window.partitionBy("row_id").orderBy("at")
    feeds = F.coalesce(F.col("start") - F.lag("stop").over(in_order), F.lit(0))  # only line feeds stand between pieces
    pieces = pieces_of(docs, keys).withColumns({"label": F.last("label", ignorenulls=True).over(in_order), "glue": F.repeat(F.lit("\n"), feeds)})
    gathered = pieces.groupBy(*keys, "row_id").agg(F.array_sort(F.collect_list(F.struct("at", "start", "stop", "section", "label", "glue", "text"))).alias("p"))
    grouped = gathered.withColumn("g", greedy_groups(F.transform("p", lambda x: x["start"]), F.transform("p", lambda x: x["stop"]), F.transform("p", lambda x: x["section"]), F.lit(TARGET)))
    each = grouped.select(*keys, "row_id", F.explode(F.arrays_zip("p", "g")).alias("z")).select(*keys, "row_id", "z.g", "z.p.*")
    text = F.aggregate(F.array_sort(F.collect_list(F.struct("at", "glue", "text"))), F.lit(""), lambda a, x: F.concat(a, x["glue"], x["text"]))
    found = each.groupBy(*keys, "row_id", "g").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min_by("label", "at").alias("heading"), F.min_by("glue", "at").alias("glue"), text.alias("text"))
    found = found.withColumn("text", F.substr("text", F.length("glue") + 1)).where(F.col("text").rlike(r"(?U)\S"))
    place = F.row_number().over(Window.partitionBy("row_id").orderBy("g")) - 1
    return found.select(*keys, "row_id", place.alias("place"), "start", "stop", "heading", "text")
