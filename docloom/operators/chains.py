"""What lies on chains of rows that point to one another, by doubling: a round handles each row once, and rounds are the logarithm of the longest chain.

Nulls and edge cases: a pointer to nothing, or to a row that isn't there, ends a chain; rows without doc or id are left to the caller; (doc, id) must be unique; chains that run into a
cycle have no top; an empty table gives an empty result; columns are named in the docstrings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import drop, written


def reached(start: DataFrame, steps: DataFrame) -> DataFrame:
    """doc and id of the rows of start (doc, id) and of all that steps (doc, id, to; one for each id) lead to from them."""
    taken, jump = written(start.select("doc", "id").distinct()), written(steps.select("doc", "id", "to").where("to IS NOT NULL"))
    size = taken.count()
    while True:
        further = taken.join(jump, ["doc", "id"]).select("doc", F.col("to").alias("id"))
        more = written(taken.unionByName(further).distinct())
        drop(taken)
        before, size, taken = size, more.count(), more
        if size == before:
            drop(jump)
            return taken
        twice = written(jump.join(jump.select("doc", F.col("id").alias("to"), F.col("to").alias("next")), ["doc", "to"]).select("doc", "id", F.col("next").alias("to")))
        drop(jump)
        jump = twice


def _rounds(nodes: DataFrame) -> int:
    """So many doublings take a chain of the largest doc to its end, or onto its cycle."""
    most = nodes.groupBy("doc").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    return int(most).bit_length()


def _steps(nodes: DataFrame) -> DataFrame:
    known = nodes.select("doc", F.col("id").alias("parent"), F.lit(True).alias("known"))
    return nodes.join(known, ["doc", "parent"], "left").withColumn("to", F.when(F.col("known"), F.col("parent"))).drop("known", "parent")


def climbed(nodes: DataFrame, values: dict[str, str] | None = None) -> DataFrame:
    """doc, id, top (the last row of the way up), n_above and values over a row and all above it; nodes has doc, id, parent and the columns named by values.

    values names how each is put together: "least", "sum", or "first" (the nearest that isn't null). Of rows on a way into a cycle, top and n_above are null, sums don't mean
    anything, and the others hold for the cycle too.
    """
    values = values or {}
    now = written(_steps(nodes.select("doc", "id", "parent", *values)).withColumns({"top": F.col("id"), "n": F.lit(1).cast("long")}))
    together = {
        "least": lambda mine, its: F.least(mine, its), "sum": lambda mine, its: mine + F.coalesce(its, F.lit(0)), "first": lambda mine, its: F.coalesce(mine, its),
    }
    for _ in range(_rounds(now)):
        if now.where("to IS NOT NULL").isEmpty():
            break
        above = now.select("doc", F.col("id").alias("to"), F.col("to").alias("next"), F.col("top").alias("its top"), F.col("n").alias("its n"), *[F.col(v).alias(f"its {v}") for v in values])
        merged: list[Column] = [together[how](F.col(v), F.col(f"`its {v}`")).alias(v) for v, how in values.items()]
        joined = now.join(above, ["doc", "to"], "left")
        further = joined.select("doc", "id", F.col("next").alias("to"), F.coalesce("its top", "top").alias("top"), (F.col("n") + F.coalesce("its n", F.lit(0))).alias("n"), *merged)
        last, now = now, written(further)
        drop(last)
    ended = F.col("to").isNull()
    return now.select("doc", "id", F.when(ended, F.col("top")).alias("top"), F.when(ended, F.col("n") - 1).alias("n_above"), *values)


def on_cycles(nodes: DataFrame) -> DataFrame:
    """doc and id of the nodes (doc, id, parent) that lie on a cycle: where all still are after as many steps as there are nodes."""
    now = written(_steps(nodes.select("doc", "id", "parent")).where("to IS NOT NULL"))
    for _ in range(_rounds(nodes)):
        if now.isEmpty():
            break
        last, now = now, written(now.join(now.select("doc", F.col("id").alias("to"), F.col("to").alias("next")), ["doc", "to"]).select("doc", "id", F.col("next").alias("to")))
        drop(last)
    return now.select("doc", F.col("to").alias("id")).distinct()


def gathered(nodes: DataFrame, values: dict[str, str]) -> DataFrame:
    """doc, id and values over a node and all below it; nodes has doc, id, parent and the columns, each put together by "all" or "greatest"."""
    how = {"all": F.bool_and, "greatest": F.max}
    put = [how[h](v).alias(v) for v, h in values.items()]
    jump, held = written(_steps(nodes.select("doc", "id", "parent")).where("to IS NOT NULL")), written(nodes.select("doc", "id", *values))
    for _ in range(_rounds(nodes)):
        if jump.isEmpty():
            break
        up = held.join(jump, ["doc", "id"]).select("doc", F.col("to").alias("id"), *values)
        more = written(held.unionByName(up).groupBy("doc", "id").agg(*put))
        twice = written(jump.join(jump.select("doc", F.col("id").alias("to"), F.col("to").alias("next")), ["doc", "to"]).select("doc", "id", F.col("next").alias("to")))
        drop(held, jump)
        held, jump = more, twice
    return held
