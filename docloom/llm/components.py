"""Connected components of an edge table, by alternating large-star and small-star steps until nothing changes.

Each step replaces edges by edges to smaller nodes; a node with very many neighbours only meets an aggregation, which is combined
before the shuffle, and a join, whose skewed side Spark can split. Every round is cut by a written table, so no lineage grows; the tables of the round before are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, written


def _summary(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges(a, b), a and b of one orderable type: root is the least node reachable.

    Edges with a null end and loops are ignored; repeated edges don't matter; no edges give no rows.
    """
    high, low = F.greatest("a", "b"), F.least("a", "b")
    now = written(edges.where(F.col("a") != F.col("b")).select(high.alias("a"), low.alias("b")).distinct(), "edges")
    before = _summary(now)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large = written(large, "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, now = now, written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        drop(last, large)
        after = _summary(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
