"""Queries over version trees, with the SQL that gives the same rows.

The tables hold no such trees, so each conversation is one: a turn's parent is the turn of half its number, a turn whose text is of a length that five divides is a
stub, and every third turn prefers its first child.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import trees
from ..sources.tables import table


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("id"), F.when(F.col("turn") > 0, F.floor((F.col("turn") - 1) / 2)).alias("parent"), F.col("turn").alias("at"), F.length("text").alias("bytes"), "text")
    available = F.col("bytes") % 5 != 0
    return c.select("doc", "id", "parent", "at", available.alias("available"), F.when(F.col("id") % 3 == 0, F.col("id") * 2 + 1).alias("forward"), F.when(available, F.sha2("text", 256)).alias("sha"), "bytes")


def version_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each version with how many are above it, and the first of those."""
    return trees.tops(_versions(spark, sf_dir)).select("doc", "id", F.col("n_above").cast("int").alias("n_above"), "root")


def version_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each version among its parent's children."""
    return trees.siblings(_versions(spark, sf_dir)).select("doc", "id", F.col("place").cast("long").alias("place"), F.col("set_size").cast("long").alias("set_size"))


def version_redo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What redo opens from each version."""
    return trees.redo_children(_versions(spark, sf_dir))


def version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each version can be undone and redone."""
    return trees.history(_versions(spark, sf_dir))


def version_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the way up from a version to another one comes from."""
    return trees.scroll_targets(trees.ancestors(_versions(spark, sf_dir)))


def version_rebuilds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The versions that the oldest root reaches, once those of every fourth conversation lost their turn 1."""
    return trees.rebuilt(_versions(spark, sf_dir).where("NOT (doc % 4 = 0 AND id = 1)"))


def version_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level, lane and place of each version as it is drawn."""
    return trees.lanes(_versions(spark, sf_dir)).select("doc", "id", "level", "lane", "branches_from", F.col("set_size").cast("long").alias("set_size"), F.col("place").cast("long").alias("place"))


def version_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pruning does to trees that may keep three contents, 1,500 characters and five versions."""
    v = _versions(spark, sf_dir)
    return trees.prune_plan(v, v.groupBy("doc").agg(F.max("id").alias("id")), 3, 1500, 5)


QUERIES = {f.__name__: f for f in (version_paths, version_siblings, version_redo, version_history, version_targets, version_rebuilds, version_lanes, version_pruning)}

_V = "v AS (SELECT conv_id AS doc, turn AS id, CASE WHEN turn > 0 THEN (turn - 1) // 2 END AS parent, length(text) % 5 <> 0 AS available, CASE WHEN turn % 3 = 0 THEN turn * 2 + 1 END AS forward FROM conversations)"
_UP = f"{_V}, u AS (SELECT doc, id, id AS ancestor, parent AS next, 0 AS depth FROM v UNION ALL SELECT u.doc, u.id, v.id, v.parent, u.depth + 1 FROM u JOIN v ON u.doc = v.doc AND u.next = v.id)"
_REDO = "r AS (SELECT p.doc, p.id, max_by(c.id, (CASE WHEN c.id = p.forward THEN 1000000 ELSE 0 END) + c.id) AS redo FROM v p JOIN v c ON c.doc = p.doc AND c.parent = p.id WHERE c.available GROUP BY 1, 2)"
#: Pruning has no SQL: its last step removes leaves one after another. The tests hold it against such a loop.
ORACLE_SQL = {
    "version_paths": f"WITH RECURSIVE {_UP} SELECT doc, id, max(depth) AS n_above, max_by(ancestor, depth) AS root FROM u GROUP BY 1, 2",
    "version_siblings": f"WITH {_V} SELECT doc, id, row_number() OVER (PARTITION BY doc, parent ORDER BY id) AS place, count(*) OVER (PARTITION BY doc, parent) AS set_size FROM v",
    "version_redo": f"WITH {_V}, {_REDO} SELECT * FROM r",
    "version_history": f"WITH {_V}, {_REDO} SELECT v.doc, v.id, coalesce(p.available, false) AS can_undo, redo IS NOT NULL AS can_redo FROM v LEFT JOIN v p ON p.doc = v.doc AND p.id = v.parent LEFT JOIN r ON r.doc = v.doc AND r.id = v.id",
    "version_targets": f"WITH RECURSIVE {_UP} SELECT a.doc, a.id, a.ancestor, b.ancestor AS target FROM u a JOIN u b ON a.doc = b.doc AND a.id = b.id AND b.depth = a.depth - 1",
    "version_rebuilds": f"WITH RECURSIVE {_V}, w AS (SELECT * FROM v WHERE NOT (doc % 4 = 0 AND id = 1)), t AS (SELECT doc, id FROM w WHERE parent IS NULL UNION ALL SELECT w.doc, w.id FROM w JOIN t ON w.doc = t.doc AND w.parent = t.id) SELECT doc, id, 0 AS root, id = max(id) OVER (PARTITION BY doc) AS is_current FROM t",
    "version_lanes": f"""WITH RECURSIVE {_V}, k AS (SELECT *, row_number() OVER (PARTITION BY doc, parent ORDER BY id) AS n FROM v), t AS (SELECT doc, id, 1 AS level, id AS lane, CAST(NULL AS BIGINT) AS branches_from, 0 AS along FROM k WHERE parent IS NULL
        UNION ALL SELECT k.doc, k.id, t.level + CASE WHEN n > 1 THEN 1 ELSE 0 END, CASE WHEN n > 1 THEN k.id ELSE t.lane END, CASE WHEN n > 1 THEN t.id ELSE t.branches_from END, CASE WHEN n > 1 THEN 0 ELSE t.along + 1 END FROM k JOIN t ON k.doc = t.doc AND k.parent = t.id)
        SELECT doc, id, level, lane, branches_from, count(*) OVER (PARTITION BY doc, branches_from) AS set_size, row_number() OVER (PARTITION BY doc, branches_from ORDER BY lane, along) AS place FROM t""",
}
