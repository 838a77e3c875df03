"""Version trees: paths to the root, siblings, redo, repair, layout in lanes and pruning, as joins over all trees at once.

A table of nodes has doc, id, parent (null: a root) and at (when it was made), and where named available (it has its content) and forward (the child
that redo prefers).

Nulls and edge cases: of rows equal in doc and id the one of least parent counts; a row whose doc or id is null belongs to no tree and is left out; a parent that
doesn't exist, or that closes a cycle, ends a path; ties of at go by id; an empty table gives an empty result. Other columns don't matter, and can't clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chains import climbed, gathered, on_cycles, reached
from .running import grouped_running
from .scratch import written

# What pruning leaves of a tree: contents, bytes of contents, nodes.
SNAPSHOTS, STORE_BYTES, NODES = 60, 48 * 2**20, 300


def _nodes(nodes: DataFrame, *extra: str) -> DataFrame:
    least = F.min(F.struct("parent", "at", *extra)).alias("n")
    return nodes.where("doc IS NOT NULL AND id IS NOT NULL").groupBy("doc", "id").agg(least).select("doc", "id", "n.*")


def ancestors(nodes: DataFrame) -> DataFrame:
    """doc, id, ancestor and depth: each node with itself (depth 0), its parent (1) and so on, to a root, a missing parent or the end of a cycle.

    All pairs, so rows grow with the depth of a tree: for those who ask for whole paths. The functions below carry what they need along the way instead, in rows in proportion to nodes.
    Paths double in each round, so their number is the logarithm of the longest path, and a round is two equality joins.
    """
    ids = _nodes(nodes)
    reach = written(ids.select("doc", "id", F.col("id").alias("ancestor"), F.lit(0).alias("depth")))
    jump = ids.where("parent IS NOT NULL").join(ids.select("doc", F.col("id").alias("parent")), ["doc", "parent"], "left_semi").select("doc", "id", F.col("parent").alias("to"))
    step = 1
    while True:
        jump = written(jump.join(reach.select("doc", "id", F.col("ancestor").alias("to")), ["doc", "id", "to"], "left_anti"))  # one that comes back closes a cycle
        if jump.isEmpty():
            return reach
        further = jump.join(reach.select("doc", F.col("id").alias("to"), "ancestor", (F.col("depth") + step).alias("depth")), ["doc", "to"])
        reach = written(reach.unionByName(further.drop("to")).groupBy("doc", "id", "ancestor").agg(F.min("depth").alias("depth")))
        jump = jump.join(jump.select("doc", F.col("id").alias("to"), F.col("to").alias("next")), ["doc", "to"]).select("doc", "id", F.col("next").alias("to"))
        step *= 2


def tops(nodes: DataFrame) -> DataFrame:
    """doc, id, root (the last node of its path) and n_above, how many are above it; null where the path runs into a cycle."""
    return climbed(_nodes(nodes)).select("doc", "id", F.col("top").alias("root"), "n_above")


def siblings(nodes: DataFrame) -> DataFrame:
    """doc, id, parent, place among its parent's children (from 1, oldest first) and their number, set_size; roots of a tree are siblings."""
    placed = grouped_running(_nodes(nodes).withColumn("one", F.lit(1)), ["doc", "parent"], ["at", "id"], {"place": "one"})
    sizes = placed.groupBy(F.col("doc").alias("of"), F.col("parent").alias("under")).agg(F.count("*").alias("set_size"))
    same = (F.col("doc") == F.col("of")) & F.col("parent").eqNullSafe(F.col("under"))
    return placed.join(sizes, same).select("doc", "id", "parent", "place", "set_size")


def redo_children(nodes: DataFrame) -> DataFrame:
    """doc, id and redo: the forward child if it is a child and available, else the newest available child; nodes without one are left out."""
    n = _nodes(nodes, "available", "forward")
    kids = n.where("available AND parent IS NOT NULL").select("doc", F.col("parent").alias("of"), F.col("id").alias("child"), "at")
    found = kids.join(n.select("doc", F.col("id").alias("of"), "forward"), ["doc", "of"])
    preferred = F.coalesce(F.col("child") == F.col("forward"), F.lit(False))
    return found.groupBy("doc", F.col("of").alias("id")).agg(F.max_by("child", F.struct(preferred, "at", "child")).alias("redo"))


def history(nodes: DataFrame) -> DataFrame:
    """doc, id, can_undo (its parent is there and available) and can_redo."""
    n = _nodes(nodes, "available")
    open_ = n.where("available").select("doc", F.col("id").alias("parent"), F.lit(True).alias("up"))
    found = n.join(open_, ["doc", "parent"], "left").join(redo_children(nodes), ["doc", "id"], "left")
    return found.select("doc", "id", F.col("up").isNotNull().alias("can_undo"), F.col("redo").isNotNull().alias("can_redo"))


def scroll_targets(paths: DataFrame) -> DataFrame:
    """doc, id, ancestor and target: going up from id to an ancestor, the node just below it on the way, of ancestors()' rows."""
    below = paths.select("doc", "id", F.col("ancestor").alias("target"), (F.col("depth") + 1).alias("depth"))
    return paths.where("depth > 0").join(below, ["doc", "id", "depth"]).select("doc", "id", "ancestor", "target")


def rebuilt(nodes: DataFrame) -> DataFrame:
    """doc, id, root and is_current (the newest) of the nodes that the oldest root of each tree reaches; others are left out."""
    n = _nodes(nodes)
    roots = n.where("parent IS NULL").groupBy("doc").agg(F.min(F.struct("at", "id")).alias("r")).select("doc", F.col("r.id").alias("root"))
    kept = climbed(n).select("doc", "id", F.col("top").alias("root")).join(roots, ["doc", "root"]).join(n.select("doc", "id", "at"), ["doc", "id"])
    newest = kept.groupBy("doc").agg(F.max(F.struct("at", "id")).alias("newest"))
    return kept.join(newest, "doc").select("doc", "id", "root", (F.col("id") == F.col("newest.id")).alias("is_current"))


def mended(nodes: DataFrame) -> DataFrame:
    """doc, id, parent and at of each node, where what no root reaches has roots of its own: each node older than all on its way into the cycle."""
    n = _nodes(nodes)
    known = n.select("doc", F.col("id").alias("parent"))
    n = n.join(known.withColumn("known", F.lit(True)), ["doc", "parent"], "left").select("doc", "id", F.when(F.col("known") & (F.col("parent") != F.col("id")), F.col("parent")).alias("parent"), "at")
    n = written(n)
    ways = climbed(n.withColumn("oldest", F.struct("at", "id")), {"oldest": "least"})
    tops = ways.where(F.col("top").isNull() & (F.col("oldest.id") == F.col("id"))).select("doc", "id", F.lit(True).alias("lost"))
    return n.join(tops, ["doc", "id"], "left").select("doc", "id", F.when(F.col("lost").isNull(), F.col("parent")).alias("parent"), "at")


def lanes(nodes: DataFrame) -> DataFrame:
    """doc, id, level (from 1), lane (its first node), branches_from (the node that the lane's group branches from; null at the top), set_size and place.

    A node's oldest child goes on in its lane, each other child begins a lane a level below; a group is all lanes that branch from one node, and set_size
    and place count its nodes, lane by lane, oldest lane first. Cycles are mended before.
    """
    n = written(mended(nodes))
    order = siblings(n).select("doc", "id", "place", "parent").join(n.select("doc", "id", "at"), ["doc", "id"])
    starts = (F.col("place") > 1) | F.col("parent").isNull()
    marked = order.select("doc", "id", "parent", starts.cast("int").alias("level"), F.when(starts, F.struct(F.col("id").alias("lane"), F.col("at").alias("lane_at"), F.col("parent").alias("branches_from"))).alias("l"))
    ways = climbed(marked, {"level": "sum", "l": "first"}).select("doc", "id", F.col("level").cast("int").alias("level"), "l.*", "n_above")
    begun = ways.select("doc", F.col("id").alias("lane"), F.col("n_above").alias("lane_above"))
    mine = ways.join(begun, ["doc", "lane"]).select("doc", "id", "level", "lane", "lane_at", "branches_from", (F.col("n_above") - F.col("lane_above")).alias("along"), F.lit(1).alias("one"))
    placed = grouped_running(mine, ["doc", "branches_from"], ["lane_at", "lane", "along"], {"place": "one"})
    sizes = mine.groupBy(F.col("doc").alias("of"), F.col("branches_from").alias("under")).agg(F.count("*").alias("set_size"))
    same = (F.col("doc") == F.col("of")) & F.col("branches_from").eqNullSafe(F.col("under"))
    return placed.join(sizes, same).select("doc", "id", "level", "lane", "branches_from", "set_size", "place")


def prune_plan(nodes: DataFrame, currents: DataFrame, snapshots: int = SNAPSHOTS, store_bytes: int = STORE_BYTES, most: int = NODES) -> DataFrame:
    """doc, id and action (stub or remove) of the nodes that lose their content or go, of nodes with sha (null: a stub), bytes and forward; currents has doc and id.

    The oldest root, the current node, what is above it and its redo child stay. Contents go oldest first, until `snapshots` and `store_bytes` are kept; equal contents
    are stored once, so bytes are freed with the last node that has them. Then stubs without children go, oldest first, until `most` nodes are left:
    a node can go when all below it can, and goes when the newest below it does, so its place in line is that of the newest, and below goes before above.
    """
    n = written(_nodes(nodes.withColumn("available", F.col("sha").isNotNull()), "available", "forward", "sha", "bytes"))
    roots = n.where("parent IS NULL").groupBy("doc").agg(F.min(F.struct("at", "id")).alias("r")).select("doc", F.col("r.id").alias("id"))
    current = currents.select("doc", "id").distinct().join(n.select("doc", "id"), ["doc", "id"], "left_semi")
    known = n.select("doc", F.col("id").alias("to"))
    above = reached(current, n.select("doc", "id", F.col("parent").alias("to")).join(known, ["doc", "to"], "left_semi"))
    kept = roots.unionByName(above).unionByName(redo_children(n).join(current, ["doc", "id"], "left_semi").select("doc", F.col("redo").alias("id"))).distinct()
    n = written(n.join(kept.withColumn("stays", F.lit(True)), ["doc", "id"], "left").withColumn("stays", F.col("stays").isNotNull()))

    held = n.where("available")
    last = held.groupBy("doc", "sha").agg(F.max("bytes").alias("size"), F.bool_or("stays").alias("needed"), F.max(F.struct("at", "id")).alias("last"))
    totals = last.groupBy("doc").agg(F.sum("size").alias("all_bytes")).join(held.groupBy("doc").agg(F.count("*").alias("all_held")), "doc")
    line = held.where("NOT stays").join(last, ["doc", "sha"])
    frees = F.when(~F.col("needed") & (F.struct("at", "id") == F.col("last")), F.col("size")).otherwise(0)
    line = line.select("doc", "id", "at", frees.alias("frees"), F.lit(1).alias("one"))
    upto = grouped_running(line, ["doc"], ["at", "id"], {"freed": "frees", "place": "one"}).join(totals, "doc")
    before = (F.col("all_held") - F.col("place") + 1 > snapshots) | (F.col("all_bytes") - F.col("freed") + F.col("frees") > store_bytes)
    stubbed = written(upto.where(before).select("doc", "id"))

    now = n.join(stubbed.withColumn("cut", F.lit(True)), ["doc", "id"], "left").select("doc", "id", "at", ((~F.col("available") | F.col("cut").isNotNull()) & ~F.col("stays")).alias("free"))
    turning = written(on_cycles(n).withColumn("turns", F.lit(True)))  # nodes of a cycle are never without children
    now = now.join(turning, ["doc", "id"], "left").select("doc", "id", "at", (F.col("free") & F.col("turns").isNull()).alias("free"))
    ranked = now.select("doc", "id", "free", F.struct("at", F.col("id").alias("by")).alias("newest")).join(n.select("doc", "id", "parent"), ["doc", "id"])
    below = gathered(ranked, {"free": "all", "newest": "greatest"})
    height = climbed(n.join(turning, ["doc", "id"], "left").select("doc", "id", F.when(F.col("turns").isNull(), F.col("parent")).alias("parent"))).select("doc", "id", (-F.col("n_above")).alias("up"))
    free = below.where("free").join(height, ["doc", "id"]).select("doc", "id", "newest", "up", F.lit(1).alias("one"))
    over = n.groupBy("doc").agg((F.count("*") - most).alias("over"))
    removed = grouped_running(free, ["doc"], ["newest", "up", "id"], {"place": "one"}).join(over, "doc").where("place <= over").select("doc", "id")
    gone = removed.withColumn("action", F.lit("remove"))
    return gone.unionByName(stubbed.join(removed, ["doc", "id"], "left_anti").withColumn("action", F.lit("stub")))
