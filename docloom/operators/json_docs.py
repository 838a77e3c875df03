"""Free JSON documents as rows of leaves: walking, comparing, merging and writing them again, canonical texts and their hashes.

A document is walked level by level with VARIANT columns, each level a written table, so its depth needn't be known. A leaf is any value but an object with members; arrays are leaves.
Two documents of a key are merged by passing over the leaves of both in order of their paths, which Spark sorts and may spill, and compared by a full join on (key, path): no side is
broadcast, as Parquet files of leaves are far smaller than their rows in memory. Only the members of one object are gathered, when texts are written again.

Nulls and edge cases: a null text, one that isn't JSON and one with a member twice in an object has no leaf and a null canonical text; neither has what isn't an object at the top (its
canonical text is that of the value). An empty object is a leaf, at the top it has none. Members are ordered as UTF-16, also those that look like numbers. Numbers with a fraction lose
trailing zeros; those with an exponent are written as doubles. Each key names one document; null keys are told apart from others but not from each other. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from .scratch import drop, written


def canonical(text: Column) -> Column:
    """JSON text with the members of every object in order and no blanks."""
    return F.to_json(F.try_parse_json(text))


def content_hash(text: Column, without: tuple[str, ...] = ()) -> Column:
    """SHA-256 of the canonical text of an object, some of its own members left out."""
    members = F.from_json(canonical(text), "map<string,variant>")
    kept = F.map_filter(members, lambda name, _: ~name.isin(*without)) if without else members
    return F.sha2(F.to_json(F.to_variant_object(kept)), 256)


def dotted(path: Column) -> Column:
    return F.array_join(path, ".")


def leaves(docs: DataFrame, key: str, text: str, whole: tuple[str, ...] = ()) -> DataFrame:
    """key, path (names from the top), value (JSON text) and strings (the leaf, or the items of an array, that are strings); paths of whole are leaves whatever they hold."""
    rows = docs.select(F.col(key).alias("key"), F.array().cast("array<string>").alias("path"), F.try_parse_json(F.col(text)).alias("v"))
    found, open_ = [], rows
    while True:
        members = F.try_variant_get("v", "$", "map<string,variant>")
        level = open_.select("key", F.col("path").alias("above"), F.explode(members).alias("name", "v")).select("key", F.concat("above", F.array("name")).alias("path"), "v")
        inner = F.coalesce(F.size(F.try_variant_get("v", "$", "map<string,variant>")) > 0, F.lit(False))
        level = written(level.withColumn("inner", inner & ~dotted(F.col("path")).isin(*whole) if whole else inner))
        found.append(level)
        if level.where("inner").isEmpty():
            break
        open_ = level.where("inner")
    is_text = lambda v: F.schema_of_variant(v) == "STRING"
    items = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
    strings = F.transform(F.filter(items, is_text), lambda v: F.try_variant_get(v, "$", "string"))
    out = written(reduce(DataFrame.unionByName, found).where("NOT inner").select("key", "path", F.to_json("v").alias("value"), strings.alias("strings")))
    drop(*found)
    return out.withColumnRenamed("key", key)


def changed(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key, path, before and after of the leaves that differ between two versions, given as leaves()."""
    a, b = before.select(key, "path", F.col("value").alias("before")), after.select(key, "path", F.col("value").alias("after"))
    met = a.alias("a").join(b.alias("b"), F.col(f"a.{_q(key)}").eqNullSafe(F.col(f"b.{_q(key)}")) & (F.col("a.path") == F.col("b.path")), "full")
    got = met.select(F.coalesce(f"a.{_q(key)}", f"b.{_q(key)}").alias(key), F.coalesce("a.path", "b.path").alias("path"), "before", "after")
    return got.where(~F.col("before").eqNullSafe(F.col("after")))


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def merged(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Leaves of the target with the source laid over it: objects are merged, anything else of the source takes the place of what the target has there.

    An empty object of the source leaves an object of the target as it is. All leaves of a key pass through one task, in order and not gathered; documents with a null key pass as one,
    and where their leaves contradict each other it isn't said which of them count.
    """
    sides = [d.select(F.col(key).alias("key"), "path", "value", F.lit(laid).alias("laid")) for d, laid in ((target, False), (source, True))]
    # in order, what is under a path comes right behind it, and at one path the source's leaf before the target's
    order = Window.partitionBy("key").orderBy("path", F.desc("laid"))
    behind = "lead(CASE WHEN {} THEN named_struct('path', path, 'bare', value = '{{}}') END) IGNORE NULLS OVER (PARTITION BY key ORDER BY path, laid DESC)"
    rows = sides[0].unionByName(sides[1]).select("*", F.expr(behind.format("NOT laid")).alias("own"), F.expr(behind.format("laid")).alias("over"))
    below = lambda path, top: F.coalesce(F.slice(path, F.lit(1), F.array_size(top)) == top, F.lit(False))
    # an empty object of the source says nothing where the target has an object, with members or without
    object_ = below(F.col("own.path"), F.col("path")) & ((F.array_size("own.path") > F.size("path")) | F.col("own.bare"))
    says = F.col("laid") & ((F.col("value") != "{}") | ~object_)
    rows = rows.withColumn("says", says).withColumn("above", F.last(F.when(F.col("says"), F.col("path")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # leaves of the target go under a leaf of the source, and where the source has an object with members
    gone = below(F.col("path"), F.col("above")) | below(F.col("over.path"), F.col("path"))
    return rows.where(F.col("says") | ~(F.col("laid") | gone)).select(F.col("key").alias(key), "path", "value")


def texts(rows: DataFrame, key: str) -> DataFrame:
    """key and text: documents written again from their leaves, in canonical form. One with no leaf has no row."""
    rows = written(rows.select(F.col(key).alias("key"), "path", "value"))
    deepest = rows.agg(F.coalesce(F.max(F.size("path")), F.lit(0))).first()[0]
    built = rows.where(F.size("path") == deepest)
    for depth in range(deepest, 0, -1):
        member = F.struct(F.element_at("path", -1).alias("name"), F.col("value"))
        objects = built.groupBy("key", F.slice("path", F.lit(1), F.lit(depth - 1)).alias("path")).agg(F.collect_list(member).alias("m"))
        value = F.to_json(F.to_variant_object(F.transform_values(F.map_from_entries("m"), lambda _, v: F.parse_json(v))))
        built = objects.select("key", "path", value.alias("value")).unionByName(rows.where(F.size("path") == depth - 1))
    return built.where(F.size("path") == 0).select(F.col("key").alias(key), F.col("value").alias("text"))


def secret_paths(rows: DataFrame, key: str) -> DataFrame:
    """key and path of the leaves whose name or value tells a secret; values are never given."""
    named = F.element_at("path", -1).rlike(R.SECRET_NAME) & ~F.col("value").isin("null", '""', "false", "{}")
    return rows.where(named | F.exists("strings", R.looks_secret)).select(key, "path")
