"""Catalog operators: duplicates, differences, kept sources, claims, histories and retention.

Nulls and edge cases: null keys are equal to each other and to nothing else; ties go by the order columns given, and where those tie too any of the equal
rows may stand for them; repeated rows are rows of their own; empty tables give empty results. Columns that an operator adds are named in its
docstring; one of the input with such a name is an error, and no other name can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import grouped_running


def _fresh(df: DataFrame, *names: str) -> None:
    if clash := sorted(set(names) & set(df.columns)):
        raise ValueError(f"columns {clash} of the input would be lost")


def first_of_each(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """Rows with first (whether it is the first of its key), n_copies and of (the first row's order column), by key; no row is dropped."""
    _fresh(df, "first", "n_copies", "of")
    rows = df.select(F.struct("*").alias("row"), key.alias("key"))
    heads = rows.groupBy("key").agg(F.min(F.struct(*[f"row.{c}" for c in order])).alias("head"), F.count("*").alias("n_copies"))
    heads = heads.select(F.col("key").alias("head_key"), "head", "n_copies")
    found = rows.join(heads, F.col("key").eqNullSafe(F.col("head_key")))
    return found.select("row.*", (F.struct(*[f"row.{c}" for c in order]).eqNullSafe(F.col("head"))).alias("first"), "n_copies", F.col(f"head.{order[0]}").alias("of"))


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is greatest by the order columns; partial maxima are combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("the row"))
    return best.select(*keys, "the row.*").select(*df.columns)


def catalog_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key and change: added, dropped or changed; equal rows are left out, and nulls are equal to nulls. A changed row also gives its old one, as replaced."""
    columns = [c for c in new.columns if c != key]
    a = old.select(F.col(key).alias("old_key"), F.struct(*columns).alias("old_row"))
    b = new.select(F.col(key).alias("new_key"), F.struct(*columns).alias("new_row"))
    same = F.col("old_row").eqNullSafe(F.col("new_row"))
    changes = F.when(F.col("old_row").isNull(), F.array(F.lit("added"))).when(F.col("new_row").isNull(), F.array(F.lit("dropped"))).when(~same, F.array(F.lit("changed"), F.lit("replaced")))
    found = a.join(b, F.col("old_key").eqNullSafe(F.col("new_key")), "full_outer")
    return found.select(F.coalesce("old_key", "new_key").alias(key), F.explode(changes).alias("change"))


def capped_history(df: DataFrame, key: str, order: str, size: str, max_rows: int, max_size: float) -> DataFrame:
    """Rows of each key, from the greatest `order` on, up to the first that goes beyond max_size in all or max_rows, with total, the size so far; the newest always stays.

    The newest max_rows of each key are found first, which Spark does before the shuffle too, so a window holds max_rows rows of a key and part.
    """
    _fresh(df, "total")
    in_order = Window.partitionBy(key).orderBy(F.desc(order))
    newest = df.select(F.struct("*").alias("row"), F.col(key), F.col(order), F.col(size)).withColumn("place", F.row_number().over(in_order)).where(F.col("place") <= max_rows)
    total = F.sum(size).over(Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return newest.withColumn("total", total).where((F.col("place") == 1) | (F.col("total") <= max_size)).select("row.*", "total")


def kept_sources(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """wanted with is_held: some held row has its kind and ref, and its hash (sha) too unless either is null.

    What is held is first one row for each kind and ref, with whether any hash is null, and one row for each kind, ref and hash: two equality joins.
    """
    _fresh(wanted, "is_held")
    refs = held.where("kind IS NOT NULL AND ref IS NOT NULL").groupBy(F.col("kind").alias("k"), F.col("ref").alias("r")).agg(F.bool_or(F.col("sha").isNull()).alias("open"))
    hashes = held.where("kind IS NOT NULL AND ref IS NOT NULL AND sha IS NOT NULL").select(F.col("kind").alias("hk"), F.col("ref").alias("hr"), F.col("sha").alias("hs")).distinct().withColumn("hit", F.lit(True))
    rows = wanted.select(F.struct("*").alias("row"), "kind", "ref", "sha")
    found = rows.join(refs, (F.col("kind") == F.col("k")) & (F.col("ref") == F.col("r")), "left").join(hashes, (F.col("kind") == F.col("hk")) & (F.col("ref") == F.col("hr")) & (F.col("sha") == F.col("hs")), "left")
    any_ref = F.col("open").isNotNull()
    return found.select("row.*", (any_ref & (F.col("open") | F.col("sha").isNull() | F.col("hit").isNotNull())).alias("is_held"))


def medians(df: DataFrame, key: str, value: str) -> DataFrame:
    """key and median (that of an even number is the mean of the two in the middle); null values don't count.

    Values are counted first, and the counts of each key are summed in ranges of the values, so no task holds the values of a key.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    upto = grouped_running(counts, ["k"], ["v"], {"upto": "n"})
    total = counts.groupBy(F.col("k").alias("of")).agg(F.sum("n").alias("total"))
    found = upto.join(total, F.col("k").eqNullSafe(F.col("of")))
    first, last = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1
    low, high = F.col("upto") - F.col("n") + 1, F.col("upto")
    middle = found.where(first.between(low, high) | last.between(low, high))
    return middle.groupBy(F.col("k").alias(key)).agg(((F.min("v") + F.max("v")) / 2).alias("median"))
