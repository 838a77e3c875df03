"""Running sums in a total order, without bringing a table or a group to one task.

Nulls and edge cases: null values add nothing; an order column that is null comes first; the order must be total, as rows that tie share no defined
place; an empty table gives an empty result; names of added columns that the input has are an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written


def grouped_running(df: DataFrame, keys: list[str], order: list[str], values: dict[str, str]) -> DataFrame:
    """df with a column for each of values (name: column) that sums it over all rows of its keys up to this one in the given order.

    Rows are dealt by ranges of keys and order, so a hot key is spread over several; each range sums its own rows of a key, and what the ranges before it
    sum to is added from a table with a row for each key and range.
    """
    if clash := sorted(set(values) & set(df.columns)):
        raise ValueError(f"columns {clash} of the input would be lost")
    rows = df.select(F.struct("*").alias("row"), *[F.col(c) for c in dict.fromkeys([*keys, *order])], *[F.col(c).alias(f"value {n}") for n, c in values.items()])
    dealt = written(rows.repartitionByRange(*[F.col(c) for c in dict.fromkeys([*keys, *order])]).withColumn("range", F.spark_partition_id()))
    upto = Window.partitionBy("range", *[f"row.{k}" for k in keys]).orderBy(*[f"row.{c}" for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    within = dealt.select("row", "range", *[F.sum(f"value {n}").over(upto).alias(n) for n in values])
    sums = dealt.groupBy("range", *[F.col(f"row.{k}").alias(f"key {k}") for k in keys]).agg(*[F.sum(f"value {n}").alias(n) for n in values])
    before = Window.partitionBy(*[f"key {k}" for k in keys]).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each key and range
    bases = sums.select(F.col("range").alias("at"), *[f"key {k}" for k in keys], *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"base {n}") for n in values])
    same = F.col("range") == F.col("at")
    for k in keys:
        same = same & F.col(f"row.{k}").eqNullSafe(F.col(f"key {k}"))
    return within.join(bases, same).select("row.*", *[(F.coalesce(F.col(n), F.lit(0)) + F.col(f"base {n}")).alias(n) for n in values])


def running_sum(df: DataFrame, order: list[str], values: dict[str, str]) -> DataFrame:
    """As grouped_running(), over the whole table."""
    return grouped_running(df, [], order, values)


def carried(df: DataFrame, keys: list[str], order: list[str], values: dict[str, str], back: bool = False) -> DataFrame:
    """df with a column for each of values (name: column) that has the last value that isn't null among the rows of its keys up to this one (back: from this one on).

    As in grouped_running(), a hot key is spread over several ranges, and a table with a row for each key and range carries what the ranges before it end with.
    """
    if clash := sorted(set(values) & set(df.columns)):
        raise ValueError(f"columns {clash} of the input would be lost")
    by = list(dict.fromkeys([*keys, *order]))
    rows = df.select(F.struct("*").alias("row"), *[F.col(c) for c in by], *[F.col(c).alias(f"value {n}") for n, c in values.items()])
    dealt = written(rows.repartitionByRange(*[F.col(c) for c in by]).withColumn("range", F.spark_partition_id()))
    span = (0, Window.unboundedFollowing) if back else (Window.unboundedPreceding, 0)
    pick = F.first if back else F.last
    upto = Window.partitionBy("range", *[f"row.{k}" for k in keys]).orderBy(*[f"row.{c}" for c in order]).rowsBetween(*span)
    within = dealt.select("row", "range", *[pick(f"value {n}", ignorenulls=True).over(upto).alias(n) for n in values])
    place = F.struct(*[F.col(f"row.{c}") for c in order])
    ends = dealt.groupBy("range", *[F.col(f"row.{k}").alias(f"key {k}") for k in keys]).agg(
        *[(F.min_by if back else F.max_by)(f"value {n}", F.when(F.col(f"value {n}").isNotNull(), place)).alias(n) for n in values]
    )
    others = (1, Window.unboundedFollowing) if back else (Window.unboundedPreceding, -1)
    before = Window.partitionBy(*[f"key {k}" for k in keys]).orderBy("range").rowsBetween(*others)  # a row for each key and range
    bases = ends.select(F.col("range").alias("at"), *[f"key {k}" for k in keys], *[pick(n, ignorenulls=True).over(before).alias(f"base {n}") for n in values])
    same = F.col("range") == F.col("at")
    for k in keys:
        same = same & F.col(f"row.{k}").eqNullSafe(F.col(f"key {k}"))
    return within.join(bases, same).select("row.*", *[F.coalesce(F.col(n), F.col(f"base {n}")).alias(n) for n in values])
