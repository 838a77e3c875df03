"""Shaping of category and series tables for charts: long rows (category, position, series, value).

Nulls are skipped by sums and means, and a sum of nulls alone stays null; ties go by position, then category; an empty table gives no rows; other columns are left out or kept as the
function says, and none is added to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: a chart keeps so many categories beside the one that takes the rest.
KEEP_CATEGORIES = 29


def merge_categories(rows: DataFrame, keys: list[str], value: str = "value", keep_first: bool = False, position: str = "position") -> DataFrame:
    """One row for equal keys: values are summed, or the first that isn't null by position is kept; position is the least."""
    first = F.min_by(value, F.when(F.col(value).isNotNull(), F.col(position)))
    return rows.groupBy(*keys).agg((first if keep_first else F.sum(value)).alias(value), F.min(position).alias(position))


def fold_categories(rows: DataFrame, keep: int = KEEP_CATEGORIES, other: str = "Other") -> DataFrame:
    """category, position and value: the keep greatest stay in their order, the rest are summed as other, which comes last."""
    # A tie at the last place kept goes by position, category and value; rows equal in all of these are alike, so it doesn't matter which of them stay.
    order = [F.desc_nulls_last("value"), F.asc("position"), F.asc("category")]
    kept = rows.select("category", "position", "value").orderBy(*order).limit(keep)
    taken = kept.groupBy(*[F.col(c).alias(f"{c} kept") for c in ("category", "position", "value")]).agg(F.count("*").alias("n"))  # `keep` rows at most
    same = F.col("category").eqNullSafe(F.col("category kept")) & F.col("position").eqNullSafe(F.col("position kept")) & F.col("value").eqNullSafe(F.col("value kept"))
    alike = rows.groupBy("category", "position", "value").agg(F.count("*").alias("times"))
    left = alike.join(F.broadcast(taken), same, "left").withColumn("times", F.col("times") - F.coalesce("n", F.lit(0))).where("times > 0")
    rest = left.agg(F.sum(F.col("value") * F.col("times")).alias("value"), F.sum("times").alias("times")).where("times > 0")
    return kept.select("category", "value", "position").unionByName(rest.select(F.lit(other).alias("category"), F.col("value").cast(rows.schema["value"].dataType).alias("value"), F.lit(2**31 - 1).cast(rows.schema["position"].dataType).alias("position")))


def cap_series(rows: DataFrame, keep: int = 4) -> DataFrame:
    """Rows of the series with the greatest mean of absolute values, so many of them."""
    mean = rows.groupBy("series").agg(F.avg(F.abs("value")).alias("mean_abs"))
    best = mean.orderBy(F.desc_nulls_last("mean_abs"), "series").limit(keep)
    return rows.join(best.select("series"), "series", "left_semi")


def pipe_table(rows: DataFrame, group: str, columns: list[str], order: list[str]) -> DataFrame:
    """A Markdown pipe table of each group's rows in order, as one text."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.col(c).cast("string") for c in columns]), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n|" + " --- |" * len(columns)
    ordered = F.sort_array(F.collect_list(F.struct(*order, line.alias("line"))))
    return rows.groupBy(group).agg(F.concat(F.lit(head + "\n"), F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")).alias("markdown"))
