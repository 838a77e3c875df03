"""Operators over the lines of texts.

Nulls and edge cases: a null line is a line like any other and equal to other nulls; a null group is a group of its own; repeated rows count once for each
slide; an empty table gives an empty result. Other columns go through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A line on over this share of the slides, and on so many at least, is a header or a footer.
SHARE, LEAST = 0.6, 3


def without_repeated(lines: DataFrame, group: str, slide: str, line: str, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """Rows whose line doesn't stand on over `share` of their group's slides and on `least` of them at least."""
    slides = lines.groupBy(F.col(group).alias("of"), F.col(line).alias("repeated")).agg(F.count_distinct(slide).alias("on"))
    total = lines.groupBy(F.col(group).alias("group")).agg(F.count_distinct(slide).alias("slides"))
    many = slides.where(F.col("on") >= least).join(total, F.col("of").eqNullSafe(F.col("group"))).where(F.col("on") > share * F.col("slides")).select("of", "repeated")
    return lines.join(many, lines[group].eqNullSafe(F.col("of")) & lines[line].eqNullSafe(F.col("repeated")), "left_anti")
