"""Blocks of texts and pages as tables: extraction, the text for a prompt, characters, a cap, and checks.

Nulls and edge cases: a null text has no blocks and an empty prompt text; repeated rows give repeated blocks; an empty table gives an empty result. The key column may have any
name but those that a function adds, which is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import blocks as B

# Fixed value: characters of blocks that are kept of a document.
MOST_CHARS = 400_000
PARSERS = {"text": B.text_blocks, "markdown": B.markdown_blocks, "html": B.html_blocks}


def blocks_of(text: Column, kind: str) -> Column:
    """Blocks of a text as an array; kind is text, markdown or html. The parser runs once for each row, in a task of the row's partition."""
    return F.udf(PARSERS[kind], B.BLOCK_TYPE)(text)


def prompt_of(blocks: Column) -> Column:
    return F.udf(B.prompt_text, "string")(blocks)


def _fresh(df: DataFrame, *names: str) -> None:
    if clash := sorted(set(names) & set(df.columns)):
        raise ValueError(f"columns {clash} of the input would be lost")


def exploded(df: DataFrame, key: str, blocks: Column) -> DataFrame:
    """key, place (from 0) and the block's fields; chars is the length of its text or cells."""
    _fresh(df.select(key), "place", "kind", "level", "ordered", "text", "cells", "parent", "chars")
    rows = df.select(key, F.posexplode(blocks).alias("place", "b")).select(key, "place", "b.*")
    return rows.withColumn("chars", F.length("text") + F.coalesce(F.aggregate("cells", F.lit(0), lambda a, c: a + F.length(c)), F.lit(0)))


def capped(blocks: DataFrame, key: str, most: int = MOST_CHARS) -> DataFrame:
    """Blocks of each key while `most` characters aren't used up, with used; the block that goes beyond is cut to what is left, and a first block stays.

    A window holds the blocks of one text, which one row held before.
    """
    _fresh(blocks, "used")
    before = F.coalesce(F.sum("chars").over(Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = blocks.withColumn("used", before).where((F.col("used") < most) | (F.col("place") == 0))
    return kept.withColumn("text", F.when(F.col("cells").isNull(), F.substr("text", F.lit(1), (F.lit(most) - F.col("used")).cast("int"))).otherwise(F.col("text")))


def violations(blocks: DataFrame, key: str) -> DataFrame:
    """key, place and rule of blocks that break one: control-character, empty, level (a heading beyond 6, an item not one below its parent), parent (not an earlier item)."""
    above = blocks.where("kind = 'item'").select(F.col(key).alias("of"), F.col("place").alias("above"), F.col("level").alias("upper"))
    rows = blocks.join(above, (F.col(key) == F.col("of")) & (F.col("parent") == F.col("above")), "left")
    item = F.col("kind") == "item"
    rules = F.array(
        F.when(F.col("text").rlike(r"[\x00-\x08\x0b-\x1f\x7f-\x9f]"), "control-character"), F.when((F.col("chars") == 0) & ~item & F.col("cells").isNull(), "empty"),
        F.when(((F.col("kind") == "heading") & ~F.col("level").between(1, 6)) | (item & (F.col("level") != F.coalesce(F.col("upper"), F.lit(0)) + 1)), "level"),
        F.when(F.col("parent").isNotNull() & (F.col("above").isNull() | (F.col("parent") >= F.col("place"))), "parent"),
    )
    return rows.select(key, "place", F.explode(F.array_compact(rules)).alias("rule"))
