"""Queries over sentences, style and blocks, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lint as L
from ..operators import blocks
from ..sources.tables import table


def style_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of each document (a line is a passage, a numbered one a step), those that fail the style rules, their share, and findings by rule."""
    d = table(spark, sf_dir, "documents").select("doc_id", L.style_of(F.col("text")).alias("s"))
    n = lambda rule: F.size(F.filter("s", lambda x: x[rule])).cast("long")
    d = d.select("doc_id", F.size("s").cast("long").alias("n_sentences"), n("fails").alias("n_failing"), n("long").alias("n_long"), n("two").alias("n_two"), n("passive").alias("n_passive"))
    return d.withColumn("score", F.when(F.col("n_sentences") > 0, F.round(F.col("n_failing") / F.col("n_sentences"), 6)).otherwise(0.0))


def plain_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the plain-language rules in each document: sections, sentences, words a sentence, long sentences, long words and symbols by section."""
    d = table(spark, sf_dir, "documents").select("doc_id", L.plain_language_of(F.col("text")).alias("p"))
    total = lambda f: F.aggregate("p", F.lit(0), lambda a, x: a + f(x)).cast("long")
    d = d.select("doc_id", F.size("p").cast("long").alias("n_sections"), total(lambda x: x["n_sentences"]).alias("n_sentences"), total(lambda x: x["n_words"]).alias("n_words"), total(lambda x: x["n_long"]).alias("n_long"), total(lambda x: F.size(x["long_words"])).alias("n_long_words"), total(lambda x: x["symbol"].cast("int")).alias("n_symbols"))
    average = F.when(F.col("n_sentences") > 0, F.col("n_words") / F.col("n_sentences")).otherwise(0.0)
    return d.select("doc_id", "n_sections", "n_sentences", F.round(average, 6).alias("average_words"), (average > L.PLAIN_AVERAGE).alias("over_average"), "n_long", "n_long_words", "n_symbols")


def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of each page by kind: how many, their characters, and a hash of the page's prompt text."""
    p = table(spark, sf_dir, "pages").select("page_id", blocks.blocks_of(F.col("html"), "html").alias("b"))
    p = p.withColumn("prompt_sha", F.sha2(blocks.prompt_of(F.col("b")), 256))
    each = p.select("page_id", "prompt_sha", F.explode("b").alias("b"))
    chars = F.length("b.text") + F.coalesce(F.aggregate("b.cells", F.lit(0), lambda a, c: a + F.length(c)), F.lit(0))
    return each.groupBy("page_id", "prompt_sha", "b.kind").agg(F.count("*").alias("n"), F.sum(chars).alias("chars"))


def markdown_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of each document read as Markdown: how many of each kind, and a hash of its prompt text."""
    d = table(spark, sf_dir, "documents").select("doc_id", blocks.blocks_of(F.col("text"), "markdown").alias("b"))
    n = lambda kind: F.size(F.filter("b", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return d.select("doc_id", *map(n, ("heading", "paragraph", "quote", "code", "item", "row")), F.sha2(blocks.prompt_of(F.col("b")), 256).alias("prompt_sha"))


def capped_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What 2,000 characters of blocks keep of each document."""
    d = table(spark, sf_dir, "documents")
    kept = blocks.capped(blocks.exploded(d, "doc_id", blocks.blocks_of(F.col("text"), "text")), "doc_id", 2000)
    return kept.groupBy("doc_id").agg(F.count("*").alias("n_blocks"), F.sum(F.length("text")).alias("chars"))


def block_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of pages and documents that break a rule, by rule: none should."""
    of = lambda name, key, text, kind: blocks.violations(blocks.exploded(table(spark, sf_dir, name), key, blocks.blocks_of(F.col(text), kind)), key).select("rule", F.lit(name).alias("table_name"))
    return of("pages", "page_id", "html", "html").unionByName(of("documents", "doc_id", "text", "markdown")).groupBy("table_name", "rule").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (style_findings, plain_language, page_blocks, markdown_outlines, capped_blocks, block_violations)}
#: Emphasis, sentences and blocks take patterns that look ahead, and parsers; the tests hold these queries against plain versions.
ORACLE_SQL = {"block_violations": "SELECT '' AS table_name, '' AS rule, CAST(0 AS BIGINT) AS n WHERE false"}
