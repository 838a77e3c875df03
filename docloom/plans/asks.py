"""Queries over chunks of documents and questions to them. They have no SQL, as chunks are packed greedily; tests hold them against plain versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunks, questions
from ..sources.tables import table


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each document, with a hash of their text and the request that takes them, of 2,000 estimated tokens at most."""
    found = chunks.chunks_of(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    each = F.struct("place", "start", "stop", F.sha2("text", 256).alias("text_sha"), X.estimated_tokens(F.col("text")).alias("size"))
    d = found.groupBy("doc_id", "row_id").agg(F.array_sort(F.collect_list(each)).alias("c"))
    d = d.withColumn("pack", chunks.packs_of(F.transform("c", lambda c: c["size"]), 2000))
    return d.select("doc_id", F.explode(F.arrays_zip("c", "pack")).alias("z")).select("doc_id", "z.c.place", "z.c.start", "z.c.stop", "z.c.text_sha", "z.pack")


def deep_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as questions, each over its share of all documents: tier and turn of each chunk that is taken."""
    items = table(spark, sf_dir, "benchmark").where("item_id IS NOT NULL")
    asked = items.select(F.col("item_id").alias("question"), "text", F.reverse("text").alias("selection"))
    count = items.agg((F.max("item_id") + 1).alias("m"))  # one row
    docs = table(spark, sf_dir, "documents").join(F.broadcast(count)).select(F.pmod("doc_id", "m").alias("question"), F.col("doc_id").alias("source"), "text")
    return questions.chunk_priority(asked, docs)


QUERIES = {f.__name__: f for f in (document_chunks, deep_questions)}
ORACLE_SQL: dict[str, str] = {}
