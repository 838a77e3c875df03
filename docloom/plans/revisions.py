"""Queries over revisions: documents with one opening are versions of one text, and each is compared with the one of least id. No SQL gives a longest common subsequence in reasonable
time; tests hold the queries against plain programs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import revisions
from ..sources.tables import table

#: Characters that versions of a text begin with.
OPENING = 40


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, base (the first document of the same opening), text and base_text of all documents but the first of each opening."""
    docs = table(spark, sf_dir, "documents").where(F.length("text") >= OPENING).select("doc_id", "text", F.substring("text", 1, OPENING).alias("opening"))
    first = docs.groupBy("opening").agg(F.min("doc_id").alias("base"), F.count("*").alias("n")).where("n > 1")
    bases = docs.select(F.col("doc_id").alias("base"), F.col("opening").alias("of"), F.col("text").alias("base_text")).join(first.withColumnRenamed("opening", "of"), ["of", "base"])
    return docs.join(bases, F.col("opening") == F.col("of")).where("doc_id <> base").select("doc_id", "base", "text", "base_text")


def revision_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike each later version and the first one are."""
    pairs = _versions(spark, sf_dir).select(F.struct("doc_id", "base").alias("key"), F.col("base_text").alias("old"), F.col("text").alias("new"))
    return revisions.similarity(pairs).select("key.doc_id", "key.base", F.round("similarity", 6).alias("similarity"))


def revision_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs that each later version has inserted. The first half of the first version counts as marked before, and its mark is carried over what stayed."""
    pairs = _versions(spark, sf_dir).select(F.col("doc_id").alias("key"), F.col("base_text").alias("old"), F.col("text").alias("new"))
    before = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.floor(F.length("old") / 2).alias("stop"), F.lit("earlier").alias("merge")))
    return revisions.insertions(pairs, "now", before).select(F.col("key").alias("doc_id"), "merge", "start", "stop")


def revised_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each line of a later version whether it stands in the first one, revises one of its lines, or is new."""
    found = revisions.line_origins(_versions(spark, sf_dir).select(F.col("doc_id").alias("key"), F.col("base_text").alias("old"), F.col("text").alias("new")))
    return found.select(F.col("key").alias("doc_id"), "place", "origin", "old_place", F.round("similarity", 6).alias("similarity"))


QUERIES = {f.__name__: f for f in (revision_similarity, revision_marks, revised_blocks)}
ORACLE_SQL: dict[str, str] = {}
