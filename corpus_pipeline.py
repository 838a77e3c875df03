"""A corpus pipeline in five stages; each takes the documents that the one before kept and returns documents with the same columns, but the last, which
returns their tokens.

Edge cases: nulls, empty texts and repeated rows go through as the operators' docstrings say; an empty table gives empty stages. Columns beyond
those of documents go through too. A stage's own columns stay inside it, so names can't clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe, decontaminate, pii, quality_rules, simhash_dedup
from docloom.llm.common import drop, scratch, table, written
from docloom.llm.queries import tokenizer_path


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the line model learns from the labels of documents that are not held out."""
    judged = quality_rules.judge(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))
    return judged.where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the least doc_id."""
    prints = simhash_dedup.fingerprints(docs, keep_rows=True)
    found = simhash_dedup.near_duplicates(prints.drop("row"))
    gone = found.where(~F.col("representative")).select("uid")
    return prints.join(gone, "uid", "left_anti").select("row.*")


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), keep_rows=True)
    return found.where(~F.col("contaminated")).select("row.*")


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows the new text."""
    found = pii.find(docs)
    text = pii.redacted(F.col("text"), F.col("spans"))
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("text", "n_chars")]
    out = found.select(*kept, F.when(F.col("row.text").isNotNull(), text).alias("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (little-endian 32-bit), n_tokens, ids_sha256 and decoded_sha256 of every document."""
    found = bpe.encode(docs, tokenizer_path("byte_bpe_50k.json"))
    return found.select("doc_id", "ids", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality_rules", rules), ("near_duplicates", near_duplicates), ("decontaminate", clean_of_benchmark), ("pii", without_pii), ("bpe", tokens)]

#: SQL can't express the line model and the merges; the tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; the last is left to the caller to write.

    A stage's own tables, and the documents that it took, are deleted once its documents are written.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            before, docs = docs, written(stage(spark, docs, sf_dir), name, keep=True)
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
