"""Each stage of the pipeline against a plain version, over a small table, and whole runs over odd rows."""

import hashlib

import corpus_pipeline
import test_operators as plain
from pyspark.sql import functions as F

from docloom.llm import pii, quality_rules


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = corpus_pipeline.rules(spark, docs, sf_dir).cache()
    assert kept.columns == columns
    verdict = {r.doc_id: r.kept for r in quality_rules.judge(docs, quality_rules.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, k in verdict.items() if k}

    unique = corpus_pipeline.near_duplicates(spark, kept, sf_dir).cache()
    prints = {r.doc_id: plain.plain_fingerprint(r.text) for r in kept.collect()}
    assert unique.columns == columns and {r.doc_id for r in unique.collect()} == set(plain.plain_components(prints).values())

    clean = corpus_pipeline.clean_of_benchmark(spark, unique, sf_dir).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    bad = {r[0] for r in plain.plain_contamination([(r.doc_id, r.text) for r in unique.collect()], items) if r[-1]}
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in unique.collect()} - bad

    safe = corpus_pipeline.without_pii(spark, clean, sf_dir).cache()
    before = {r.doc_id: r.text for r in clean.collect()}
    assert safe.columns == columns
    for r in safe.collect():
        assert r.n_chars == len(r.text) and not plain.plain_pii(r.text)
        if not plain.plain_pii(before[r.doc_id]) and "<" not in r.text:
            assert r.text == before[r.doc_id]

    last = corpus_pipeline.tokens(spark, safe, sf_dir).collect()
    text = {r.doc_id: r.text for r in safe.collect()}
    assert {r.doc_id: r.decoded_sha256 for r in last} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in text.items()}
    assert len(corpus_pipeline.run(spark, sf_dir).collect()) == len(last)


def test_odd_rows(spark, sf_dir):
    rows = [(i, t, "en", s, None, 1, 2.0) for i, t, s in plain.ODD]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row int, kept double")
    last = corpus_pipeline.tokens(spark, docs, sf_dir)
    assert last.count() == len(rows) and last.columns == ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"] and last.where("n_tokens = 0").count() == 3
    assert corpus_pipeline.tokens(spark, docs.limit(0), sf_dir).count() == 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    one = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert one.where("text = 'same text of five words'").count() == 1 and one.where(F.coalesce(F.trim("text"), F.lit("")) == "").count() >= 1
    assert corpus_pipeline.without_pii(spark, docs, sf_dir).where(F.col("text").contains("<CARD>")).count() == 1
    assert pii.find(docs).count() == len(rows)
