"""Queries over documents, on small tables of their own."""

from docloom.plans import registry


def documents(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_related_by_words_far_down(spark, tmp_path):
    tails = {0: "zebra quagga", 7: "zebra quagga", 100: "harbour crane", 201: "harbour crane", 250: "alone"}
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(120)) + f" {t}" * 20, "en", "s", None) for i, t in tails.items()]
    assert all(r[1].index(tails[r[0]]) > 300 for r in rows)
    got = registry.QUERIES["related_to_each"](spark, documents(spark, tmp_path, rows)).collect()
    assert {(r.query_id, r.doc_id, r["rank"]) for r in got} == {(0, 7, 1), (100, 201, 1)}
    assert [r.doc_id for r in registry.QUERIES["related_documents"](spark, str(tmp_path)).collect()] == [7]


def test_numbers_within_a_tenth_of_another_source(spark, tmp_path):
    rows = [(1, "we state 100 and 5000", "en", "a", None), (2, "they state 102 and 90.5, or 4", "en", "b", None), (3, "and 7000", "en", "c", None), (4, "also 7100 here", "en", "c", None), (5, None, "en", "d", None)]
    got = {r.source: r.n_own for r in registry.QUERIES["new_numbers"](spark, documents(spark, tmp_path, rows)).collect()}
    assert got == {"a": 1, "c": 2}  # 100 and 102 are near each other, and 90.5 is within a tenth of 100


def test_lines_of_most_paragraphs_go(spark, tmp_path):
    rows = [(1, "head\nbody one\nhead\nhead", "en", "a", None), (2, "head\nhead\nother", "en", "a", None), (3, None, "en", "b", None), (4, "", "en", "b", None)]
    got = {r.doc_id: (r.n_left, r.n_removed) for r in registry.QUERIES["repeated_lines"](spark, documents(spark, tmp_path, rows)).collect()}
    assert got == {1: (1, 3), 2: (3, 0)}
