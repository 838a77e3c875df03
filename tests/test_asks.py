"""Chunks, packs and the order of chunks for a question against plain versions."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docloom.functions import rules as R
from docloom.operators import chunks, questions


def chunked(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc long, text string")
    found = {i: [] for i in range(len(texts))}
    for r in chunks.chunks_of(docs, ["doc"]).collect():
        found[r.doc].append((r.place, r.start, r.stop, r.heading, r.text))
    return [sorted(found[i]) for i in range(len(texts))]


def test_chunks_keep_every_character_that_is_not_blank(spark):
    rnd = random.Random(5)
    parts = ["# Head", "plain line.", "", "```", "| a | b |", "word " * 200, "x" * 3500, "Ends. " * 700, "--- Page 3 ---", "   ", "あ。" * 900, "| c"]
    texts = ["\n".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(300)]
    for text, got in zip(texts, chunked(spark, texts)):
        assert [g[0] for g in got] == list(range(len(got)))
        upto = 0
        for k, (_, start, stop, heading, piece) in enumerate(got):
            assert start >= upto and not text[upto:start].strip() and piece == text[start:stop] and 0 < len(piece) <= chunks.MOST
            if k and not piece.startswith(("# Head", "--- Page 3 ---")):  # a chunk that no section begins was begun as its first line didn't fit
                assert start + len(piece.split("\n")[0]) - got[k - 1][1] > chunks.TARGET or piece.startswith(("```", "|")) or stop - start > chunks.TARGET
            upto = stop
        assert not text[upto:].strip()


def test_chunks_of_given_texts(spark):
    given = ["# A\none\n## B\ntwo\n```\n# no\n```", "a" * 1000 + "\n" + "b" * 600 + "\nc", None, " \n ", "", "```\n" + "| x |\n" * 10 + "```", "# H\n" + "d" * 3001, "One. " * 400 + "e" * 2900 + "\n# Z"]
    got = chunked(spark, given)
    assert [(g[3], g[4]) for g in got[0]] == [("A", "# A\none"), ("B", "## B\ntwo\n```\n# no\n```")]
    assert [g[4] for g in got[1]] == ["a" * 1000, "b" * 600 + "\nc"]
    assert got[2] == got[3] == got[4] == [] and [g[4] for g in got[5]] == [given[5]]
    assert [(g[3], len(g[4])) for g in got[6]] == [("H", 3), ("H", 3000), ("H", 1)]
    assert [(g[1], g[3]) for g in got[7]] == [(0, None), (1999, None), (given[7].index("\n") + 1, "Z")]
    with pytest.raises(ValueError):
        chunks.chunks_of(spark.createDataFrame([(1, "a")], "place int, text string"), ["place"])
    twice = spark.createDataFrame([(1, "a"), (1, "a")], "doc int, text string")
    assert [tuple(r)[:1] + tuple(r)[2:] for r in chunks.chunks_of(twice, ["doc"]).collect()] == [(1, 0, 0, 1, None, "a")] * 2


def test_packs(spark):
    rows = spark.createDataFrame([([5, 5, 1, 20, 3, 7],), ([],)], "s array<int>")
    assert [r[0] for r in rows.select(chunks.packs_of(F.col("s"), 10)).collect()] == [[0, 0, 1, 2, 3, 3], []]


def test_priority_against_a_plain_version(spark):
    rnd = random.Random(8)
    vocab = [f"w{a}{b}" for a in "abcdefgh" for b in "xyz"]
    asked = [(q, " ".join(rnd.choices(vocab, k=4)), " ".join(rnd.choices(vocab, k=60))) for q in range(4)] + [(4, "nothing here", None), (5, None, None)]
    kept = [(q, s, "\n".join(("# H\n" if rnd.random() < 0.4 else "") + " ".join(rnd.choices(vocab, k=rnd.randint(1, 30))) for _ in range(rnd.randint(1, 9)))) for q in range(6) for s in range(3)] + [(0, 9, None), (0, 10, "")]
    of = {k: c for k, c in zip([(q, s) for q, s, _ in kept], chunked(spark, [t for *_, t in kept]))}
    tokens = {r.t: r.x for r in spark.createDataFrame([(t,) for _, a, b in asked for t in (a, b) if t] + [(c[4],) for found in of.values() for c in found], "t string").select("t", R.retrieval_tokens(F.col("t")).alias("x")).collect()}
    want = {}
    for q, text, selection in asked:
        parts = [(s, c[0], tokens[c[4]]) for qq, s, _ in kept if qq == q for c in of[qq, s]]
        n, df = len(parts), Counter(w for *_, t in parts for w in set(t))
        idf = lambda w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))  # noqa: E731, B023
        chosen = list(dict.fromkeys(tokens.get(selection, [])))
        query = tokens.get(text, []) * 2 + sorted(chosen, key=lambda w: (-idf(w), chosen.index(w)))[:40]
        mean = sum(len(t) for *_, t in parts) / n
        scores = {(s, i): round(sum(idf(w) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / mean)) for w in query if w in t), 9) for s, i, t in parts}
        ranked = sorted((k for k in scores if scores[k] > 0), key=lambda k: (-scores[k], k))
        line = ranked[:3] + [(s, i + d) for s, i in ranked[:3] for d in (-1, 1)] + [(s, 0) for s in sorted({s for s, *_ in parts})] + ranked + ([] if ranked else sorted(scores))
        for turn, k in enumerate(dict.fromkeys(k for k in line if k in scores), 1):
            want[q, *k] = turn
    got = questions.chunk_priority(spark.createDataFrame(asked, "question long, text string, selection string"), spark.createDataFrame(kept, "question long, source long, text string"))
    assert {(r.question, r.source, r.place): r.turn for r in got.collect()} == want


def test_only_terms_that_are_asked_for_are_kept(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(questions, "written", lambda df: tables.append(df) or df)
    asked = spark.createDataFrame([(1, "alpha beta", "gamma"), (2, None, None)], "question long, text string, selection string")
    kept = spark.createDataFrame([(1, 1, "alpha delta delta gamma alpha"), (2, 1, "alpha beta"), (3, 1, "alpha")], "question long, source long, text string")
    questions.chunk_priority(asked, kept)
    got = {(r.question, r.len): sorted(r.t) for r in tables[-1].collect()}
    assert got == {(1, 5): ["alpha", "alpha", "gamma"], (2, 2): [], (3, 1): []}
