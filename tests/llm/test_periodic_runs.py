"""Runs of words against a scan of every lag."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from docloom.llm import periodic_runs, queries


def plain_runs(words):
    """(start, length, period) by start and period: every lag, one after the other; the first that finds a stretch has its smallest period."""
    known = {}
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.array([number[w] for w in words])
    for q in range(1, len(words) // 4 + 1):
        same = np.concatenate([[0], (ids[q:] == ids[:-q]).astype(int), [0]])
        begin, end = np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1)
        for s, e in zip(begin.tolist(), end.tolist()):
            if e - s + q >= max(6, 4 * q):
                known.setdefault((s, e + q), q)
    return sorted((s, e - s, q) for (s, e), q in known.items())


def plain_row(doc_id, text):
    words = (text or "").encode("utf-8", "surrogatepass").split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = plain_runs(words)
    dropped = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(((-m, s, q) for s, m, q in found), default=None)
    numbers = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    left = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (len(found), *numbers, hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest(), hashlib.sha256(left).hexdigest())


def row_of(r):
    return (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: row_of(r) for r in queries.op13_periodic_runs(spark, sf_dir).collect()}
    assert got == {i: plain_row(i, t) for i, t in texts.items()}
    assert sum(r[0] > 0 for r in got.values()) >= 0.05 * len(got)  # the planted ones at least


def test_runs_of_made_up_texts():
    rng = random.Random(13)
    for _ in range(600):
        texts = []
        for _ in range(rng.randint(1, 5)):
            words, size = [], rng.choice([0, 5, 30, 150, 400])
            while len(words) < size:
                if rng.random() < 0.5:
                    words += [rng.choice("abcde"[: rng.randint(1, 5)]) for _ in range(rng.randint(1, 9))]
                else:
                    words += ([rng.choice("abcdefgh") for _ in range(rng.randint(1, 30))] * rng.randint(1, 7))[: rng.randint(1, 150)]
            texts.append(" ".join(words))
        found = periodic_runs._compute(texts)
        for text, runs in zip(texts, found["runs"]):
            assert [(r["start"], r["length"], r["period"]) for r in runs] == plain_runs(text.split())


@pytest.mark.parametrize("unit", [["a"], ["a", "b"], ["a"] * 999 + ["b"], [str(i) for i in range(40_000)]])
def test_long_runs_take_little(unit):
    words = (unit * (200_000 // len(unit) + 1))[:200_000]
    (runs,) = periodic_runs._compute([" ".join(words)])["runs"]
    assert (0, 200_000, len(unit)) in [(r["start"], r["length"], r["period"]) for r in runs]


def test_odd_rows(spark):
    rows = [(None, "a a a a a a a", 1, 2), (1, None, 1, 2), (1, None, 1, 2), (2, "", 1, 2), (3, " \n ", 1, 2), (4, "x\x1cy " * 8, 1, 2), (5, "A a A a A a A a", 1, 2), (6, "z" * 100_000, 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _words int, `od``d` int")
    got = periodic_runs.runs(periodic_runs.with_planted_repeats(docs)).collect()
    assert len(got) == len(rows) and all(set(r.row.asDict()) == {"doc_id", "text", "_words", "od`d"} for r in got)
    by_id = {r.doc_id: [tuple(x) for x in r.runs] for r in got}
    assert by_id[None] == [(0, 7, 1)] and by_id[5] == [(0, 8, 2)] and by_id[1] == by_id[2] == by_id[3] == by_id[6] == []
    assert by_id[4] == [(0, 8, 1)]
    assert periodic_runs.runs(periodic_runs.with_planted_repeats(docs.limit(0))).count() == 0
