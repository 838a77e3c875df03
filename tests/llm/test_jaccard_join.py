"""The Jaccard join against all pairs."""

import random
from itertools import combinations

import numpy as np
import pytest

from docloom.llm import jaccard_join, queries


def plain_set(text):
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)] if w else [])


def plain_links(sets):
    return {(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * (o := len(sets[a] & sets[b])) >= 90 * (len(sets[a]) + len(sets[b]) - o)}


def plain_components(sets, links):
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {i: (len(s), top(i)) for i, s in sets.items()}


def test_query(spark, sf_dir):
    sets = {r.doc_id: plain_set(r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op12_jaccard_join(spark, sf_dir).collect()}
    assert got == plain_components(sets, plain_links(sets))


@pytest.fixture(scope="module")
def made():
    """Copies with words changed, chains, a passage that many share, and short texts."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(6):
        base = [word() for _ in range(rng.choice([12, 40, 90, 150]))]
        texts.append(base)
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = word()
            texts.append(copy)
        chain = base
        for _ in range(6):
            chain = chain + [word()] * rng.choice([1, 2])
            texts.append(chain)
    texts += [passage + [word() for _ in range(rng.choice([0, 1, 3, 8]))] for _ in range(40)]
    texts += [[word() for _ in range(rng.choice([1, 2, 3, 4]))] for _ in range(10)] + [["a"], ["A"], ["a", "b"], ["a", "b", "c"], [], []]
    rng.shuffle(texts)
    return {i: " ".join(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("bits", [4, 20])  # with 16 counters the order is hardly by rarity
def test_made_texts(spark, made, bits):
    sets = {i: plain_set(t) for i, t in made.items()}
    docs = spark.createDataFrame(list(made.items()), "doc_id long, text string").repartition(7)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs, bits=bits).collect()}
    want = plain_links(sets)
    assert got == plain_components(sets, want)
    linked, members = jaccard_join.pairs(docs, bits=bits)
    of = {r.doc_id: r.class_doc_id for r in members.collect()}
    assert {tuple(sorted(r)) for r in linked.collect()} == {tuple(sorted((of[a], of[b]))) for a, b in want if sets[a] != sets[b]}
    assert all(sets[a] == sets[b] for a, b in of.items())


def test_longer_prefixes_where_many_hold_the_first():
    bounds = np.array([0, 100, 200])
    rare, common = np.ones(100, np.uint32), np.full(100, 5000, np.uint32)
    asked, length = jaccard_join.prefix_lengths(np.concatenate([rare, common]), bounds, 0.0)
    assert asked[0] == 1 and length[0] == 11
    assert asked[1] > 1 and length[1] == 11 + asked[1] - 1


def test_odd_rows(spark):
    rows = [(None, "a b c d", 1, 1), (None, None, 1, 1), (1, None, 1, 1), (2, " \n ", 1, 1), (3, "A  b\tc D", 1, 1), (4, "a b c d", 1, 1), (4, "a b c d", 1, 1), (5, "x " * 50_000, 1, 1), (6, "x x x", 1, 1), (7, "x\x1cx x x", 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id int, `ro``ot` int")
    got = sorted(map(tuple, jaccard_join.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, 2, 3), (None, 0, None), (1, 0, 1), (2, 0, 2), (3, 2, 3), (4, 2, 3), (4, 2, 3), (5, 1, 5), (6, 1, 5), (7, 1, 7)], key=str)
    assert jaccard_join.near_duplicates(docs.limit(0)).count() == 0
