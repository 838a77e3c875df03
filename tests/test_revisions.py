"""Revisions against plain programs: alignment by a table of all prefixes, marks token by token, blocks one after another."""

import random
import tracemalloc

import pytest
import regex
from pyspark.sql import functions as F

from docloom.operators import revisions
from docloom.plans import revisions as queries

TOKEN = regex.compile(r"[\p{L}\p{N}]+(?:['’.,-][\p{L}\p{N}]+)*|[^\s\p{L}\p{N}]")
WORDISH = regex.compile(r"[\p{L}\p{N}]")


def plain_pairs(a, b, cells=250_000):
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    pairs = {k: k for k in range(head)} | {len(b) - 1 - k: len(a) - 1 - k for k in range(tail)}
    if x and y and len(x) * len(y) <= cells:
        share = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in reversed(range(len(x))):
            for j in reversed(range(len(y))):
                share[i][j] = share[i + 1][j + 1] + 1 if x[i] == y[j] else max(share[i + 1][j], share[i][j + 1])
        i = j = 0
        while i < len(x) and j < len(y):
            if x[i] == y[j]:
                pairs[head + j] = head + i
                i, j = i + 1, j + 1
            elif share[i + 1][j] >= share[i][j + 1]:
                i += 1
            else:
                j += 1
    return pairs


def plain_similarity(a, b):
    a, b = TOKEN.findall((a or "").lower()), TOKEN.findall((b or "").lower())
    return 1.0 if not a and not b else 2 * len(plain_pairs(a, b)) / (len(a) + len(b))


def plain_marks(old, new, label, ranges=()):
    a, b = list(TOKEN.finditer(old or "")), list(TOKEN.finditer(new or ""))
    if not any(WORDISH.search(t[0]) for t in b):
        return set()
    pairs = plain_pairs([t[0] for t in a], [t[0] for t in b])
    if not pairs:
        return {(label, 0, len(new))}
    labels = [label] * len(b)
    for j, i in pairs.items():
        labels[j] = next((m for s, e, m in sorted((s, e, m) for m, s, e in ranges) if s <= a[i].start() and a[i].end() <= e), None)
    out, at = set(), 0
    while at < len(b):
        end = at
        while end + 1 < len(b) and labels[end + 1] == labels[at]:
            end += 1
        run = b[at : end + 1]
        if labels[at] == label:
            while run and run[0][0] in set(",.;:!?…'\"“”‘’()[]—–-"):
                run = run[1:]
            while run and run[-1][0] in set(",.;:!?…'\"“”‘’()[]—–-"):
                run = run[:-1]
        if labels[at] is not None and any(WORDISH.search(t[0]) for t in run):
            out.add((labels[at], run[0].start(), run[-1].end()))
        at = end + 1
    return out


def plain_blocks(old, new):
    free, out = set(range(len(old))), []
    for text in new:
        best = min((i for i in free if old[i] == text), default=None)
        origin, score = "same", 1.0
        if best is None:
            origin = "revised"
            score, best = max(((plain_similarity(old[i], text), i) for i in free if set(TOKEN.findall(old[i].lower())) & set(TOKEN.findall(text.lower()))), default=(0, None))
            if score < 0.35:
                best = None
        free.discard(best)
        out.append((origin, best, round(score, 6)) if best is not None else ("new", None, None))
    return out


def made(rng):
    words = ["one", "two", "Two", "three", "it's", "1,000.5", "é", "中文", ",", ".", "—", "(", ")", "x-y"]
    old = [rng.choice(words) for _ in range(rng.randint(0, 25))]
    new = []
    for w in old:
        new += [] if rng.random() < 0.2 else [w] if rng.random() < 0.8 else [rng.choice(words), w]
    new += [rng.choice(words) for _ in range(rng.choice([0, 0, 2, 5]))]
    join = lambda x: "".join(w + rng.choice([" ", " ", "  ", "\n", ""]) if w in ",.()—" else w + rng.choice([" ", "\t"]) for w in x)
    return join(old), join(new)


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(26)
    return [(i, *made(rng)) for i in range(150)] + [(150, None, "all new"), (151, "gone", None), (152, None, None), (153, "a b", "c d"), (154, "a", "!!"), (None, "a b c", "a x c")]


def test_similarity(spark, pairs):
    df = spark.createDataFrame([(*p, 1) for p in pairs], "key long, old string, new string, similarity int").drop("similarity")
    assert {r.key: round(r.similarity, 9) for r in revisions.similarity(df).collect()} == {k: round(plain_similarity(a, b), 9) for k, a, b in pairs}
    assert revisions.similarity(df.limit(0)).count() == revisions.insertions(df.limit(0), "m").count() == 0


def test_marks_and_carried_ranges(spark, pairs):
    rng = random.Random(27)
    ranges = [(k, f"m{n % 2}", s, s + rng.randint(1, 40)) for k, *_ in pairs for n in range(rng.randint(0, 3)) for s in [rng.randint(0, 60)]]
    df = spark.createDataFrame(pairs, "key long, old string, new string")
    for given in ([], ranges):
        got = {k: set() for k, *_ in pairs}
        known = spark.createDataFrame(given, "key long, merge string, start long, stop long") if given else None
        for r in revisions.insertions(df, "m9", known).collect():
            got[r.key].add((r.merge, r.start, r.stop))
        for k, a, b in pairs:
            assert got[k] == plain_marks(a, b, "m9", [r[1:] for r in given if r[0] == k]), (a, b)


def test_alignment_and_its_guard():
    rng = random.Random(28)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 30))] for _ in range(2))
        for cells in (250_000, 40):
            want = plain_pairs(a, b, cells)
            assert revisions.aligned(a, b, cells).tolist() == [want.get(j, -1) for j in range(len(b))]
    a, b = ["s", *(f"a{i}" for i in range(501)), "m", "e"], ["s", *(f"b{i}" for i in range(501)), "m", "e"]  # 501 * 501 cells are too many for the middle; "m" and "e" are a common end
    assert revisions.aligned(a, b).tolist() == [0, *[-1] * 501, 502, 503]
    a[250] = b[250] = "same"
    assert revisions.aligned(a, b)[250] == -1 and revisions.aligned(a[2:], b[2:])[248] == 248 or len(a[2:]) ** 2 > revisions.CELLS


def test_blocks(spark):
    rng = random.Random(29)
    texts = {k: [[made(rng)[0].replace("\n", " ") for _ in range(rng.randint(1, 7))] for _ in range(2)] for k in range(30)}
    for old, new in texts.values():
        new += rng.sample(old, min(2, len(old))) + [made(rng)[1].replace("\n", " ")]
        rng.shuffle(new)
    rows = lambda side: spark.createDataFrame([(k, i, t) for k, v in texts.items() for i, t in enumerate(v[side])], "key long, place int, text string")
    got = {(r.key, r.place): (r.origin, r.old_place, None if r.similarity is None else round(r.similarity, 6)) for r in revisions.block_origins(rows(0), rows(1)).collect()}
    assert got == {(k, i): x for k, v in texts.items() for i, x in enumerate(plain_blocks(*v))}


def test_pairs_stay_in_their_row(spark):
    pairs = spark.createDataFrame([(None, "a b\nc", "c\na b x")], "key long, old string, new string")
    blocks = lambda side: pairs.selectExpr("key", f"posexplode(split({side}, '\n')) AS (place, text)")
    want = [(0, "same", 1, 1.0), (1, "revised", 0, 0.8)]
    for found in (revisions.block_origins(blocks("old"), blocks("new")), revisions.line_origins(pairs)):
        assert sorted((r.place, r.origin, r.old_place, r.similarity) for r in found.collect()) == want
    half = F.array(F.struct(F.lit(0).alias("start"), F.lit(3).alias("stop"), F.lit("m").alias("merge")))
    marks = revisions.insertions(pairs, "now", half)
    assert {tuple(r) for r in marks.collect()} == {(None, "now", 0, 1), (None, "m", 2, 5), (None, "now", 6, 7)}
    # neither tokens nor two blocks that share one become rows, which grow with the square of a text, nor do lists of tokens go to Python
    for found in (marks, revisions.line_origins(pairs), revisions.similarity(pairs)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Window", "Join", "Exchange", "Generate posexplode"))
        assert "ArrowEvalPython" not in plan and "MapInArrow" in plan


def test_queries(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect() if r.text and len(r.text) >= 40}
    base = {}
    for i in sorted(docs):
        base.setdefault(docs[i][:40], i)
    pairs = {i: base[t[:40]] for i, t in docs.items() if base[t[:40]] != i}
    assert len(pairs) >= 10
    assert {(r.doc_id, r.base): r.similarity for r in queries.revision_similarity(spark, sf_dir).collect()} == {(i, b): round(plain_similarity(docs[b], docs[i]), 6) for i, b in pairs.items()}
    got = {i: set() for i in pairs}
    for r in queries.revision_marks(spark, sf_dir).collect():
        got[r.doc_id].add((r.merge, r.start, r.stop))
    assert got == {i: plain_marks(docs[b], docs[i], "now", [("earlier", 0, len(docs[b]) // 2)]) for i, b in pairs.items()}
    blocks = {(r.doc_id, r.place): (r.origin, r.old_place, r.similarity) for r in queries.revised_blocks(spark, sf_dir).collect()}
    assert blocks == {(i, k): x for i, b in pairs.items() for k, x in enumerate(plain_blocks(docs[b].split("\n"), docs[i].split("\n")))}


def long_versions():
    """Two versions of 1,200 words that differ at both ends and here and there, so 1.4 million combinations lie between."""
    rng = random.Random(30)
    old = [f"w{rng.randint(0, 300)}" for _ in range(1200)]
    new = ["begin", *(f"new{i}" if i % 100 == 50 else w for i, w in enumerate(old[:-1])), "end"]
    return " ".join(old), " ".join(new), {k: v for k, v in plain_pairs(old, new, float("inf")).items()}


def test_long_blocks_are_aligned_whole(spark):
    old, new, shared = long_versions()
    found = revisions.line_origins(spark.createDataFrame([(1, f"one\n{old}", f"{new}\none")], "key long, old string, new string")).collect()
    assert len(shared) > 1180
    assert {(r.place, r.origin, r.old_place, round(r.similarity or 0, 9)) for r in found} == {(0, "revised", 1, round(2 * len(shared) / 2401, 9)), (1, "same", 0, 1.0)}


def test_long_versions_are_marked_whole(spark):
    old, new, shared = long_versions()
    half = F.array(F.struct(F.lit(0).alias("start"), F.lit(len(old) // 2).alias("stop"), F.lit("m").alias("merge")))
    found = {(r.merge, r.start, r.stop) for r in revisions.insertions(spark.createDataFrame([(1, old, new)], "key long, old string, new string"), "now", half).collect()}
    words = new.split(" ")
    at = [sum(map(len, words[:j])) + j for j in range(len(words))]
    assert {("now", at[j], at[j] + len(words[j])) for j in range(len(words)) if words[j][0] != "w"} == {r for r in found if r[0] == "now" and r[2] - r[1] < 10} and len(found) > 15


def test_long_texts_are_compared_whole(spark, sf_dir, monkeypatch):
    old, new, shared = long_versions()
    assert [round(r.similarity, 9) for r in revisions.similarity(spark.createDataFrame([(1, old, new)], "key long, old string, new string")).collect()] == [round(2 * len(shared) / 2401, 9)]
    rng = random.Random(31)
    for held in (8 << 20, 16, 1):  # also where numbers are worked out again, in pieces of pieces
        monkeypatch.setattr(revisions, "HELD", held)
        for n in (5, 40, 400):
            a, b = ([rng.choice("abcdefgh") for _ in range(rng.randint(n // 2, n))] for _ in range(2))
            want = plain_pairs(a, b, float("inf"))
            assert revisions.aligned(a, b).tolist() == [want.get(j, -1) for j in range(len(b))]
    a = [f"{rng.randint(0, 9000)}" for _ in range(12_000)]
    b = ["begin", *(rng.choice(a) if rng.random() < 0.2 else w for w in a), "end"]
    monkeypatch.undo()
    tracemalloc.start()
    found = revisions.aligned(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (found >= 0).sum() > 9000 and peak < 40e6, peak  # a table of the combinations would take 576 MB


def test_queries_whole(spark, sf_dir, monkeypatch):
    """The three queries against the plain programs without a limit of combinations."""
    monkeypatch.setattr(plain_pairs, "__defaults__", (float("inf"),))
    test_queries(spark, sf_dir)
