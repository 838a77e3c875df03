"""Sentences, style rules and blocks against plain versions and texts made for them."""

import random
import re

import duckdb
from pyspark.sql import functions as F

from docloom.functions import blocks as B
from docloom.functions import lint as L
from docloom.functions import text as X
from docloom.operators import blocks
from docloom.plans import drafts


def plain_strip(t):
    for p, r in ((r"\[([^\]]*)\]\([^)]*\)", r"\1"), (r"`([^`]*)`", r"\1"), (r"\*\*(.+?)\*\*", r"\1"), (r"__(.+?)__", r"\1"), (r"(^|[^A-Za-z0-9_*])[*_]([^*_\n]+)[*_](?=$|[^A-Za-z0-9_*])", r"\1\2"), (r"[ \t\n\x0b\f\r]+", " ")):
        t = re.sub(p, r, t)
    return t.strip(" ")


def plain_sentences(text):
    out, start, plain = [], 0, plain_strip(text)
    pieces = []
    for m in re.finditer(r"""[.!?]["'”’)\]]*(\s+)(?=["'“‘(\[]?[A-Z0-9])""", plain, re.A):
        pieces.append(plain[start:m.start(1)])
        start = m.end(1)
    for p in [*pieces, plain[start:]]:
        last = re.search(r"([A-Za-z.]+)\.$", out[-1]) if out else None
        word, first = last[1].lower() if last else "", re.match(r"""["'“‘(\[]*([A-Za-z]+)""", p)
        if word == "no":
            joins = p[:1].isdigit()
        elif re.fullmatch("[a-z]", word):
            joins = bool(first) and first[1].lower() not in L.STARTERS
        else:
            joins = word in L.ABBREVIATIONS
        if joins:
            out[-1] += " " + p
        else:
            out.append(p)
    return [s.strip(" ") for s in out if s.strip(" ")]


def plain_passive(s):
    return any(w.lower() not in L.NOT_PARTICIPLES for w in re.findall(r"\b(?:is|are|was|were|be|been|being)\s+([A-Za-z]+(?:ed|en))\b", s, re.I | re.A))


def n_words(s):
    return sum(any(c.isalnum() for c in w) for w in re.split(r"[ \t\n\x0b\f\r]+", s))


TEXTS = ["Dr. Smith came. No. 5 won. No. It is broken. J. Smith left. Plan A. Then we go e.g. Paris.", "It was opened by men. Are even? \"Yes.\" He (said.) Go.", "1. Cut and then fold it. It is closed.\n- It is closed; done", "", None, "One.  Two!\n\nThree? four. 5 U.S. Army"]


def test_sentences(spark):
    rnd = random.Random(3)
    parts = ["Dr.", "e.g.", "No.", "5", "A.", "The", "cat", "is", "opened", "open.", "go!", '"Yes."', "(so)", "*x*", "U.S.", "\n", "hidden?", "and then", "; "]
    values = [t for t in TEXTS if t is not None] + [" ".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    got = {r.i: (r.s, r.p) for r in df.select("i", L.lint_sentences(F.col("t")).alias("s"), F.transform(L.lint_sentences(F.col("t")), L.is_passive).alias("p")).collect()}
    for i, t in enumerate(values):
        assert got[i][0] == plain_sentences(t), t
        assert got[i][1] == [plain_passive(s) for s in got[i][0]], t
    assert spark.createDataFrame([(None,)], "t string").select(L.lint_sentences(F.col("t"))).first()[0] is None


def test_style_of_all_documents(spark, sf_dir):
    want = {}
    for doc, text in duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall():
        row = [0, 0, 0, 0, 0]
        for line in filter(lambda x: re.search(r"[^ \t\n\x0b\f\r]", x), (text or "").split("\n")):
            step = re.match(r"[ \t\x0b\f\r]*[0-9]{1,3}[.)][ \t\x0b\f\r]+[^ \t\x0b\f\r]", line)
            for s in plain_sentences(re.sub(r"^[ \t\x0b\f\r]*(?:[0-9]{1,3}[.)]|[-*•])[ \t\x0b\f\r]+(?=[^ \t\x0b\f\r])", "", line)):
                long, two, passive = n_words(s) > (20 if step else 25), bool(step) and bool(re.search(r"(?i)\band then\b|;\s", s)), plain_passive(s)
                row = [a + b for a, b in zip(row, (1, long or two or (passive and bool(step)), long, two, passive))]
        want[doc] = row
    got = {r.doc_id: [r.n_sentences, r.n_failing, r.n_long, r.n_two, r.n_passive] for r in drafts.style_findings(spark, sf_dir).collect()}
    assert got == want
    plain = {r.doc_id: r for r in drafts.plain_language(spark, sf_dir).collect()}
    assert all(plain[d].n_sentences == w[0] for d, w in want.items()) and any(p.n_long_words for p in plain.values())


def test_plain_language(spark):
    text = "The notwithstanding university is λ.\nA self-notwithstanding computer.\n\nNotwithstanding notwithstanding " + "word " * 20 + "end."
    got = spark.createDataFrame([(text,), ("",)], "t string").select(L.plain_language_of(F.col("t")).alias("p")).collect()
    assert [(p.n_sentences, p.n_long, p.long_words, p.symbol) for p in got[0].p] == [(2, 0, ["notwithstanding", "university"], True), (1, 1, ["notwithstanding"], False)]
    assert got[1].p == []


NOTES = """---
title: Notes
---

# Store

From the **pilot** at the [site](http://x).

- Pick rate rose
  - Night shift
    - Fewer miles
- Errors fell

1. Extend
2. Train

| Metric | Before |
| ------ | ------ |
| Picks | 110 |

> Help people.

```yaml
pilot:
  sites: 2
```

![Floor plan](layout.png)

- [x] Safety
"""
PROMPT = """# Store
From the **pilot** at the [site](http://x).
- Pick rate rose
  - Night shift
    - Fewer miles
- Errors fell
1. Extend
2. Train
| Metric | Before |
| --- | --- |
| Picks | 110 |
> Help people.
```
pilot:
  sites: 2
```
[image: Floor plan]
- [x] Safety"""


def test_markdown_blocks():
    assert B.prompt_text(B.markdown_blocks(NOTES)) == PROMPT
    assert B.markdown_blocks(None) == [] == B.markdown_blocks("")
    assert [b[:2] for b in B.markdown_blocks("Title\n=====\ntext\n\nSub\n---\n")] == [("heading", 1), ("paragraph", 0), ("heading", 2)]


def test_text_blocks():
    got = B.text_blocks("One\ntwo\n\n* a\n    * deep\n  * b\n      goes on\nafter\n\n1) x\n2) y")
    assert [(b[0], b[1], b[2], b[3], b[5]) for b in got] == [
        ("paragraph", 0, False, "One two", None), ("item", 1, False, "a", None), ("item", 2, False, "deep", 1), ("item", 2, False, "b goes on", 1), ("paragraph", 0, False, "after", None), ("item", 1, True, "x", None), ("item", 1, True, "y", None),
    ]


def test_html_blocks():
    html = (
        "<html><head><title>t</title></head><body><nav>no</nav><h2>Head <b>bold</b></h2>loose <i>text</i><p>para<br>two<script>x</script></p><blockquote><p>said</p><h3>h</h3></blockquote><pre>a\n  b</pre>"
        "<ul><li>one<ol><li>in</li></ol>more</li><li></li></ul><table><tr><th>k</th><th colspan=2>v</th></tr><tr><td>1</td><td>2<table><tr><td>n</td><td>m</td></tr></table></td><td><img alt='pic'></td></tr></table>"
    )
    assert B.html_blocks(html) == [
        ("heading", 2, False, "Head bold", None, None), ("paragraph", 0, False, "loose text", None, None), ("paragraph", 0, False, "para two", None, None), ("quote", 0, False, "said", None, None), ("quote", 0, False, "h", None, None),
        ("code", 0, False, "a\n  b", None, None), ("item", 1, False, "one more", None, None), ("item", 2, True, "in", None, 6), ("header", 0, False, "", ["k", "v", ""], None), ("row", 0, False, "", ["1", "2 n; m", "[image: pic]"], None),
    ]
    assert B.html_blocks(None) == [] and B.html_blocks("<p>a<p>b") == [("paragraph", 0, False, "a", None, None), ("paragraph", 0, False, "b", None, None)]


def test_cap_and_violations(spark):
    df = spark.createDataFrame([(1, "aaaa\n\nbbbb\n\ncccc"), (2, None), (3, "")], "k int, t string")
    rows = blocks.exploded(df, "k", blocks.blocks_of(F.col("t"), "text"))
    assert sorted((r.k, r.text) for r in blocks.capped(rows, "k", 6).collect()) == [(1, "aaaa"), (1, "bb")]
    assert blocks.violations(rows, "k").count() == 0
    bad = rows.withColumn("parent", F.lit(9)).withColumn("kind", F.lit("heading"))
    assert {r.rule for r in blocks.violations(bad, "k").collect()} == {"level", "parent"}


def test_sentences_are_judged_without_walks_over_their_words(spark):
    df = spark.createDataFrame([("He came. It was hidden. It is is opened. en is en 1 is", )], "t string")
    for made, walks in ((L.lint_sentences(F.col("t")), True), (L.is_passive(F.col("t")), False), (X.word_count(F.col("t")), False), (L.long_words(F.col("t")), True)):
        plan = df.select(made)._jdf.queryExecution().analyzed().toString()
        assert "zip_with" not in plan and (walks or "lambda" not in plan)
    assert df.select(L.is_passive(F.lit("is en, was hidden")), L.is_passive(F.lit("This opened. It is_opened")), L.is_passive(F.lit("IS Opened")), X.word_count(F.lit(" -- a, é ½ x-y "))).first()[:] == (False, False, True, 4)
