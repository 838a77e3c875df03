"""Quality rules: Viterbi decoding of a linear-chain conditional random field marks each line as content or boilerplate, and the
share of content decides whether a document is retained, after counting rules that fail a document outright. The model is fitted on the labels of
quality, so boilerplate is what makes lines of documents labelled bad differ from those of good ones.

Nulls and edge cases: a null text has no words, hence fails; an empty text likewise; a null doc_id is kept as it is; repeated rows
are judged each on their own; an empty table gives an empty result; input columns stay in the struct `row`. One task needs
memory for SLICE_ROWS texts and SLICE_BYTES, or for one longer text; nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import line_crf
from .common import labelled_sample, map_texts, packed
from .quality_classifier import FIT_BYTES, FIT_ROWS

# Fixed values of the counting rules.
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = b"#*$%&|<>"
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"

#: A document is retained if at least this share of its code points is in content lines.
MIN_CONTENT = 0.5
#: Windows of a text from which on they are compared by hash first.
LONG = 100_000


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> line_crf.Crf:
    """Train the line model on a bounded sample of labelled documents."""
    return line_crf.fit(*labelled_sample(docs, labels, "quality", fit_rows, fit_bytes))


def repeated_words(data: bytes, words: list[bytes], window: int = WINDOW) -> int:
    """Number of words inside any run of `window` words that the text has at least twice."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    line = b" ".join(words)
    starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])
    hit = np.zeros(n + 1, np.int64)
    if n > LONG:  # hashes find what may be equal, so that only those runs are held
        ends = starts[window:] - 1
        hashes = np.fromiter((xxhash.xxh64_intdigest(line[a:b]) for a, b in zip(starts[:n], ends)), np.uint64, n)
        value, count = np.unique(hashes, return_counts=True)
        places = np.flatnonzero(np.isin(hashes, value[count > 1])).tolist()
        runs = (line[starts[i] : ends[i]] for i in places)
    else:
        first, ends = starts[:n].tolist(), (starts[window:] - 1).tolist()
        runs = [line[a:b] for a, b in zip(first, ends)]
        if len(set(runs)) == n:
            return 0
        places = range(n)
    seen: dict[bytes, int] = {}
    for i, run in zip(places, runs):
        j = seen.setdefault(run, i)
        if j != i:
            hit[i] = hit[j] = 1
    covered = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(hit[:n])
    np.add.at(covered, at, 1)
    np.add.at(covered, at + window, -1)
    return int((np.cumsum(covered)[: len(words)] > 0).sum())


def counts_of(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # bytes.split() knows exactly the six characters of WHITE
    white = sum(map(text.count, WHITE))
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(words), len(text) - white, sum(map(data.count, (bytes([c]) for c in SYMBOLS))), len(lines) - len(set(lines)), repeated_words(data, words)


ADDED = T.StructType([T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [T.StructField("content_share", T.DoubleType())])


def judge(docs: DataFrame, model: line_crf.Crf, min_content: float = MIN_CONTENT) -> DataFrame:
    """row, doc_id, the counts, content_share, base_failed and kept for every row of docs."""

    def compute(texts: list[str]) -> dict:
        found = list(zip(*map(counts_of, texts))) or [()] * 5
        return dict(zip(ADDED.names, [*map(list, found), line_crf.content_shares(model, texts)]))

    out = map_texts(packed(docs), compute, ADDED, ("row", "doc_id"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("content_share") >= min_content))
