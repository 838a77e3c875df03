"""Quality classifier: a linear-chain conditional random field labels every line good or bad from the features of the line and
of its neighbours; forward-backward marginals, weighted by line length, make the document's score.

Nulls and edge cases: a null text is read as empty, and an empty text is one empty line, which gets a score like any other; a
null doc_id is kept and counts as held out; repeated rows are scored each on their own; an empty table gives an empty
result; columns of the input stay in the struct `row`, so their names can't clash with those added. One task needs memory for
SLICE_ROWS texts and SLICE_BYTES, or for one longer text; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import line_crf
from .common import held_out, labelled_sample, map_texts, packed

#: The fit reads at most so many labelled documents, each of at most so many bytes. Scoring has no such bounds.
FIT_ROWS, FIT_BYTES = 3000, 65536


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> line_crf.Crf:
    """Train on a bounded sample of the labelled rows that aren't held out."""
    return line_crf.fit(*labelled_sample(docs, labels, "quality", fit_rows, fit_bytes))


def score(docs: DataFrame, model: line_crf.Crf) -> DataFrame:
    """row, doc_id, held_out, score (0 to 1, higher is better) and predicted (1 from 0.5 on) for every row of docs."""

    def compute(texts: list[str]) -> dict:
        return {"score": line_crf.document_scores(model, texts)}

    out = map_texts(packed(docs), compute, T.StructType([T.StructField("score", T.DoubleType())]), ("row", "doc_id"))
    return out.select("row", "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
