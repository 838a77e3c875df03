"""Questions over kept sources: chunks, the query's terms, ranking by BM25 among a question's chunks, and the order in which chunks are taken.

Nulls and edge cases: a null text has no chunks; a question without terms matches nothing, so its chunks come in order; ties go by source and place; repeated
sources are one; empty tables give empty results. Columns are named in the docstrings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from .chunks import chunks_of
from .retrieval import B, K1
from .running import grouped_running
from .scratch import written

# Terms of the selection that a query takes, and chunks whose neighbours are taken.
SELECTION_TERMS, TOP = 40, 3


def query_terms(questions: DataFrame, df: DataFrame, n: DataFrame) -> DataFrame:
    """question, term and times: terms of its text count twice each time they stand there, and the 40 rarest of its selection once more.

    questions has question, text and selection; df question, term and df, the chunks of the question that have it; n question and n, its chunks.
    """
    own = questions.select("question", F.explode(R.retrieval_tokens(F.col("text"))).alias("term"), F.lit(2).alias("times"))
    chosen = questions.select("question", F.posexplode(F.array_distinct(R.retrieval_tokens(F.col("selection")))).alias("i", "term"))
    counted = chosen.join(df, ["question", "term"], "left").join(n, "question").withColumn("idf", _idf(F.col("n"), F.coalesce("df", F.lit(0))))
    rarest = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("idf"), "i"))  # a row for each term of a selection
    added = counted.withColumn("r", rarest).where(F.col("r") <= SELECTION_TERMS).select("question", "term", F.lit(1).alias("times"))
    return own.unionByName(added).groupBy("question", "term").agg(F.sum("times").alias("times"))


def _idf(n: Column, df: Column) -> Column:
    return F.ln(1 + (n - df + 0.5) / (df + 0.5))


def chunk_priority(questions: DataFrame, sources: DataFrame) -> DataFrame:
    """question, source, place, score, tier (0 best three, 1 their neighbours, 2 first of a source, 3 other matches, 4 all where none matches) and turn, its place in line.

    questions has question, text and selection; sources question, source and text. Chunks meet their question's terms by an equality join.
    """
    parts = chunks_of(sources.select("question", "source", "text"), ["question", "source"]).select("question", "source", "place", R.retrieval_tokens(F.col("text")).alias("t"))
    # only terms that a question can ask for are kept, with their number in each chunk, and how many terms the chunk has
    may = written(questions.select("question", F.explode(F.array_union(*[F.coalesce(R.retrieval_tokens(F.col(c)), F.array().cast("array<string>")) for c in ("text", "selection")])).alias("term")).groupBy("question").agg(F.collect_set("term").alias("may")))
    kept = F.filter("t", lambda w: F.array_contains("may", w))
    counted = parts.join(may, "question", "left").select("question", "source", "place", F.size("t").alias("len"), F.coalesce(kept, F.array().cast("array<string>")).alias("t"))
    tokens = written(counted.dropDuplicates(["question", "source", "place"]))  # read five times below
    sized = tokens.select("question", "source", "place", "len")
    n = sized.groupBy("question").agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    tf = tokens.select("question", "source", "place", F.explode("t").alias("term")).groupBy("question", "source", "place", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("question", "term").agg(F.count("*").alias("df"))
    asked = query_terms(questions, df, n.select("question", "n"))
    found = tf.join(asked, ["question", "term"]).join(df, ["question", "term"]).join(n, "question").join(sized, ["question", "source", "place"])
    f = F.col("tf")
    weight = F.col("times") * _idf(F.col("n"), F.col("df")) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    scores = found.groupBy("question", "source", "place").agg(F.round(F.sum(weight), 9).alias("score")).where("score > 0")

    ranked = grouped_running(scores.select("*", (-F.col("score")).alias("behind"), F.lit(1).alias("one")), ["question"], ["behind", "source", "place"], {"rank": "one"}).select("question", "source", "place", "score", "rank")
    best = ranked.where(F.col("rank") <= TOP)
    near = best.select("question", "source", F.explode(F.array(F.col("place") - 1, F.col("place") + 1)).alias("place"), (F.col("rank") * 2).alias("by"))
    near = near.withColumn("by", F.col("by") + F.row_number().over(Window.partitionBy("question", "source", "by").orderBy("place")) / 10)
    near = near.groupBy("question", "source", "place").agg(F.min("by").alias("by"))
    all_ = sized.select("question", "source", "place").join(ranked, ["question", "source", "place"], "left").join(near, ["question", "source", "place"], "left")
    all_ = all_.join(ranked.select("question").distinct().withColumn("matched", F.lit(True)), "question", "left")
    tier = F.when(F.col("rank") <= TOP, 0).when(F.col("by").isNotNull(), 1).when(F.col("place") == 0, 2).when(F.col("rank").isNotNull(), 3).when(F.col("matched").isNull(), 4)
    line = all_.withColumn("tier", tier).where("tier IS NOT NULL").withColumn("within", F.when(F.col("tier") == 1, F.col("by")).when(F.col("tier").isin(0, 3), F.col("rank").cast("double")).otherwise(0.0))
    turn = grouped_running(line.select("question", "source", "place", "score", "tier", "within", F.lit(1).alias("one")), ["question"], ["tier", "within", "source", "place"], {"turn": "one"})
    return turn.select("question", "source", "place", F.coalesce("score", F.lit(0.0)).alias("score"), "tier", F.col("turn").cast("long").alias("turn"))
