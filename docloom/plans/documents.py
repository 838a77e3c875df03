"""Queries over documents, benchmark and conversations, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as X
from ..operators import catalog, nearest, retrieval, texts
from ..operators.running import running_sum
from ..sources.tables import table
from .rules import CATALOG_TOKENS, RETRIEVAL_TOKENS

#: Bands of a logarithmic scale: a number a tenth below or above another lies in its band or in a neighbour.
BAND = 0.11
TOKENS = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: length(x) >= 2)"


def _parts() -> list[tuple[Column, float]]:
    """Parts of a document: the first 60 characters are its title, which counts twice, and all that follows its summary."""
    return [(F.substring("text", 1, 60), 2), (F.substring("text", 61, 2**31 - 1), 1)]


def related_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight documents most like the one of least id."""
    docs = table(spark, sf_dir, "documents")
    first, n = docs.agg(F.min("doc_id"), F.count("*")).first()
    parts = docs.select("doc_id", *[c.alias(f"part{i}") for i, (c, _) in enumerate(_parts())])
    names = parts.columns[1:]
    found = nearest.related(nearest.one_row_a_key(parts, "doc_id", names), F.col("doc_id") == first, "doc_id", [(F.col(c), w) for c, (_, w) in zip(names, _parts())], n_docs=n)
    return found.select("doc_id", "score").orderBy(F.desc("score"), "doc_id")


_WEIGHED_SQL = f"""WITH t AS (SELECT doc_id, term, sum(w) AS tf FROM (
    SELECT doc_id, unnest({CATALOG_TOKENS.format("substr(text, 1, 60)")}) AS term, 2.0 AS w FROM documents UNION ALL
    SELECT doc_id, unnest({CATALOG_TOKENS.format("substr(text, 61)")}) AS term, 1.0 AS w FROM documents) GROUP BY doc_id, term),
df AS (SELECT term, ln((SELECT count(*) + 1 FROM documents) / (count(*) + 1.0)) + 1 AS idf FROM t GROUP BY term),
w AS (SELECT doc_id, term, CAST(tf * idf AS DOUBLE) AS w FROM t JOIN df USING (term)),
l AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id),"""
RELATED_SQL = f"""{_WEIGHED_SQL}
q AS (SELECT term, w AS q FROM w WHERE doc_id = (SELECT min(doc_id) FROM documents)),
s AS (SELECT w.doc_id, sum(w * q) AS dot FROM w JOIN q USING (term) WHERE w.doc_id <> (SELECT min(doc_id) FROM documents) GROUP BY w.doc_id)
SELECT doc_id, round(greatest(0.0, least(1.0, dot / (norm * (SELECT sqrt(sum(q * q)) FROM q)))), 6) AS score
FROM s JOIN l USING (doc_id) WHERE dot / (norm * (SELECT sqrt(sum(q * q)) FROM q)) >= 0.05 ORDER BY score DESC, doc_id LIMIT 8
"""


def related_to_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As related_documents, for each document whose id is divisible by 100."""
    docs = table(spark, sf_dir, "documents")
    return nearest.related(docs, F.col("doc_id") % 100 == 0, "doc_id", _parts())


RELATED_TO_EACH_SQL = f"""{_WEIGHED_SQL}
s AS (SELECT q.doc_id AS query_id, w.doc_id, sum(w.w * q.w) AS dot FROM w JOIN w AS q ON w.term = q.term AND w.doc_id <> q.doc_id WHERE q.doc_id % 100 = 0 GROUP BY q.doc_id, w.doc_id),
r AS (SELECT query_id, s.doc_id, round(greatest(0.0, least(1.0, dot / (l.norm * o.norm))), 6) AS score FROM s JOIN l ON l.doc_id = s.doc_id JOIN l AS o ON o.doc_id = query_id)
SELECT query_id, doc_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM r WHERE score >= 0.05) WHERE rank <= 8
"""


def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return retrieval.document_frequency(docs.select("doc_id", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("term")))


def bm25_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight best documents for each benchmark item, taken as a question."""
    docs = table(spark, sf_dir, "documents")
    n = docs.select("doc_id").distinct().count()
    questions = retrieval.retrieval_counts(table(spark, sf_dir, "benchmark"), "item_id").withColumnRenamed("item_id", "query_id")
    return nearest.answers(questions, nearest.one_row_a_key(docs, "doc_id", ["text"]), "doc_id", "text", n).withColumnRenamed("query_id", "item_id")


BM25_SQL = f"""
WITH d AS (SELECT doc_id, {RETRIEVAL_TOKENS.format("text")} AS terms FROM documents),
s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(terms)) AS a FROM d),
tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS len, unnest(terms) AS term FROM d) GROUP BY doc_id, len, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT doc_id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a)) AS w FROM tf JOIN df USING (term), s),
q AS (SELECT item_id, term, count(*) AS qf FROM (SELECT item_id, unnest({RETRIEVAL_TOKENS.format("text")}) AS term FROM benchmark) GROUP BY item_id, term),
r AS (SELECT item_id, doc_id, round(sum(w * qf), 6) AS score FROM w JOIN q USING (term) GROUP BY item_id, doc_id)
SELECT item_id, doc_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM r WHERE score > 0) WHERE rank <= 8
"""


def dedupe_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the first of its content, and whether it is that one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    found = catalog.first_of_each(docs, F.col("sha"), ["doc_id"])
    return found.select("doc_id", F.col("of").alias("duplicate_of"), F.col("first").alias("is_first"), "n_copies")


def running_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct documents in order of id, with how many and how many bytes there are so far, and whether both are within 50 and 100 kB."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("sha"))
    distinct = docs.groupBy("sha").agg(F.min(F.struct("doc_id", "bytes")).alias("d")).select("d.doc_id", "d.bytes", F.lit(1).cast("long").alias("one"))
    found = running_sum(distinct, ["doc_id"], {"n_so_far": "one", "bytes_so_far": "bytes"})
    return found.select("doc_id", "n_so_far", "bytes_so_far", ((F.col("n_so_far") <= 50) & (F.col("bytes_so_far") <= 100_000)).alias("accepted"))


def store_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of a content-addressed store of each language: each content once."""
    docs = table(spark, sf_dir, "documents").select("lang", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("bytes"))
    return docs.groupBy("lang", "sha").agg(F.max("bytes").alias("bytes")).groupBy("lang").agg(F.count("*").alias("n_blobs"), F.sum("bytes").alias("n_bytes"))


def sentence_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of each document: how many, how many over 20 words or with two instructions, and the share that passes."""
    judged = F.transform(X.sentences(F.col("text")), lambda s: F.struct((X.word_count(s) > 20).alias("long"), X.two_instructions(s).alias("two")))
    n_of = lambda good: F.size(F.filter("s", good)).cast("long")
    each = table(spark, sf_dir, "documents").select("doc_id", judged.alias("s")).where(F.size("s") > 0)
    found = each.select("doc_id", F.size("s").cast("long").alias("n_sentences"), n_of(lambda s: s["long"]).alias("n_long"), n_of(lambda s: s["two"]).alias("n_two"), n_of(lambda s: ~(s["long"] | s["two"])).alias("n_passing"))
    return found.select("doc_id", "n_sentences", "n_long", "n_two", F.round(F.col("n_passing") / F.col("n_sentences"), 6).alias("score"))


def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.estimated_tokens(F.col("text")).alias("n_tokens"))


def character_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits per character of each document."""
    return table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", F.round(R.text_entropy("text"), 4).alias("entropy"))


def new_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that a source states where no other source states one within a tenth of its own (that one isn't 0).

    Distinct numbers, each with the least and the greatest source that states it, stand in bands of a logarithmic scale wider than a tenth; a number meets
    those of its own band and of both neighbours, so the work grows with the distinct numbers of a band, not with documents.
    """
    docs = table(spark, sf_dir, "documents").select("source", F.explode(X.stated_numbers(F.col("text"))).alias("v")).distinct()
    band = F.floor(F.ln(F.abs("v")) / BAND)
    known = docs.where("v <> 0").groupBy("v").agg(F.min("source").alias("low"), F.max("source").alias("high")).select(F.col("v").alias("n"), "low", "high", F.explode(F.array(band - 1, band, band + 1)).alias("near"))
    asked = docs.withColumn("band", F.when(F.col("v") != 0, band))
    close = (F.col("band") == F.col("near")) & (F.abs(F.col("v") - F.col("n")) <= 0.1 * F.abs("n")) & ((F.col("low") != F.col("source")) | (F.col("high") != F.col("source")))
    own = asked.join(known, close, "left_anti")
    return own.groupBy("source").agg(F.count("*").alias("n_own"), F.round(F.sum(F.log2(F.col("v") + 1)), 4).alias("magnitude"))


def bold_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(X.bold_terms(F.col("text"))).alias("term"))
    return docs.groupBy("term").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without lines that stand in over 60 % of its paragraphs, and in three at least."""
    paragraphs = F.posexplode(F.split("text", "\n")).alias("slide", "line")
    lines = table(spark, sf_dir, "documents").select("doc_id", paragraphs).where("trim(line) <> ''")
    kept = texts.without_repeated(lines, "doc_id", "slide", "line")
    total = lines.groupBy("doc_id").agg(F.count("*").alias("n"))
    left = kept.groupBy("doc_id").agg(F.count("*").alias("n_left"), F.sum(F.length("line")).alias("n_chars"))
    return total.join(left, "doc_id", "left").select("doc_id", F.coalesce("n_left", F.lit(0)).alias("n_left"), (F.col("n") - F.coalesce("n_left", F.lit(0))).alias("n_removed"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"))


def carried_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document that stand under each heading; a heading is a line of three words or fewer, and lines before any stand under none."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ix", "line"))
    heading = F.when(F.size(F.split(F.trim("line"), " +")) <= 3, F.col("ix"))
    carried = F.last(heading, ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("ix"))
    return lines.withColumn("under", F.coalesce(carried, F.lit(-1))).groupBy("doc_id", "under").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


def chosen_with_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three longest lines of each document and their neighbours, in order, with a mark where lines are left out between."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ix", "line"))
    best = lines.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc(F.length("line")), "ix"))).where("r <= 3")
    wide = best.select("doc_id", F.explode(F.array(F.col("ix") - 1, F.col("ix"), F.col("ix") + 1)).alias("ix")).distinct()
    kept = lines.join(wide, ["doc_id", "ix"], "left_semi")
    before = F.lag("ix", 1, -1).over(Window.partitionBy("doc_id").orderBy("ix"))
    return kept.select("doc_id", F.col("ix").cast("long").alias("ix"), (F.col("ix") != before + 1).alias("gap"))


def capped_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest documents of each source (of greatest id), while there are 60 at most and 48 kB in all; the newest always stays."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.octet_length("text").cast("long").alias("bytes"))
    return catalog.capped_history(docs, "source", "doc_id", "bytes", 60, 48_000).select("source", "doc_id", F.col("total").alias("bytes_so_far"))


def kept_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document whether another language holds a text of its source and content; short texts have no content hash, and match any."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("kind"), F.col("source").alias("ref"), F.when(F.length("text") >= 200, F.sha2("text", 256)).alias("sha"))
    # Another language holds something if the least or the greatest language of it isn't the document's own.
    held = docs.where("kind IS NOT NULL")
    ends = lambda rows, by: rows.groupBy(*by).agg(F.min("kind").alias("low"), F.max("kind").alias("high"))
    of_ref = ends(held, ["ref"]).select("ref", F.struct("low", "high").alias("any"))
    open_ = ends(held.where("sha IS NULL"), ["ref"]).select("ref", F.struct("low", "high").alias("open"))
    same = ends(held.where("sha IS NOT NULL"), ["ref", "sha"]).select("ref", "sha", F.struct("low", "high").alias("same"))
    other = lambda c: F.coalesce((F.col(f"{c}.low") != F.col("kind")) | (F.col(f"{c}.high") != F.col("kind")), F.lit(False))
    found = docs.join(of_ref, "ref", "left").join(open_, "ref", "left").join(same, ["ref", "sha"], "left")
    return found.select("doc_id", (other("open") | other("same") | (F.col("sha").isNull() & other("any"))).alias("is_held"))


def turn_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each conversation as a chain: place, characters so far and number of turns."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    return turns.select("conv_id", "turn", F.row_number().over(w).alias("level"), F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("chars_on_path"), F.count("*").over(Window.partitionBy("conv_id")).alias("n_turns"))


QUERIES = {f.__name__: f for f in (related_documents, related_to_each, document_frequency, bm25_ranking, dedupe_sources, running_caps, store_bytes, sentence_lint, token_estimates, character_entropy, new_numbers, bold_terms, repeated_lines, carried_heading, chosen_with_neighbours, capped_sources, kept_texts, turn_paths)}

_LINES = "(SELECT doc_id, unnest(range(0, len(l))) AS ix, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
ORACLE_SQL = {
    "related_documents": RELATED_SQL,
    "related_to_each": RELATED_TO_EACH_SQL,
    "document_frequency": f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({TOKENS.format('text')}) AS term FROM documents) GROUP BY term",
    "bm25_ranking": BM25_SQL,
    "dedupe_sources": "SELECT doc_id, min(doc_id) OVER w AS duplicate_of, doc_id = min(doc_id) OVER w AS is_first, count(*) OVER w AS n_copies FROM (SELECT doc_id, sha256(text) AS sha FROM documents) WINDOW w AS (PARTITION BY sha)",
    "running_caps": """WITH d AS (SELECT min(doc_id) AS doc_id, min(octet_length(encode(text))) AS bytes FROM documents GROUP BY sha256(text)),
        s AS (SELECT doc_id, count(*) OVER w AS n_so_far, CAST(sum(bytes) OVER w AS BIGINT) AS bytes_so_far FROM d WINDOW w AS (ORDER BY doc_id ROWS UNBOUNDED PRECEDING))
        SELECT doc_id, n_so_far, bytes_so_far, n_so_far <= 50 AND bytes_so_far <= 100000 AS accepted FROM s""",
    "store_bytes": "SELECT lang, count(*) AS n_blobs, CAST(sum(b) AS BIGINT) AS n_bytes FROM (SELECT lang, sha256(text) AS s, max(octet_length(encode(text))) AS b FROM documents GROUP BY lang, s) GROUP BY lang",
    "sentence_lint": r"""WITH s AS (SELECT doc_id, trim(unnest(string_split(regexp_replace(text, '([.!?])\s+|\n+', '\1' || chr(1), 'g'), chr(1)))) AS s FROM documents),
        f AS (SELECT doc_id, len(list_filter(regexp_split_to_array(s, '\s+'), lambda w: regexp_matches(w, '[\p{L}\p{N}]'))) > 20 AS long, regexp_matches(s, '(?i)\band then\b') OR regexp_matches(s, ';\s') AS two FROM s WHERE s <> '')
        SELECT doc_id, count(*) AS n_sentences, count(*) FILTER (WHERE long) AS n_long, count(*) FILTER (WHERE two) AS n_two, round(count(*) FILTER (WHERE NOT (long OR two)) / CAST(count(*) AS DOUBLE), 6) AS score FROM f GROUP BY doc_id""",
    "token_estimates": "SELECT doc_id, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE ceil(length(text) / CASE WHEN length(regexp_replace(text, '[^぀-ヿ㐀-䶿一-鿿가-힯]', '', 'g')) / CAST(length(text) AS DOUBLE) > 0.3 THEN 1.5 ELSE 3.5 END) END AS BIGINT) AS n_tokens FROM documents",
    "character_entropy": """WITH c AS (SELECT doc_id, c, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents) GROUP BY doc_id, c)
        SELECT doc_id, round(log2(CAST(sum(n) AS DOUBLE)) - sum(n * log2(CAST(n AS DOUBLE))) / CAST(sum(n) AS DOUBLE), 4) AS entropy FROM c GROUP BY doc_id""",
    "new_numbers": r"""WITH d AS (SELECT DISTINCT source, v FROM (SELECT source, CAST(replace(unnest(regexp_extract_all(text, '[0-9][0-9,]*(?:\.[0-9]+)?')), ',', '') AS DOUBLE) AS v FROM documents) WHERE NOT (v = floor(v) AND v BETWEEN 0 AND 10)),
        k AS (SELECT v AS n, min(source) AS lo, max(source) AS hi FROM d WHERE v <> 0 GROUP BY v)
        SELECT source, count(*) AS n_own, round(sum(log2(v + 1)), 4) AS magnitude FROM d WHERE NOT EXISTS (SELECT 1 FROM k WHERE abs(d.v - n) <= 0.1 * abs(n) AND (lo <> d.source OR hi <> d.source)) GROUP BY source""",
    "bold_terms": r"""WITH t AS (SELECT DISTINCT doc_id, lower(trim(unnest(regexp_extract_all(text, '\*\*([^*\n]+)\*\*', 1)))) AS term FROM documents)
        SELECT term, count(*) AS n_docs, min(doc_id) AS first_doc FROM t WHERE length(term) BETWEEN 3 AND 60 GROUP BY term""",
    "repeated_lines": f"""WITH l AS (SELECT * FROM {_LINES} WHERE trim(line) <> ''), n AS (SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id), r AS (SELECT doc_id, line, count(*) AS c FROM l GROUP BY doc_id, line),
        k AS (SELECT l.doc_id, count(*) AS n_left, sum(length(l.line)) AS n_chars FROM l JOIN n USING (doc_id) JOIN r ON r.doc_id = l.doc_id AND r.line = l.line WHERE NOT (c >= 3 AND c > 0.6 * n) GROUP BY l.doc_id)
        SELECT doc_id, coalesce(n_left, 0) AS n_left, n - coalesce(n_left, 0) AS n_removed, CAST(coalesce(n_chars, 0) AS BIGINT) AS n_chars FROM n LEFT JOIN k USING (doc_id)""",
    "carried_heading": f"""WITH l AS {_LINES}, h AS (SELECT doc_id, ix, line, last_value(CASE WHEN len(regexp_split_to_array(trim(line), ' +')) <= 3 THEN ix END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ix) AS u FROM l)
        SELECT doc_id, CAST(coalesce(u, -1) AS INTEGER) AS under, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM h GROUP BY doc_id, 2""",
    "chosen_with_neighbours": f"""WITH l AS {_LINES}, b AS (SELECT doc_id, ix FROM (SELECT doc_id, ix, row_number() OVER (PARTITION BY doc_id ORDER BY length(line) DESC, ix) AS r FROM l) WHERE r <= 3),
        k AS (SELECT DISTINCT l.doc_id, l.ix FROM l JOIN b ON l.doc_id = b.doc_id AND l.ix BETWEEN b.ix - 1 AND b.ix + 1)
        SELECT doc_id, ix, ix <> lag(ix, 1, -1) OVER (PARTITION BY doc_id ORDER BY ix) + 1 AS gap FROM k""",
    "capped_sources": """WITH d AS (SELECT source, doc_id, row_number() OVER w AS p, CAST(sum(octet_length(encode(text))) OVER (PARTITION BY source ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS t FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id DESC))
        SELECT source, doc_id, t AS bytes_so_far FROM d WHERE p = 1 OR (p <= 60 AND t <= 48000)""",
    "kept_texts": """WITH d AS (SELECT doc_id, lang, source, CASE WHEN length(text) >= 200 THEN sha256(text) END AS sha FROM documents)
        SELECT doc_id, EXISTS (SELECT 1 FROM d AS h WHERE h.lang <> d.lang AND h.source = d.source AND (h.sha IS NULL OR d.sha IS NULL OR h.sha = d.sha)) AS is_held FROM d""",
    "turn_paths": """SELECT conv_id, turn, CAST(row_number() OVER w AS INTEGER) AS level, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS chars_on_path, count(*) OVER (PARTITION BY conv_id) AS n_turns
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
}
