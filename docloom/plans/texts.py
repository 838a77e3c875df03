"""Queries over the blocks, sentences and links of texts, and the limiter, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import limits
from ..sources.tables import table

# What begins a list item, and the length of a summary in sentences and characters.
BULLET = r"^\s*(?:[-*•]|[0-9]{1,3}[.)])\s+\S"
SUMMARY_SENTENCES, SUMMARY_CHARS = 2, 300
# A text is garbage where over this share is private-use or replacement characters.
GARBAGE, GARBAGE_SHARE = r"[\x{E000}-\x{F8FF}\x{FFFD}]", 0.3


def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks between blank lines of each document: paragraphs, lists (each line is an item) and the items of those."""
    blocks = F.filter(F.split("text", r"\n[^\S\n]*\n"), lambda b: b.rlike(r"\S"))
    lines = F.transform(blocks, lambda b: F.filter(F.split(b, "\n"), lambda x: x.rlike(r"\S")))
    lists = F.filter(lines, lambda b: F.forall(b, lambda x: x.rlike(BULLET)))
    d = table(spark, sf_dir, "documents").select("doc_id", F.size(blocks).alias("n"), lists.alias("l"))
    return d.select("doc_id", (F.col("n") - F.size("l")).cast("long").alias("n_paragraphs"), F.size("l").cast("long").alias("n_lists"), F.size(F.flatten("l")).cast("long").alias("n_items"))


def outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sentence of each document and all that state a number, each once, in order."""
    kept = F.array_distinct(F.filter(X.sentences(F.col("text")), lambda s, i: (i == 0) | s.rlike("[0-9]")))
    return table(spark, sf_dir, "documents").select("doc_id", kept.alias("k")).select("doc_id", F.size("k").cast("long").alias("n_kept"), F.sha2(F.array_join("k", "\n"), 256).alias("outline_sha"))


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two sentences of each document, 300 characters at most."""
    s = F.substring(F.array_join(F.slice(X.sentences(F.col("text")), 1, SUMMARY_SENTENCES), " "), 1, SUMMARY_CHARS)
    return table(spark, sf_dir, "documents").select("doc_id", s.alias("summary"))


def garbage_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many characters of each document no reader can show, and whether those are over 30 %."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"), F.regexp_count("text", F.lit(GARBAGE)).cast("long").alias("n_bad"))
    return d.select("doc_id", "n_bad", (F.col("n_bad") > F.col("n") * GARBAGE_SHARE).alias("is_garbage"))


def running_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last lines of each source's documents, digits read as #, that three documents or more have, and whether over half have them."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.split("text", "\n").alias("l"))
    ends = F.array_distinct(F.transform(F.array(F.element_at("l", 1), F.element_at("l", -1)), lambda x: F.regexp_replace(x, "[0-9]", "#")))
    lines = docs.select("source", F.explode(ends).alias("line")).groupBy("source", "line").agg(F.count("*").alias("n_docs")).where("n_docs >= 3")
    total = docs.groupBy("source").agg(F.count("*").alias("n"))
    return lines.join(total, "source").select("source", F.sha2("line", 256).alias("line_sha"), "n_docs", (F.col("n_docs") * 2 > F.col("n")).alias("runs"))


def version_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An id of each document's content that is the same whenever it is made."""
    parts = F.concat_ws("\0", F.col("source"), F.col("lang"), F.sha2("text", 256))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("v-"), F.substring(F.sha2(parts, 256), 1, 12)).alias("version_id"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct link targets of each page, by kind."""
    href = F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)))
    links = table(spark, sf_dir, "pages").select("page_id", href.alias("href"))
    kind = F.when(F.col("href").rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), "absolute").when(F.col("href").startswith("//"), "scheme-relative").when(F.col("href").startswith("/"), "rooted").when(F.col("href").startswith("#"), "fragment").otherwise("relative")
    return links.groupBy("page_id", kind.alias("kind")).agg(F.count("*").alias("n_links"))


def limited_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with whether a limiter of two accepted ones in twelve hours for each user lets them in."""
    return limits.rate_limited(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 2, 12 * 3600).select("user_id", "event_id", "accepted")


def doubly_limited_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As limited_events, but three accepted ones in three days at most as well."""
    return limits.limited_within(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", [(2, 12 * 3600), (3, 72 * 3600)]).select("user_id", "event_id", "accepted")


QUERIES = {f.__name__: f for f in (text_blocks, outlines, summaries, garbage_texts, running_lines, version_ids, page_links, limited_events, doubly_limited_events)}

_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+|\n+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"
ORACLE_SQL = {
    "text_blocks": rf"""WITH b AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\n[^\S\n]*\n'), lambda b: regexp_matches(b, '\S')) AS b FROM documents),
        l AS (SELECT doc_id, len(b) AS n, list_filter(list_transform(b, lambda x: list_filter(string_split(x, chr(10)), lambda y: regexp_matches(y, '\S'))), lambda x: len(list_filter(x, lambda y: NOT regexp_matches(y, '{BULLET}'))) = 0) AS l FROM b)
        SELECT doc_id, n - len(l) AS n_paragraphs, len(l) AS n_lists, len(flatten(l)) AS n_items FROM l""",
    "outlines": f"""WITH s AS (SELECT doc_id, {_SENTENCES} AS s FROM documents), k AS (SELECT doc_id, list_filter(s, lambda x, i: i = 1 OR regexp_matches(x, '[0-9]')) AS k FROM s),
        d AS (SELECT doc_id, list_filter(k, lambda x, i: list_position(k, x) = i) AS k FROM k)
        SELECT doc_id, len(k) AS n_kept, sha256(array_to_string(k, chr(10))) AS outline_sha FROM d""",
    "summaries": f"SELECT doc_id, substr(array_to_string({_SENTENCES}[1:2], ' '), 1, 300) AS summary FROM documents",
    "garbage_texts": r"""WITH d AS (SELECT doc_id, length(text) AS n, length(text) - length(regexp_replace(text, '[\x{E000}-\x{F8FF}\x{FFFD}]', '', 'g')) AS n_bad FROM documents)
        SELECT doc_id, n_bad, n_bad > n * 0.3 AS is_garbage FROM d""",
    "running_lines": """WITH d AS (SELECT source, doc_id, string_split(text, chr(10)) AS l FROM documents), n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
        e AS (SELECT DISTINCT source, doc_id, regexp_replace(unnest([l[1], l[-1]]), '[0-9]', '#', 'g') AS line FROM d)
        SELECT source, sha256(line) AS line_sha, count(*) AS n_docs, count(*) * 2 > any_value(n) AS runs FROM e JOIN n USING (source) GROUP BY source, line HAVING count(*) >= 3""",
    "version_ids": "SELECT doc_id, 'v-' || substr(sha256(source || chr(0) || lang || chr(0) || sha256(text)), 1, 12) AS version_id FROM documents",
    "page_links": """WITH l AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href FROM pages)
        SELECT page_id, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN 'absolute' WHEN starts_with(href, '//') THEN 'scheme-relative' WHEN starts_with(href, '/') THEN 'rooted' WHEN starts_with(href, '#') THEN 'fragment' ELSE 'relative' END AS kind, count(*) AS n_links FROM l GROUP BY 1, 2""",
}
