"""Queries over terms in texts, budgets, lanes and hosts, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import budgets, substrings, suffixes
from ..sources.tables import table

MOST, MOST_BYTES, HELD, ANNOUNCED, SLOTS = 60, 80_000, 500, 8, 3
# Suffix rules for the hosts of the given pages, one of each kind.
RULES = ("com", "net", "org", "example.net", "*.example.com", "!blog.example.com", "co.uk")


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two words of each sentence of the benchmark."""
    each = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", r"[.!?\n]+\s*")).alias("s"))
    return each.select(F.lower(F.regexp_extract("s", r"^([A-Za-z]+ [A-Za-z]+)", 1)).alias("term")).where("term <> ''").distinct()


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")


def term_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many documents each term of the benchmark is named; terms that none names aren't listed."""
    return substrings.mentions(_texts(spark, sf_dir), _terms(spark, sf_dir)).groupBy("term").agg(F.count("*").alias("n_docs"))


def unmentioned_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of the benchmark that no English document names."""
    docs = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("key"), "text")
    return substrings.unmentioned(docs, _terms(spark, sf_dir))


def documents_without_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that name no term of the benchmark."""
    texts = _texts(spark, sf_dir)
    return texts.select("key").join(substrings.mentions(texts, _terms(spark, sf_dir)).select("key").distinct(), "key", "left_anti").select(F.col("key").alias("doc_id"))


def image_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as requests to the budget of their source in order of id: those in English have priority, and each tenth row gives back what it would take."""
    kind = F.when(F.col("doc_id") % 10 == 3, budgets.RELEASE).when(F.col("lang") == "en", budgets.PRIORITY).otherwise(budgets.REQUEST)
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("job"), F.col("doc_id").alias("place"), kind.alias("kind"), F.octet_length("text").alias("bytes"), F.lit(ANNOUNCED).alias("announced"))
    return budgets.admitted(rows, MOST, MOST_BYTES, HELD)


def queue_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders as jobs that wait in the lane of their customer's last digit; orders in process run there."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 10).alias("lane"), F.col("o_orderdate").alias("at"), "o_orderstatus")
    lanes = orders.groupBy("lane").agg(F.count_if((F.col("o_orderstatus") == "P") & (F.col("id") % 50 == 0)).alias("running"), F.lit(SLOTS).alias("slots"))
    return budgets.queue_positions(orders.where("o_orderstatus = 'O'"), lanes)


def host_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registrable part of each page's host."""
    pages = table(spark, sf_dir, "pages").select("page_id", X.host_of(F.col("url")).alias("host"))
    return suffixes.host_keys(pages, spark.createDataFrame([(r,) for r in RULES], "rule string"))


_TERMS = r"""t AS (SELECT DISTINCT term, regexp_replace(term, 's$', '') AS stem FROM (SELECT lower(regexp_extract(s, '^([A-Za-z]+ [A-Za-z]+)', 1)) AS term FROM (SELECT unnest(regexp_split_to_array(text, '[.!?\n]+\s*')) AS s FROM benchmark)) WHERE term <> ''),
d AS (SELECT doc_id, lang, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS x FROM documents)"""
_RULES = ", ".join(f"('{r.removeprefix('*.').removeprefix('!')}', {1 if r[0] == '*' else -1 if r[0] == '!' else 0})" for r in RULES)
QUERIES = {f.__name__: f for f in (term_mentions, unmentioned_terms, documents_without_terms, image_budget, queue_positions, host_keys)}
ORACLE_SQL = {
    "term_mentions": f"WITH {_TERMS} SELECT term, count(*) AS n_docs FROM t JOIN d ON contains(x, stem) GROUP BY term",
    "unmentioned_terms": f"WITH {_TERMS} SELECT term FROM t WHERE NOT EXISTS (SELECT 1 FROM d WHERE lang = 'en' AND contains(x, stem))",
    "documents_without_terms": f"WITH {_TERMS} SELECT doc_id FROM d WHERE NOT EXISTS (SELECT 1 FROM t WHERE contains(x, stem))",
    "image_budget": f"""WITH RECURSIVE q AS (SELECT source AS job, doc_id AS place, CASE WHEN doc_id % 10 = 3 THEN 'release' WHEN lang = 'en' THEN 'priority' ELSE 'request' END AS kind, CAST(octet_length(encode(text)) AS BIGINT) AS b,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
r AS (SELECT job, place, kind, n, b, CAST(NULL AS BOOLEAN) AS ok, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS size, CAST({ANNOUNCED} AS BIGINT) AS pending FROM (SELECT DISTINCT job, CAST(NULL AS BIGINT) AS place, '' AS kind, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS b FROM q)
  UNION ALL SELECT job, place, kind, n, b, ok, CASE WHEN kind = 'release' THEN greatest(0, used - 1) WHEN ok THEN used + 1 ELSE used END, CASE WHEN kind = 'release' THEN greatest(0, size - b) WHEN ok THEN size + b ELSE size END,
    CASE WHEN ok AND kind = 'priority' AND pending > 0 THEN pending - 1 ELSE pending END
  FROM (SELECT q.job, q.place, q.kind, q.n, q.b, r.used, r.size, r.pending, CASE q.kind WHEN 'release' THEN NULL WHEN 'priority' THEN r.used + 1 <= {MOST} AND r.size + q.b <= {MOST_BYTES}
    ELSE r.used + r.pending + 1 <= {MOST} AND r.size + r.pending * {HELD} + q.b <= {MOST_BYTES} END AS ok FROM r JOIN q ON q.job = r.job AND q.n = r.n + 1))
SELECT job, place, kind, ok AS admitted, used, size AS used_bytes FROM r WHERE n > 0""",
    "queue_positions": f"""WITH o AS (SELECT o_orderkey AS id, o_custkey % 10 AS lane, o_orderdate AS t, o_orderstatus AS s FROM orders), l AS (SELECT lane, count(*) FILTER (WHERE s = 'P' AND id % 50 = 0) AS running FROM o GROUP BY lane),
w AS (SELECT id, lane, row_number() OVER (PARTITION BY lane ORDER BY t, id) - 1 AS i FROM o WHERE s = 'O')
SELECT id, lane, CAST(CASE WHEN i < {SLOTS} - running THEN 0 ELSE i + greatest(1, running - {SLOTS} + 1) END AS BIGINT) AS position FROM w JOIN l USING (lane)""",
    "host_keys": rf"""WITH p AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?(\[[^\]/]*\]|[^/:?#]+)', 1)), '\.$', '') AS host FROM pages),
h AS (SELECT DISTINCT host, string_split(host, '.') AS l FROM p WHERE contains(host, '.') AND NOT regexp_matches(host, '^([0-9]{{1,3}}(\.[0-9]{{1,3}}){{3}}|\[.*\])$')),
s AS (SELECT host, l, i, array_to_string(l[i:], '.') AS tail FROM (SELECT host, l, unnest(range(1, len(l) + 1)) AS i FROM h)),
m AS (SELECT host, max({{'e': more < 0, 'n': len(l) - i + 1 + more}}) AS m FROM s JOIN (VALUES {_RULES}) AS r(rule, more) ON rule = tail WHERE i > more GROUP BY host),
k AS (SELECT h.host, array_to_string(l[greatest(1, len(l) - coalesce(m.m.n, 1)):], '.') AS host_key FROM h LEFT JOIN m USING (host))
SELECT page_id, host, coalesce(host_key, host) AS host_key FROM p LEFT JOIN k USING (host)""",
}
