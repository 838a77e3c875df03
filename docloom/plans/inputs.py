"""Queries over bytes, lines and listings made from the given tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import listings
from ..sources import payloads, rejects
from ..sources.tables import table


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as bytes in five encodings in turn: plain UTF-8, then three with marks, then windows-1252 with a tail of accents."""
    mark = lambda h: F.unhex(F.lit(h))
    n, html = F.col("page_id") % 5, F.col("html")
    latin = F.concat(F.regexp_replace(html, r"[^\x00-\x7F]", "?"), F.repeat(F.lit("é"), F.length("html")))
    content = F.when(n == 0, html.cast("binary")).when(n == 1, F.concat(mark("EFBBBF"), html.cast("binary"))).when(n == 2, F.concat(mark("FFFE"), F.encode(html, "UTF-16LE"))).when(n == 3, F.concat(mark("FEFF"), F.encode(html, "UTF-16BE")))
    return table(spark, sf_dir, "pages").select("page_id", content.otherwise(F.encode(latin, "ISO-8859-1")).alias("content"))


def decoded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding and text of each page from its bytes, the text as a hash."""
    return payloads.decoded(_payloads(spark, sf_dir)).select("page_id", "encoding", F.sha2("text", 256).alias("text_sha"))


def payload_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pages and documents are by their bytes: each seventh document begins like a PDF, each eleventh holds a zero byte."""
    text = F.coalesce("text", F.lit(""))
    content = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("%PDF-1.7 "), text)).when(F.col("doc_id") % 11 == 0, F.concat(text, F.unhex(F.lit("00")).cast("string"))).otherwise(text)
    docs = table(spark, sf_dir, "documents").select(F.lit("document").alias("what"), F.col("doc_id").alias("id"), content.cast("binary").alias("content"))
    pages = _payloads(spark, sf_dir).where("page_id % 5 < 2").select(F.lit("page").alias("what"), F.col("page_id").alias("id"), "content")
    return docs.unionByName(pages).select("what", "id", payloads.kind(F.col("content")).alias("kind"))


def order_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lines of twenty files, some of them spoilt: the code of each line that is rejected, and the price of each that is kept."""
    key, file = F.col("o_orderkey"), F.col("o_custkey") % 20
    price = F.when((key % 89 == 0) | ((file == 7) & (key % 3 < 2)), F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string"))
    whole = F.concat_ws(",", key, "o_custkey", "o_orderstatus", price)
    line = F.when(key % 83 == 0, " ").when(key % 97 == 0, F.concat_ws(",", key, "o_custkey", "o_orderstatus")).otherwise(whole)
    lines = table(spark, sf_dir, "orders").select(key.alias("key"), file.alias("file"), line.alias("line"))
    found = rejects.parsed(lines, rejects.T.StructType.fromDDL("orderkey long, custkey long, status string, price double"))
    return found.select("key", "file", "code", F.col("row.price").alias("price"))


def presence_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history of users over days as listings: a user with an event other than an error is live that day, one with errors alone is trashed."""
    events = table(spark, sf_dir, "events")
    first, last = events.agg(F.min(F.to_date("ts")), F.max(F.to_date("ts"))).first()  # two values
    day = F.datediff(F.to_date("ts"), F.lit(first)).alias("listing")
    seen = events.select(F.col("user_id").alias("doc"), day, F.when(F.col("event_type") == "error", listings.TRASHED).otherwise(listings.LIVE).alias("kind"))
    return listings.history(seen, (last - first).days if first else 0)


QUERIES = {f.__name__: f for f in (decoded_pages, payload_kinds, order_rejects, presence_history)}
ORACLE_SQL = {
    "decoded_pages": r"""SELECT page_id, ['utf-8', 'utf-8', 'utf-16le', 'utf-16be', 'windows-1252'][page_id % 5 + 1] AS encoding,
        sha256(CASE WHEN page_id % 5 < 4 THEN html ELSE regexp_replace(html, '[^\x00-\x7F]', '?', 'g') || repeat('é', length(html)) END) AS text_sha FROM pages""",
    "payload_kinds": r"""SELECT 'document' AS what, doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN 'pdf' WHEN doc_id % 11 = 0 THEN 'binary' WHEN regexp_matches(coalesce(text, ''), '^\s*<(!doctype\s+html|html[\s>])', 'i') THEN 'html' ELSE 'text' END AS kind FROM documents
        UNION ALL SELECT 'page', page_id, CASE WHEN regexp_matches(html, '^\s*<(!doctype\s+html|html[\s>])', 'i') THEN 'html' ELSE 'text' END FROM pages WHERE page_id % 5 < 2""",
    "order_rejects": """WITH o AS (SELECT o_orderkey AS key, o_custkey % 20 AS file, o_totalprice AS price,
        CASE WHEN o_orderkey % 83 = 0 THEN 'E_EMPTY' WHEN o_orderkey % 97 = 0 THEN 'E_FIELDS' WHEN o_orderkey % 89 = 0 OR (o_custkey % 20 = 7 AND o_orderkey % 3 < 2) THEN 'E_VALUE' END AS own FROM orders),
        f AS (SELECT file, count(own) > 0.5 * count(*) AS bad FROM o GROUP BY file), c AS (SELECT key, file, price, coalesce(own, CASE WHEN bad THEN 'E_FILE' END) AS code FROM o JOIN f USING (file))
        SELECT key, file, code, CASE WHEN code IS NULL THEN price END AS price FROM c""",
    "presence_history": """WITH e AS (SELECT user_id AS doc, date_diff('day', (SELECT min(CAST(ts AS DATE)) FROM events), CAST(ts AS DATE)) AS n, event_type FROM events), s AS (SELECT doc, n, CASE WHEN bool_or(event_type <> 'error') THEN 'live' ELSE 'trashed' END AS state FROM e GROUP BY doc, n),
        w AS (SELECT *, lead(n) OVER l AS following, lag(n) OVER l AS before, lag(state) OVER l AS was FROM s WINDOW l AS (PARTITION BY doc ORDER BY n)),
        r AS (SELECT doc, state, n AS valid_from FROM w WHERE before IS NULL OR before < n - 1 OR was <> state
              UNION ALL SELECT doc, CASE state WHEN 'trashed' THEN 'purged' ELSE 'absent' END, n + 1 FROM w WHERE coalesce(following, (SELECT max(n) + 1 FROM s)) > n + 1)
        SELECT doc, state, CAST(valid_from AS BIGINT) AS valid_from, CAST(lead(valid_from) OVER (PARTITION BY doc ORDER BY valid_from) AS BIGINT) AS valid_to FROM r""",
}
