"""Queries over pages, events, labels and the star schema, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import catalog, feed, tables
from ..sources.tables import table

# Prices of a ledger's events, and thresholds of page quality.
EXTERNAL_SCRIPT_BYTES, EMPTY_BODY, SCRIPT_RATIO, SCRIPT_BODY = 50_000, 500, 20, 2_000


def url_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's URL as a key, its host, and why it wouldn't be fetched."""
    p = table(spark, sf_dir, "pages").withColumn("key", X.key_url(F.col("url")))
    return p.select("page_id", "key", X.host_of(F.col("key")).alias("host"), F.coalesce(X.url_skip_code(F.col("key")), F.lit("ok")).alias("code"))


def page_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Script bytes (an external script counts as 50 kB), text length without tags, links and paragraphs of each page, and a verdict by ordered rules."""
    script = F.regexp_extract_all("html", F.lit(r"(?s)<script[^>]*>(.*?)</script>"), 1)
    bare = F.regexp_replace(F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), r"(?s)<[^>]*>", " ")
    p = table(spark, sf_dir, "pages").select(
        "page_id", (F.aggregate(script, F.lit(0), lambda a, x: a + F.length(x)) + EXTERNAL_SCRIPT_BYTES * F.regexp_count("html", F.lit("<script[^>]* src="))).cast("long").alias("script_chars"),
        F.length(F.trim(F.regexp_replace(bare, r"\s+", " "))).cast("long").alias("text_chars"), F.regexp_count("html", F.lit("<a ")).cast("long").alias("n_links"), F.regexp_count("html", F.lit("<p>")).cast("long").alias("n_paragraphs"),
    )
    heavy = (F.col("script_chars") / F.greatest("text_chars", F.lit(1)) > SCRIPT_RATIO) & (F.col("text_chars") < SCRIPT_BODY)
    return p.withColumn("verdict", F.when(F.col("text_chars") >= 1500, "ok").when(heavy, "client-rendered").when(F.col("text_chars") < EMPTY_BODY, "empty").otherwise("ok"))


def newest_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event of each user and type: latest, then greatest id."""
    return catalog.latest(table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


def stale_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user that are not the newest, with their place from the newest on."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(w).alias("place")).where("place > 1")


def event_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a feed of events leaves: each user's last value, without users whose last event is an error."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value", (F.col("event_type") == "error").alias("removed"))
    return feed.apply_changes(e, "user_id", ["ts", "event_id"]).select("user_id", "event_id", F.round("value", 6).alias("value"))


def admitted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by verdict and type at 25 January 2024: ten days back and one day ahead are let in."""
    e = feed.admission(table(spark, sf_dir, "events"), "ts", F.lit("2024-01-25").cast("timestamp"), "INTERVAL 10 DAYS", "INTERVAL 1 DAY")
    return e.groupBy("event_type", "verdict").agg(F.count("*").alias("n"))


def replayed_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of which a user's first of a type counts, and how many replays there were."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("f"), (F.count("*") - 1).alias("n_replays")).select("user_id", "event_type", "f.event_id", "n_replays")


def recent_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each event how many of its user lie less than an hour and less than a day back, and whether 2 and 5 are exceeded."""
    e = feed.counts_before(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", "ts", {"n_hour": 3600, "n_day": 86400})
    return e.select("event_id", "n_hour", "n_day", ((F.col("n_hour") > 2) | (F.col("n_day") > 5)).alias("over"))


def status_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose type differs from that of their user's event before."""
    return feed.changes_only(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type")


def spend_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spend of each user: purchases are charges and clicks reservations, of the user's day; a day without a charge counts at its reservation."""
    e = table(spark, sf_dir, "events").where("event_type IN ('purchase', 'click')")
    lines = e.select(F.concat_ws("/", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("id"), "user_id", F.when(F.col("event_type") == "purchase", "charge").otherwise("reserve").alias("type"), F.col("value").alias("cost"), F.struct("ts", "event_id").alias("place"))
    each = feed.ledger(lines).withColumn("user_id", F.split("id", "/")[0].cast("long"))
    return each.groupBy("user_id").agg(F.round(F.sum("cost"), 4).alias("spend"), F.count("*").alias("n_days"))


def suite_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of each source's scores, where toxic documents count as 0, over documents with labels; two levels: language, then source."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    each = d.groupBy("source", "lang").agg(F.avg(F.when(F.col("toxic") == 1, 0).otherwise(F.col("quality"))).alias("m"))
    return each.groupBy("source").agg(F.round(F.avg("m"), 6).alias("score"), F.count("*").alias("n_langs"))


def type_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median value of each event type, and the event nearest to it (the first on ties)."""
    e = table(spark, sf_dir, "events").where("value IS NOT NULL")
    m = catalog.medians(e, "event_type", "value").withColumnRenamed("median", "m")
    near = e.join(F.broadcast(m), "event_type")  # a row for each type
    return near.groupBy("event_type").agg(F.round(F.first("m"), 6).alias("median"), F.min(F.struct(F.abs(F.col("value") - F.col("m")), "event_id"))["event_id"].alias("nearest"))


def label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean absolute difference between quality and non-toxicity of each language, and whether it is 0.75 at most."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    mae = F.avg(F.abs(F.col("quality") - (1 - F.col("toxic"))))
    return d.groupBy("lang").agg(F.round(mae, 6).alias("mae"), (mae <= 0.75).alias("passes"), F.count("*").alias("n"))


def recent_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three newest orders of each priority: latest, then least key."""
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("place", F.row_number().over(w)).where("place <= 3").select("o_orderpriority", "o_orderkey", "place")


def customer_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by the segment of their customer; an order whose customer isn't in the positive part of the catalog is unfiled."""
    c = table(spark, sf_dir, "customer").where("c_acctbal >= 0").select("c_custkey", "c_mktsegment")
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    return o.join(c, o.o_custkey == c.c_custkey, "left").groupBy(F.coalesce("c_mktsegment", F.lit("unfiled")).alias("place")).agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def order_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose count of orders changed, or who came or went, between the years 1995 and 1996."""
    o = table(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate"))
    of = lambda y: o.where(F.col("y") == y).groupBy("o_custkey").agg(F.count("*").alias("n"))
    return catalog.catalog_diff(of(1995), of(1996), "o_custkey")


def merged_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity by return flag and status, summed over equal categories; position is the least order key."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_quantity").alias("value"), F.col("l_orderkey").alias("position"))
    return tables.merge_categories(rows, ["l_returnflag", "l_linestatus"]).withColumn("value", F.round("value", 2))


def folded_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices by brand and size: the 29 greatest categories in order of name, the rest as Other."""
    rows = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_brand", F.col("p_size").cast("string")).alias("category"), F.col("p_retailprice").cast("decimal(18,2)").alias("value"), F.col("p_partkey").cast("int").alias("position"))
    return tables.fold_categories(tables.merge_categories(rows, ["category"])).select("category", F.col("value").cast("double").alias("value"))


def capped_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly value of the four suppliers with the greatest mean of yearly prices."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("series"), F.year("l_shipdate").alias("category")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("value"))
    return tables.cap_series(rows).select("series", "category", "value")


def series_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by status and priority as one Markdown table for each status."""
    rows = table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    return tables.pipe_table(rows, "o_orderstatus", ["o_orderpriority", "n"], ["o_orderpriority"])


QUERIES = {f.__name__: f for f in (url_keys, page_signals, newest_claims, stale_claims, event_state, admitted_events, replayed_once, recent_counts, status_changes, spend_ledger, suite_scores, type_medians, label_agreement, recent_orders, customer_places, order_diff, merged_categories, folded_parts, capped_series, series_table)}

_KEY = r"regexp_replace(regexp_replace(trim(url), '^[<\"''](.*)[>\"'']$', '\1'), '#.*$', '')"
ORACLE_SQL = {
    "url_keys": rf"""WITH b AS (SELECT page_id, {_KEY} AS u FROM pages), f AS (SELECT page_id, CASE WHEN regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN u ELSE 'https://' || u END AS u FROM b),
        k AS (SELECT page_id, lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*')) || substr(u, length(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*')) + 1) AS key FROM f),
        h0 AS (SELECT page_id, key, lower(regexp_extract(key, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?(\[[^\]/]*\]|[^/:?#]+)', 1)) AS host0 FROM k), h AS (SELECT page_id, key, CASE WHEN length(host0) > 1 THEN regexp_replace(host0, '\.$', '') ELSE host0 END AS host FROM h0)
        SELECT page_id, key, host, CASE WHEN NOT regexp_matches(key, '^https?://') THEN 'unsupported-scheme' WHEN regexp_matches(key, '^[A-Za-z]+://[^/?#]*@') THEN 'has-credentials'
        WHEN regexp_matches(host, '^(localhost|.*\.local|.*\.internal|.*\.localhost)$') OR (regexp_full_match(host, '[0-9]{1,3}(\.[0-9]{1,3}){3}') AND regexp_matches(host, '^(0|10|127|192\.168|169\.254|172\.(1[6-9]|2[0-9]|3[01]))\.'))
        OR regexp_matches(host, '^\[(::1?|::ffff:(0|10|127|192\.168|169\.254|172\.(1[6-9]|2[0-9]|3[01]))\.[0-9.]+|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*)\]$') THEN 'private-host' ELSE 'ok' END AS code FROM h""",
    "page_signals": r"""WITH s AS (SELECT page_id, CAST(coalesce(list_sum(list_transform(regexp_extract_all(html, '(?s)<script[^>]*>(.*?)</script>', 1), lambda x: length(x))), 0) + 50000 * len(regexp_extract_all(html, '<script[^>]* src=')) AS BIGINT) AS script_chars,
        CAST(length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS BIGINT) AS text_chars,
        CAST(len(regexp_extract_all(html, '<a ')) AS BIGINT) AS n_links, CAST(len(regexp_extract_all(html, '<p>')) AS BIGINT) AS n_paragraphs FROM pages)
        SELECT *, CASE WHEN text_chars >= 1500 THEN 'ok' WHEN CAST(script_chars AS DOUBLE) / greatest(text_chars, 1) > 20 AND text_chars < 2000 THEN 'client-rendered' WHEN text_chars < 500 THEN 'empty' ELSE 'ok' END AS verdict FROM s""",
    "newest_claims": "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
    "stale_claims": "SELECT user_id, event_id, place FROM (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS place FROM events) WHERE place > 1",
    "event_state": "SELECT user_id, event_id, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error'",
    "admitted_events": "SELECT event_type, CASE WHEN ts < TIMESTAMP '2024-01-15' OR ts > TIMESTAMP '2024-01-26' THEN 'E_EXPIRED' ELSE 'ok' END AS verdict, count(*) AS n FROM events GROUP BY 1, 2",
    "replayed_once": "SELECT user_id, event_type, event_id, n - 1 AS n_replays FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events) WHERE r = 1",
    "recent_counts": """WITH c AS (SELECT a.event_id, count(*) FILTER (WHERE b.ts > a.ts - INTERVAL 1 HOUR) AS n_hour, count(*) AS n_day FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts <= a.ts AND b.ts > a.ts - INTERVAL 1 DAY GROUP BY a.event_id)
        SELECT event_id, n_hour, n_day, n_hour > 2 OR n_day > 5 AS over FROM c""",
    "status_changes": "SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER w AS b, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE n = 1 OR b IS DISTINCT FROM event_type",
    "spend_ledger": """WITH l AS (SELECT user_id, CAST(ts AS DATE) AS d, sum(CASE WHEN event_type = 'purchase' THEN value END) AS c, arg_max(value, (ts, event_id)) FILTER (WHERE event_type = 'click') AS r FROM events WHERE event_type IN ('purchase', 'click') GROUP BY 1, 2)
        SELECT user_id, round(sum(coalesce(c, r)), 4) AS spend, count(*) AS n_days FROM l GROUP BY user_id""",
    "suite_scores": """WITH e AS (SELECT source, lang, avg(CASE WHEN toxic = 1 THEN 0 ELSE quality END) AS m FROM documents JOIN labels USING (doc_id) GROUP BY source, lang)
        SELECT source, round(avg(m), 6) AS score, count(*) AS n_langs FROM e GROUP BY source""",
    "type_medians": """WITH m AS (SELECT event_type, median(value) AS m FROM events GROUP BY event_type), r AS (SELECT event_type, m, event_id, row_number() OVER (PARTITION BY event_type ORDER BY abs(value - m), event_id) AS r FROM events JOIN m USING (event_type) WHERE value IS NOT NULL)
        SELECT event_type, round(m, 6) AS median, event_id AS nearest FROM r WHERE r = 1""",
    "label_agreement": "SELECT lang, round(avg(abs(quality - (1 - toxic))), 6) AS mae, avg(abs(quality - (1 - toxic))) <= 0.75 AS passes, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang",
    "recent_orders": "SELECT o_orderpriority, o_orderkey, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) AS INTEGER) AS place FROM orders) WHERE place <= 3",
    "customer_places": "SELECT coalesce(c_mktsegment, 'unfiled') AS place, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) c ON o_custkey = c_custkey GROUP BY 1",
    "order_diff": """WITH a AS (SELECT o_custkey, count(*) AS n FROM orders WHERE year(o_orderdate) = 1995 GROUP BY 1), b AS (SELECT o_custkey, count(*) AS n FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1)
        SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, unnest(CASE WHEN a.o_custkey IS NULL THEN ['added'] WHEN b.o_custkey IS NULL THEN ['dropped'] ELSE ['changed', 'replaced'] END) AS change FROM a FULL JOIN b ON a.o_custkey = b.o_custkey WHERE a.n IS DISTINCT FROM b.n""",
    "merged_categories": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS value, min(l_orderkey) AS position FROM lineitem GROUP BY 1, 2",
    "folded_parts": """WITH c AS (SELECT p_brand || ' ' || p_size AS category, sum(CAST(p_retailprice AS DECIMAL(18, 2))) AS value, min(p_partkey) AS position FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY value DESC NULLS LAST, position) AS r FROM c)
        SELECT CASE WHEN r <= 29 THEN category ELSE 'Other' END AS category, CAST(sum(value) AS DOUBLE) AS value FROM r GROUP BY 1""",
    "capped_series": """WITH s AS (SELECT l_suppkey AS series, CAST(year(l_shipdate) AS INTEGER) AS category, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS value FROM lineitem GROUP BY 1, 2), m AS (SELECT series FROM s GROUP BY series ORDER BY avg(abs(value)) DESC NULLS LAST, series LIMIT 4)
        SELECT series, category, value FROM s JOIN m USING (series)""",
    "series_table": """WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)
        SELECT o_orderstatus, '| o_orderpriority | n |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || o_orderpriority || ' | ' || n || ' |', chr(10) ORDER BY o_orderpriority) AS markdown FROM c GROUP BY o_orderstatus""",
}
