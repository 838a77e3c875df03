"""Queries over JSON documents made from the given tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import json_docs
from ..sources.tables import table


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a document: who ordered, when, at what price, its lines as an array, and an object that is empty for some."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part")))).alias("lines"))
    orders = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    note = F.when(F.col("o_orderkey") % 3 > 0, F.struct(F.when(F.col("o_orderkey") % 3 == 1, F.col("o_orderpriority")).alias("urgency")))
    doc = F.struct(F.struct(F.struct(F.col("o_custkey").alias("key")).alias("customer"), F.col("o_orderstatus").alias("status")).alias("order"), F.coalesce("lines", F.array()).alias("lines"), F.coalesce(note, F.struct(F.lit(None).cast("string").alias("urgency"))).alias("note"))
    return orders.select("o_orderkey", F.to_json(doc).alias("doc"))  # members that are null are left out, so that a note may be empty


def order_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dotted path and the value of each leaf of the orders."""
    found = json_docs.leaves(_orders(spark, sf_dir), "o_orderkey", "doc")
    return found.select("o_orderkey", json_docs.dotted(F.col("path")).alias("path"), "value")


def _settings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Leaves of each customer as settings, and of changes of four kinds to be laid over them."""
    key = F.col("c_custkey")
    own = F.to_json(F.struct(F.struct(F.struct(F.col("c_nationkey").alias("nation")).alias("address"), F.col("c_name").alias("name")).alias("contact"), F.col("c_mktsegment").alias("segment"), F.struct().alias("tags")))
    kinds = (F.lit('{"contact":{"address":"none"},"tags":{"a":[1]}}'), F.format_string('{"contact":{"address":{"zip":%d}},"segment":null}', key), F.format_string('{"contact":{},"rank":%d,"segment":{"x":{}}}', key), F.lit("{}"))
    change = F.when(key % 4 == 0, kinds[0]).when(key % 4 == 1, kinds[1]).when(key % 4 == 2, kinds[2]).otherwise(kinds[3])
    docs = table(spark, sf_dir, "customer").select("c_custkey", own.alias("own"), change.alias("change"))
    return json_docs.leaves(docs, "c_custkey", "own"), json_docs.leaves(docs, "c_custkey", "change")


def merged_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's settings with the changes laid over them, as JSON text."""
    own, change = _settings(spark, sf_dir)
    return json_docs.texts(json_docs.merged(own, change, "c_custkey"), "c_custkey")


def changed_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaves of the customers' settings that differ once the changes are laid over them."""
    own, change = _settings(spark, sf_dir)
    found = json_docs.changed(own, json_docs.merged(own, change, "c_custkey"), "c_custkey")
    return found.select("c_custkey", json_docs.dotted(F.col("path")).alias("path"), "before", "after")


def event_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of each event's content without its number and time, whatever the order of its members."""
    doc = F.format_string('{ "type" : "%s", "seq": %d, "props": %s, "at": "%s" }', "event_type", "event_id", F.coalesce("props", F.lit("null")), F.col("ts").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", json_docs.content_hash(doc, ("seq", "at")).alias("content_hash"))


def _digest() -> Column:
    """A random token for each text."""
    return F.translate(F.base64(F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))), "/", "-")


def secret_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of what looks like a secret in documents as settings: a digest as it stands, as part of a folder's path or in a list, and values with telling names."""
    kind, text = F.col("doc_id") % 4, F.coalesce("text", F.lit(""))
    value = F.when(kind == 0, _digest()).when(kind == 1, F.concat(F.lit("/srv/"), _digest(), F.lit("/x"))).when(kind == 2, F.concat(F.lit("a b "), _digest())).otherwise(F.col("lang"))
    store = F.struct(value.alias("folder"), F.array(F.lit("plain"), value).alias("list"), F.when(kind < 3, F.lit("")).otherwise(F.col("source")).alias("Api_Key"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct(store.alias("store"), F.struct(F.lit(False).alias("token"), text.alias("text")).alias("body"))).alias("doc"))
    found = json_docs.secret_paths(json_docs.leaves(docs, "doc_id", "doc"), "doc_id")
    return found.select("doc_id", json_docs.dotted(F.col("path")).alias("path"))


def redacted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a random token and keys of two shapes put behind their text, redacted: what they end with, how much was cut, and a hash."""
    key = F.concat(F.lit(" AKIA"), F.upper(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 16)), F.lit(" sk-"), F.sha2(F.coalesce("text", F.lit("")), 256), F.lit("\n"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), key, _digest()).alias("text"))
    out = docs.select("doc_id", "text", R.redacted(F.col("text")).alias("redacted"))
    return out.select("doc_id", F.regexp_count("redacted", F.lit(r"\[REDACTED\]")).cast("long").alias("n_redacted"), F.sha2("redacted", 256).alias("redacted_sha"))


QUERIES = {f.__name__: f for f in (order_leaves, merged_settings, changed_settings, event_hashes, secret_settings, redacted_texts)}
_ENTROPY = "list_sum(list_transform(list_distinct(string_split({v}, '')), lambda c: -((length({v}) - length(replace({v}, c, ''))) / CAST(length({v}) AS DOUBLE)) * log2((length({v}) - length(replace({v}, c, ''))) / CAST(length({v}) AS DOUBLE))))"
_DIGEST = "replace(base64(unhex(sha256(coalesce(text, '')))), '/', '-')"


def _cut(text: str) -> str:
    """SQL of a text without keys of the shapes that are redacted, one shape after another."""
    for shape in R.REDACTED_SHAPES:
        text = f"regexp_replace({text}, '{shape}', '[REDACTED]', 'g')"
    return text


ORACLE_SQL = {
    "order_leaves": """WITH l AS (SELECT l_orderkey, '[' || string_agg('{"n":' || l_linenumber || ',"part":' || l_partkey || '}', ',' ORDER BY l_linenumber, l_partkey) || ']' AS lines FROM lineitem GROUP BY l_orderkey)
        SELECT o_orderkey, 'order.customer.key' AS path, CAST(o_custkey AS VARCHAR) AS value FROM orders UNION ALL SELECT o_orderkey, 'order.status', '"' || o_orderstatus || '"' FROM orders
        UNION ALL SELECT o_orderkey, 'lines', coalesce(lines, '[]') FROM orders LEFT JOIN l ON l_orderkey = o_orderkey
        UNION ALL SELECT o_orderkey, CASE o_orderkey % 3 WHEN 1 THEN 'note.urgency' ELSE 'note' END, CASE o_orderkey % 3 WHEN 1 THEN '"' || o_orderpriority || '"' ELSE '{}' END FROM orders""",
    "merged_settings": """SELECT c_custkey, CASE c_custkey % 4
        WHEN 0 THEN '{"contact":{"address":"none","name":"' || c_name || '"},"segment":"' || c_mktsegment || '","tags":{"a":[1]}}'
        WHEN 1 THEN '{"contact":{"address":{"nation":' || c_nationkey || ',"zip":' || c_custkey || '},"name":"' || c_name || '"},"segment":null,"tags":{}}'
        WHEN 2 THEN '{"contact":{"address":{"nation":' || c_nationkey || '},"name":"' || c_name || '"},"rank":' || c_custkey || ',"segment":{"x":{}},"tags":{}}'
        ELSE '{"contact":{"address":{"nation":' || c_nationkey || '},"name":"' || c_name || '"},"segment":"' || c_mktsegment || '","tags":{}}' END AS text FROM customer""",
    "changed_settings": """WITH c AS (SELECT *, CAST(c_nationkey AS VARCHAR) AS n, '"' || c_mktsegment || '"' AS s, CAST(c_custkey AS VARCHAR) AS k, c_custkey % 4 AS kind FROM customer)
        SELECT c_custkey, 'contact.address.nation' AS path, n AS before, NULL AS after FROM c WHERE kind = 0 UNION ALL SELECT c_custkey, 'contact.address', NULL, '"none"' FROM c WHERE kind = 0
        UNION ALL SELECT c_custkey, 'tags', '{}', NULL FROM c WHERE kind = 0 UNION ALL SELECT c_custkey, 'tags.a', NULL, '[1]' FROM c WHERE kind = 0
        UNION ALL SELECT c_custkey, 'contact.address.zip', NULL, k FROM c WHERE kind = 1 UNION ALL SELECT c_custkey, 'segment', s, 'null' FROM c WHERE kind = 1
        UNION ALL SELECT c_custkey, 'rank', NULL, k FROM c WHERE kind = 2 UNION ALL SELECT c_custkey, 'segment', s, NULL FROM c WHERE kind = 2 UNION ALL SELECT c_custkey, 'segment.x', NULL, '{}' FROM c WHERE kind = 2""",
    "event_hashes": """SELECT event_id, sha256('{"props":' || coalesce(replace(props, ' ', ''), 'null') || ',"type":"' || event_type || '"}') AS content_hash FROM events""",
    "secret_settings": f"""WITH d AS (SELECT doc_id, doc_id % 4 AS kind, {_DIGEST} AS digest FROM documents),
        h AS (SELECT doc_id FROM d WHERE kind < 2 AND {_ENTROPY.format(v="digest")} > 4.5)
        SELECT doc_id, 'store.folder' AS path FROM h UNION ALL SELECT doc_id, 'store.list' FROM h UNION ALL SELECT doc_id, 'store.Api_Key' FROM d WHERE kind = 3""",
    "redacted_texts": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256(coalesce(text, '')) AS h, {_DIGEST} AS v FROM documents),
        s AS (SELECT doc_id, {_cut("text || ' AKIA' || upper(substr(h, 1, 16)) || ' sk-' || h || chr(10) || v")} AS t FROM d),
        r AS (SELECT doc_id, array_to_string(list_transform(regexp_extract_all(t, '[^{R.BLANK}]+|[{R.BLANK}]+'), lambda w: CASE WHEN length(w) >= {R.TOKEN_LENGTH} AND NOT regexp_matches(w, '^[{R.BLANK}]')
          THEN CASE WHEN {_ENTROPY.format(v="w")} > {R.TOKEN_ENTROPY} THEN '[REDACTED]' ELSE w END ELSE w END), '') AS x FROM s)
        SELECT doc_id, CAST((length(x) - length(replace(x, '[REDACTED]', ''))) // 10 AS BIGINT) AS n_redacted, sha256(x) AS redacted_sha FROM r""",
}
