"""Queries that keep sets of rows in step, pick, cap and route them, with the SQL that gives the same rows.

The tables hold no devices, jobs or claims: events stand for them (a user is a device, an event a job, a file or a claim), orders for a catalog.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as X
from ..operators import catalog, sync
from ..operators.running import grouped_running, running_sum
from ..sources.tables import table

# Sources of a job and their bytes, sections of a document, lanes of hosts and paths in order, images of a source and their least edge.
MOST_SOURCES, MOST_BYTES, SECTIONS = 50, 500 * 2**20, 40
LANES = [("wiki", "host", r"^wiki\..+$"), ("deep", "path", r"^/[^/]*/[^/]+/.*"), ("numbered", "path", r"^/[a-z]{2}/[0-9]+"), ("paged", "url", r"[?&]page=[0-9]+")]
LEAST_EDGE, MOST_IMAGES, POOR_TEXT, MOST_COPIES = 64, 8, 25, 2
NOW = 1_706_659_200  # 31 January 2024


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))


def resolved_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the sources of one job, in order: copies are notes of the first, and from the first source beyond 50 or 500 MiB on all are skipped."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"))
    marked = catalog.first_of_each(d, F.col("sha"), ["doc_id"])
    heads = running_sum(marked.where("first").select("doc_id", "bytes", F.lit(1).alias("one")), ["doc_id"], {"n": "one", "total": "bytes"})
    fits = (F.col("n") <= MOST_SOURCES) & (F.col("total") <= MOST_BYTES)
    heads = heads.select("doc_id", F.when(fits, F.concat(F.lit("src-"), F.lpad((F.col("n") - 1).cast("string"), 2, "0"))).alias("id"), fits.alias("fits"))
    rows = marked.select("doc_id", F.col("of").alias("first_id"), "first").join(heads.withColumnRenamed("doc_id", "first_id"), "first_id")
    return rows.select("doc_id", F.when(F.col("fits") & F.col("first"), "kept").when(F.col("fits"), "duplicate").otherwise("limit-exceeded").alias("outcome"), "id")


def repaired_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length as an id that should be one document's: the least doc_id keeps it, others get a new one made from both."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("string").alias("id"))
    new = F.concat(F.lit("d-"), F.substring(F.sha2(F.concat_ws(":", "id", F.col("doc_id").cast("string")), 256), 1, 8))
    return catalog.first_of_each(d, F.col("id"), ["doc_id"]).select("doc_id", F.when(F.col("first"), F.col("id")).otherwise(new).alias("id"))


def catalog_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as catalog entries: only named fields, and how many lines and parts they have."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.count_distinct("l_partkey").alias("n_parts"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return o.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "o_orderstatus", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("n_parts", F.lit(0)).alias("n_parts"))


def log_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allowed keys of each event's properties, values cut to 200 characters."""
    allowed = F.map_filter(F.from_json("props", "map<string,string>"), lambda k, v: k.isin("k", "kind", "ms"))
    return table(spark, sf_dir, "events").select("event_id", F.explode(allowed).alias("key", "v")).select("event_id", "key", F.substring("v", 1, 200).alias("value"))


def folder_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one source in which a word begins with each of the terms, or which hold all terms anywhere."""
    terms = F.array(F.lit("th"), F.lit("ere"))
    d = table(spark, sf_dir, "documents").where("source = 'src1'").select("doc_id", F.lower("text").alias("t"), X.tokens(F.col("text")).alias("w"))
    by_word = F.forall(terms, lambda q: F.exists("w", lambda w: F.startswith(w, q)))
    anywhere = F.forall(terms, lambda q: F.contains(F.col("t"), q))
    return d.select("doc_id", by_word.alias("by_word"), anywhere.alias("anywhere")).where("by_word OR anywhere")


def stored_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is stored of each page's URL: without credentials and fragment, and redacted without its query too."""
    full = F.regexp_replace(F.regexp_replace("url", r"#.*$", ""), r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/@]*@", "$1")
    return table(spark, sf_dir, "pages").select("page_id", full.alias("full_ref"), F.regexp_replace(full, r"\?.*$", "").alias("redacted_ref"))


def merge_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event of each user with the best score (its value over 100, at most 1) from 0.75 on; the newest of equal ones."""
    e = _events(spark, sf_dir).select("user_id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 100)).alias("score"), "at", "event_id").where("score >= 0.75")
    best = e.groupBy("user_id").agg(F.max(F.struct("score", "at", "event_id")).alias("b"))
    return best.select("user_id", "b.event_id", F.round("b.score", 6).alias("score"))


def newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each order, newest first, then by key."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (-F.unix_seconds(F.col("o_orderdate").cast("timestamp"))).alias("age"), F.lit(1).alias("one"))
    return running_sum(o, ["age", "o_orderkey"], {"place": "one"}).select("o_orderkey", F.col("place").cast("long").alias("place"))


def synced_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders held locally merged with those listed remotely, of which some are new, changed, replaced or gone."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("sha"))
    local = o.where("key % 3 <> 0").select("key", "sha", (F.col("key") % 2 == 0).alias("pinned"), F.lit(False).alias("unread"))
    remote = o.where("key % 4 <> 0").select("key", F.when(F.col("key") % 5 == 0, F.lit("new")).otherwise(F.col("sha")).alias("sha"), F.when(F.col("key") % 3 == 0, F.col("key") + 1).alias("replaces"))
    return sync.merged_catalog(local, remote)


def accepted_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event of each user and type, if it is beyond the fortieth of its ids seen before."""
    e = _events(spark, sf_dir).select(F.concat_ws("/", "user_id", "event_type").alias("key"), F.when(F.col("event_id") % 50 != 0, F.col("event_id")).alias("n"), F.col("event_id").alias("id"))
    return sync.newest_accepted(e, e.where("id % 40 < 20").select("key", "n"))


def device_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Role of each user that claims an event type at the end of 30 January 2024, with four hours of silence."""
    e = _events(spark, sf_dir)
    claims = e.where("event_id % 7 = 0").select(F.col("event_type").alias("account"), F.col("user_id").alias("device"), F.col("at").alias("ms"), F.col("event_id").alias("file"))
    role = F.element_at(F.array(F.lit("primary"), F.lit("mirror"), F.lit("phone"), F.lit("primary")), (F.col("device") % 4 + 1).cast("int"))
    devices = e.groupBy(F.col("user_id").alias("device")).agg(F.max("at").alias("seen")).where("device % 5 <> 0").select("device", role.alias("role"), "seen")
    return sync.roles(claims, devices, NOW, 4 * 3600)


def collected_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as files that may be collected at 15 February 2024, by reason."""
    e, now = _events(spark, sf_dir), NOW + 15 * sync.DAY
    kinds = F.element_at(F.array(*map(F.lit, ("job", "status", "att", "device", "claim", "acks"))), (F.col("event_id") % 6 + 1).cast("int"))
    files = e.select(F.col("event_id").alias("file"), kinds.alias("kind"), F.col("user_id").alias("device"), F.floor(F.col("event_id") / 6).alias("ref"), "at")
    terminal = e.where("event_type IN ('purchase', 'error')").select(F.floor(F.col("event_id") / 6).alias("job"), "at").groupBy("job").agg(F.max("at").alias("at"))
    senders = e.where("event_id % 6 = 0 AND event_id % 5 <> 0").select(F.floor(F.col("event_id") / 6).alias("job"), F.col("user_id").alias("device"))
    acks = e.where("event_type = 'click'").select(F.floor(F.col("event_id") / 6).alias("job"), F.col("user_id").alias("device"))
    uses = e.where("event_id % 6 = 1").select(F.floor(F.col("event_id") / 6).alias("job"), F.floor(F.col("event_id") / 12).alias("sha"))
    silent = e.groupBy(F.col("user_id").alias("device")).agg(F.max("at").alias("seen")).where(F.col("seen") < NOW - 2 * 3600)
    return sync.collection(files, sync.done_jobs(terminal, senders, acks, now), uses, silent, now)


def written_acks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user acknowledges: the newest ten purchases, in order of id, as a hash that changes only if they do."""
    return sync.acknowledged(_events(spark, sf_dir).where("event_type = 'purchase'").select(F.col("user_id").alias("device"), F.col("event_id").alias("id"), "at"), 10)


def purged_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose id is no filled order's key, of errors or older than 20 days at 31 January 2024, by type."""
    e = _events(spark, sf_dir).join(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("event_id")), "event_id", "left_anti")
    return e.where((F.col("event_type") == "error") | (F.col("at") < NOW - 20 * sync.DAY)).groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))


def wanted_downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five longest documents of each source and all labelled good, each once, but for those held as they are (in lower case already)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text", F.length("text").alias("n"))
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "doc_id"))
    top = d.select("doc_id", "source", "n").withColumn("place", place).where("place <= 5").select("doc_id")
    pinned = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    held = d.where(F.sha2(F.lower("text"), 256).eqNullSafe(F.sha2("text", 256))).select("doc_id")
    return top.unionByName(pinned).distinct().join(held, "doc_id", "left_anti")


def open_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders kept after 1997: open ones, and resolved ones whose date is later or can't be read, by status."""
    at = F.when(F.col("o_orderkey") % 7 == 0, F.lit("n/a")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    o = table(spark, sf_dir, "orders").select("o_orderstatus", F.try_to_timestamp(at, F.lit("yyyy-MM-dd")).alias("at"))
    kept = (F.col("o_orderstatus") == "O") | F.col("at").isNull() | (F.col("at") >= F.lit("1997-01-01").cast("timestamp"))
    return o.groupBy("o_orderstatus").agg(F.count_if(kept).alias("n_kept"), F.count("*").alias("n"))


def embedded_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as images of their brand: small ones and those with over two copies go, then the eight best stay: those in little text first, then by area."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", (F.col("p_size") * 8).alias("w"), F.floor(F.col("p_retailprice") / 8).alias("h"), F.col("p_size").alias("around"))
    copies = p.groupBy("p_brand", "w", "h").agg(F.count("*").alias("copies"))
    good = p.join(copies, ["p_brand", "w", "h"]).where((F.col("w") >= LEAST_EDGE) & (F.col("h") >= LEAST_EDGE) & (F.col("copies") <= MOST_COPIES))
    best = F.row_number().over(Window.partitionBy("p_brand").orderBy((F.col("around") >= POOR_TEXT).cast("int"), F.desc(F.col("w") * F.col("h")), "p_partkey"))
    return good.withColumn("rank", best).where(F.col("rank") <= MOST_IMAGES).select("p_brand", "p_partkey", "rank")


def image_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of documents by source and length in thousands, numbered from the second equal one on."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("source"), F.lit(" p."), F.floor(F.length("text") / 1000).cast("string")).alias("base"), F.lit(1).alias("one"))
    n = grouped_running(d, ["base"], ["doc_id"], {"n": "one"})
    return n.select("doc_id", F.when(F.col("n") > 1, F.concat("base", F.lit(" ("), F.col("n").cast("long").cast("string"), F.lit(")"))).otherwise(F.col("base")).alias("label"))


def page_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lane of each page: that of the first rule whose pattern fits its host, path or URL, else web."""
    of = {"host": X.host_of(F.col("url")), "path": F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1), "url": F.col("url")}
    lane = F.coalesce(*[F.when(of[part].rlike(pattern), name) for name, part, pattern in LANES], F.lit("web"))
    return table(spark, sf_dir, "pages").select("page_id", lane.alias("lane"))


def kept_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of each document with their place in the draft: empty ones go, and 40 stay."""
    parts = F.transform(F.split("text", "\n"), lambda s, i: F.struct(i.alias("draft"), F.length(s).alias("n"), s.rlike(r"\S").alias("full")))
    kept = F.slice(F.filter(parts, lambda p: p["full"]), 1, SECTIONS)
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(kept).alias("place", "p"))
    return d.select("doc_id", F.col("place").cast("long").alias("place"), F.col("p.draft").cast("long").alias("draft"), F.col("p.n").cast("long").alias("n_chars"))


def shared_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The asset of each labelled id: one for each content, null where no document has the id."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    asset = catalog.first_of_each(d, F.col("sha"), ["doc_id"]).select("doc_id", F.col("of").alias("asset"))
    asked = table(spark, sf_dir, "labels").select("doc_id").unionByName(table(spark, sf_dir, "labels").select((-F.col("doc_id") - 1).alias("doc_id"))).distinct()
    return asked.join(asset, "doc_id", "left").select("doc_id", "asset")


def photo_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as photo slots of orders: one for each status of a flag, two for a flag, four for an order, flag R first. An order's lines are few."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber")  # noqa: E741
    one = l.groupBy("l_orderkey", "l_returnflag", "l_linestatus").agg(F.min("l_linenumber").alias("slot"))
    in_tab = F.row_number().over(Window.partitionBy("l_orderkey", "l_returnflag").orderBy("slot"))
    two = one.withColumn("t", in_tab).where("t <= 2")
    in_all = F.row_number().over(Window.partitionBy("l_orderkey").orderBy((F.col("l_returnflag") != "R").cast("int"), "slot"))
    return two.withColumn("place", in_all).where("place <= 4").select("l_orderkey", "slot", "place")


def confirmed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs that pages of a host state and that pages of even id confirm, without query and fragment: each once, the first six of a host, in order of id."""
    p = table(spark, sf_dir, "pages").select("page_id", X.host_of(F.col("url")).alias("host"), F.regexp_replace(F.lower("url"), r"[?#].*$", "").alias("u"))
    claimed = p.groupBy("host", "u").agg(F.min("page_id").alias("first_id")).join(p.where("page_id % 2 = 0").select("u").distinct(), "u", "left_semi")
    place = F.row_number().over(Window.partitionBy("host").orderBy("first_id"))
    return claimed.withColumn("place", place).where("place <= 6").select("host", "place", F.col("u").alias("url"))


def distinct_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First words of each conversation's turns, each once whatever its case, in order of the first turn."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.split("text", " ", 2)[0].alias("fact"))
    first = c.groupBy("conv_id", F.lower(F.trim("fact")).alias("k")).agg(F.min(F.struct("turn", "fact")).alias("f"))
    return first.select("conv_id", F.col("f.turn").alias("turn"), F.col("f.fact").alias("fact"))


def merged_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of customers, then those of suppliers that no customer has with the same sign of its balance."""
    c = table(spark, sf_dir, "customer").select(F.lit(1).alias("part"), F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), (F.col("c_acctbal") >= 0).alias("good"))
    s = table(spark, sf_dir, "supplier").select(F.lit(2).alias("part"), F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), (F.col("s_acctbal") >= 0).alias("good"))
    return c.unionByName(s).groupBy("nation", "good").agg(F.min(F.struct("part", "id")).alias("f")).select("nation", "good", "f.part", "f.id")


def ordered_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations by place: four named ones first, then by name; a row for each nation."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ("GERMANY", "FRANCE", "JAPAN", "BRAZIL"))), F.upper("n_name")), F.lit(0)), F.lit(9))
    n = table(spark, sf_dir, "nation").select("n_name", rank.alias("rank"))
    return n.select("n_name", F.row_number().over(Window.orderBy("rank", "n_name")).alias("place"))


def chart_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axis of each order status's totals by year: the step of five parts at most (1, 2 or 5 times a power of ten), and where it begins and ends; zero is in unless the least is over half of the most."""
    o = table(spark, sf_dir, "orders").groupBy("o_orderstatus", F.year("o_orderdate").alias("y")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("v"))
    a = o.groupBy("o_orderstatus").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).withColumn("base", F.when(F.col("lo") > F.col("hi") / 2, F.col("lo")).otherwise(F.least("lo", F.lit(0.0))))
    step = R.nice_step(F.greatest(F.col("hi") - F.col("base"), F.lit(1e-9)), 5)
    a = a.withColumn("step", step)
    return a.select("o_orderstatus", F.col("step").cast("double").alias("step"), (F.floor(F.col("base") / F.col("step")) * F.col("step")).alias("first_tick"), (F.ceil(F.col("hi") / F.col("step")) * F.col("step")).alias("last_tick"))


def json_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outermost braces in each event's properties between other text, and a hash of the properties with keys in order."""
    said = F.concat(F.lit("Here: "), F.col("props"), F.lit(" (end)"))
    pairs = F.array_sort(F.map_entries(F.from_json("props", "map<string,string>")))
    joined = F.array_join(F.transform(pairs, lambda p: F.concat(p["key"], F.lit("="), p["value"])), ",")
    return table(spark, sf_dir, "events").select("event_id", F.regexp_extract(said, r"(?s)\{.*\}", 0).alias("json"), F.sha2(joined, 256).alias("content_sha"))


QUERIES = {
    f.__name__: f
    for f in (
        resolved_sources, repaired_ids, catalog_entries, log_fields, folder_search, stored_refs, merge_picks, newest_first, synced_catalog, accepted_updates, device_roles, collected_files, written_acks, purged_jobs, wanted_downloads,
        open_suggestions, embedded_images, image_labels, page_lanes, kept_sections, shared_assets, photo_slots, confirmed_sources, distinct_facts, merged_references, ordered_nations, chart_numbers, json_spans,
    )
}

_E = "e AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS made FROM events)"
_HOST = r"regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/:?#]+)', 1)"
_PATH = r"regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
ORACLE_SQL = {
    "resolved_sources": f"""WITH d AS (SELECT doc_id, sha256(text) AS s, coalesce(octet_length(encode(text)), 0) AS b FROM documents), f AS (SELECT *, min(doc_id) OVER (PARTITION BY s) AS h FROM d),
        k AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n, sum(b) OVER (ORDER BY doc_id) AS t FROM f WHERE doc_id = h)
        SELECT f.doc_id, CASE WHEN n <= {MOST_SOURCES} AND t <= {MOST_BYTES} THEN CASE WHEN f.doc_id = h THEN 'kept' ELSE 'duplicate' END ELSE 'limit-exceeded' END AS outcome, CASE WHEN n <= {MOST_SOURCES} AND t <= {MOST_BYTES} THEN 'src-' || lpad(CAST(n - 1 AS VARCHAR), 2, '0') END AS id FROM f JOIN k ON k.doc_id = h""",
    "repaired_ids": "SELECT doc_id, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY length(text)) THEN CAST(length(text) AS VARCHAR) ELSE 'd-' || substr(sha256(length(text) || ':' || doc_id), 1, 8) END AS id FROM documents",
    "catalog_entries": "SELECT o_orderkey, o_orderstatus, count(l_orderkey) AS n_lines, count(DISTINCT l_partkey) AS n_parts FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2",
    "log_fields": "SELECT event_id, 'k' AS key, substr(json_extract_string(props, '$.k'), 1, 200) AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL",
    "folder_search": r"""SELECT * FROM (SELECT doc_id, len(list_filter(w, lambda x: starts_with(x, 'th'))) > 0 AND len(list_filter(w, lambda x: starts_with(x, 'ere'))) > 0 AS by_word, contains(t, 'th') AND contains(t, 'ere') AS anywhere
        FROM (SELECT doc_id, lower(text) AS t, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: length(x) >= 2) AS w FROM documents WHERE source = 'src1')) WHERE by_word OR anywhere""",
    "stored_refs": r"SELECT page_id, f AS full_ref, regexp_replace(f, '\?.*$', '') AS redacted_ref FROM (SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '^([A-Za-z][A-Za-z0-9+.-]*://)[^/@]*@', '\1') AS f FROM pages)",
    "merge_picks": f"WITH {_E} SELECT user_id, event_id, round(s, 6) AS score FROM (SELECT user_id, event_id, least(1.0, greatest(0.0, value / 100)) AS s, row_number() OVER (PARTITION BY user_id ORDER BY least(1.0, greatest(0.0, value / 100)) DESC, made DESC, event_id DESC) AS n FROM e) WHERE n = 1 AND s >= 0.75",
    "newest_first": "SELECT o_orderkey, row_number() OVER (ORDER BY CAST(floor(epoch(o_orderdate)) AS BIGINT) DESC, o_orderkey) AS place FROM orders",
    "synced_catalog": """WITH l AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_orderkey % 2 = 0 AS p FROM orders WHERE o_orderkey % 3 <> 0), r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'new' ELSE o_orderstatus END AS s, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey + 1 END AS q FROM orders WHERE o_orderkey % 4 <> 0)
        SELECT coalesce(l.k, r.k) AS key, CASE WHEN r.k IS NULL THEN 'delete' WHEN l.k IS NULL THEN 'insert' WHEN l.s <> r.s THEN 'update' ELSE 'same' END AS action, coalesce(r.s, l.s) AS sha, CASE WHEN l.k IS NULL THEN coalesce(o.p, false) ELSE l.p END AS pinned,
        r.k IS NOT NULL AND (l.k IS NULL OR l.s <> r.s) AS unread FROM l FULL JOIN r ON l.k = r.k LEFT JOIN l o ON o.k = r.q""",
    "accepted_updates": """WITH u AS (SELECT user_id || '/' || event_type AS key, CASE WHEN event_id % 50 <> 0 THEN event_id END AS n, event_id AS id FROM events), s AS (SELECT key, max(n) AS seen FROM u WHERE id % 40 < 20 GROUP BY 1),
        w AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY key ORDER BY coalesce(n, 9223372036854775807) DESC, id DESC) = 1) SELECT w.key, w.n, w.id FROM w LEFT JOIN s USING (key) WHERE seen IS NULL OR n IS NULL OR n > seen""",
    "device_roles": f"""WITH {_E}, o AS (SELECT event_type AS account, user_id AS device, max(made) AS ms FROM e WHERE event_id % 7 = 0 GROUP BY 1, 2), d AS (SELECT user_id AS device, max(made) AS seen, CASE user_id % 4 WHEN 1 THEN 'mirror' WHEN 2 THEN 'phone' ELSE 'primary' END AS role FROM e WHERE user_id % 5 <> 0 GROUP BY 1),
        c AS (SELECT o.*, d.role, coalesce(d.seen, o.ms) AS heard, row_number() OVER (PARTITION BY account ORDER BY ms DESC, o.device DESC) AS n FROM o LEFT JOIN d ON d.device = o.device),
        b AS (SELECT account, min_by(device, n) AS w FROM c WHERE n > 1 AND coalesce(role, '') NOT IN ('mirror', 'phone') AND (n = 2 OR role = 'primary') AND {NOW} - heard < 14400 GROUP BY 1)
        SELECT account, device, CASE WHEN n > 1 THEN 'mirror' WHEN w IS NOT NULL THEN 'waiting' ELSE 'primary' END AS role, CASE WHEN n = 1 THEN w END AS waits_for FROM c LEFT JOIN b USING (account)""",
    "collected_files": f"""WITH {_E}, t AS (SELECT event_id // 6 AS job, max(made) AS made FROM e WHERE event_type IN ('purchase', 'error') GROUP BY 1), s AS (SELECT event_id // 6 AS job, user_id AS device FROM e WHERE event_id % 6 = 0 AND event_id % 5 <> 0), a AS (SELECT event_id // 6 AS job, user_id AS device FROM e WHERE event_type = 'click'),
        x AS (SELECT job FROM t LEFT JOIN s USING (job) WHERE made < {NOW - 15 * 86400} OR CASE WHEN device IS NULL THEN job IN (SELECT job FROM a) ELSE (job, device) IN (SELECT (job, device) FROM a) END),
        u AS (SELECT event_id // 12 AS sha, bool_and(event_id // 6 IN (SELECT job FROM x)) AS done FROM e WHERE event_id % 6 = 1 GROUP BY 1), q AS (SELECT user_id FROM e GROUP BY 1 HAVING max(made) < {NOW - 7200}),
        m AS (SELECT max((made, user_id, event_id)) AS m FROM e WHERE event_id % 6 = 4)
        SELECT event_id AS file, reason FROM (SELECT event_id, CASE WHEN event_id % 6 < 2 AND event_id // 6 IN (SELECT job FROM x) THEN 'job-done' WHEN event_id % 6 = 2 AND done THEN 'job-done' WHEN event_id % 6 = 2 AND done IS NULL AND made < {NOW - 15 * 86400} THEN 'orphan-att'
        WHEN event_id % 6 IN (3, 5) AND user_id IN (SELECT user_id FROM q) THEN 'phone-silent' WHEN event_id % 6 = 4 AND (made, user_id, event_id) <> (SELECT m FROM m) THEN 'old-claim' END AS reason FROM e LEFT JOIN u ON u.sha = event_id // 6) WHERE reason IS NOT NULL""",
    "written_acks": f"WITH {_E}, n AS (SELECT * FROM e WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY made DESC, event_id DESC) <= 10) SELECT user_id AS device, count(*) AS n, sha256(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id)) AS ids_sha FROM n GROUP BY 1",
    "purged_jobs": f"WITH {_E} SELECT event_type, count(*) AS n, max(event_id) AS last_id FROM e WHERE event_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND (event_type = 'error' OR made < {NOW - 20 * 86400}) GROUP BY 1",
    "wanted_downloads": """WITH t AS (SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) <= 5) SELECT doc_id FROM (SELECT doc_id FROM t UNION SELECT doc_id FROM labels WHERE quality = 1) WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lower(text) IS NOT DISTINCT FROM text)""",
    "open_suggestions": "SELECT o_orderstatus, count(*) FILTER (WHERE o_orderstatus = 'O' OR o_orderkey % 7 = 0 OR o_orderdate >= TIMESTAMP '1997-01-01') AS n_kept, count(*) AS n FROM orders GROUP BY 1",
    "embedded_images": """WITH p AS (SELECT p_partkey, p_brand, p_size * 8 AS w, CAST(floor(p_retailprice / 8) AS BIGINT) AS h, p_size AS a, count(*) OVER (PARTITION BY p_brand, p_size, floor(p_retailprice / 8)) AS c FROM part)
        SELECT p_brand, p_partkey, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY CAST(a >= 25 AS INTEGER), w * h DESC, p_partkey) AS r FROM p WHERE w >= 64 AND h >= 64 AND c <= 2) WHERE r <= 8""",
    "image_labels": "SELECT doc_id, b || CASE WHEN n > 1 THEN ' (' || n || ')' ELSE '' END AS label FROM (SELECT doc_id, b, row_number() OVER (PARTITION BY b ORDER BY doc_id) AS n FROM (SELECT doc_id, source || ' p.' || (length(text) // 1000) AS b FROM documents))",
    "page_lanes": "SELECT page_id, CASE " + " ".join("WHEN regexp_matches({}, '{}') THEN '{}'".format({"host": _HOST, "path": _PATH, "url": "url"}[part], pattern, name) for name, part, pattern in LANES) + " ELSE 'web' END AS lane FROM pages",
    "kept_sections": r"""WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), x AS (SELECT doc_id, unnest(l) AS p, unnest(range(len(l))) AS d FROM s), k AS (SELECT doc_id, d, length(p) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY d) - 1 AS i FROM x WHERE regexp_matches(p, '\S'))
        SELECT doc_id, i AS place, d AS draft, n AS n_chars FROM k WHERE i < 40""",
    "shared_assets": "WITH a AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS asset FROM documents), q AS (SELECT doc_id FROM labels UNION SELECT -doc_id - 1 FROM labels) SELECT q.doc_id, asset FROM q LEFT JOIN a ON a.doc_id = q.doc_id",
    "photo_slots": """WITH o AS (SELECT l_orderkey, l_returnflag, min(l_linenumber) AS slot FROM lineitem GROUP BY l_orderkey, l_returnflag, l_linestatus), t AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY slot) <= 2)
        SELECT l_orderkey, slot, CAST(p AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(l_returnflag <> 'R' AS INTEGER), slot) AS p FROM t) WHERE p <= 4""",
    "confirmed_sources": rf"""WITH p AS (SELECT page_id, {_HOST} AS host, regexp_replace(lower(url), '[?#].*$', '') AS u FROM pages), c AS (SELECT host, u, min(page_id) AS i FROM p WHERE u IN (SELECT u FROM p WHERE page_id % 2 = 0) GROUP BY 1, 2)
        SELECT host, CAST(n AS INTEGER) AS place, u AS url FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY i) AS n FROM c) WHERE n <= 6""",
    "distinct_facts": "SELECT conv_id, turn, f AS fact FROM (SELECT conv_id, turn, string_split(text, ' ')[1] AS f FROM conversations) QUALIFY row_number() OVER (PARTITION BY conv_id, lower(trim(f)) ORDER BY turn) = 1",
    "merged_references": """WITH r AS (SELECT 1 AS part, c_custkey AS id, c_nationkey AS nation, c_acctbal >= 0 AS good FROM customer UNION ALL SELECT 2, s_suppkey, s_nationkey, s_acctbal >= 0 FROM supplier) SELECT nation, good, part, id FROM r QUALIFY row_number() OVER (PARTITION BY nation, good ORDER BY part, id) = 1""",
    "ordered_nations": "SELECT n_name, CAST(row_number() OVER (ORDER BY CASE upper(n_name) WHEN 'GERMANY' THEN 1 WHEN 'FRANCE' THEN 2 WHEN 'JAPAN' THEN 3 WHEN 'BRAZIL' THEN 4 ELSE 9 END, n_name) AS INTEGER) AS place FROM nation",
    "chart_numbers": """WITH o AS (SELECT o_orderstatus, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS v FROM orders GROUP BY o_orderstatus, year(o_orderdate)), a AS (SELECT o_orderstatus, min(v) AS lo, max(v) AS hi FROM o GROUP BY 1), b AS (SELECT *, CASE WHEN lo > hi / 2 THEN lo ELSE least(lo, 0.0) END AS base FROM a),
        c AS (SELECT *, greatest(hi - base, 1e-9) / 5 AS r FROM b), d AS (SELECT *, CAST(pow(10, floor(log10(r))) AS DOUBLE) AS p FROM c), s AS (SELECT *, CASE WHEN r <= p THEN p WHEN r <= 2 * p THEN 2 * p WHEN r <= 5 * p THEN 5 * p ELSE 10 * p END AS s FROM d)
        SELECT o_orderstatus, s AS step, floor(base / s) * s AS first_tick, ceil(hi / s) * s AS last_tick FROM s""",
    "json_spans": "SELECT event_id, props AS json, sha256('k=' || json_extract_string(props, '$.k')) AS content_sha FROM events",
}
