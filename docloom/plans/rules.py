"""Queries over the rule functions, page verdicts, set operations and chart rules, with the SQL that gives the same rows.

A null text or page gives a row of nulls or zeros where a row is given for each input row, and none where matches are listed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as X
from ..operators import retrieval
from ..sources.tables import table

# Patterns and thresholds of page verdicts.
ENABLE_JS, CHALLENGE = "enable javascript|requires javascript|javascript is (?:disabled|required)", "just a moment|checking your browser|attention required|verify you are human"
LOGIN_HEADING, PAYWALL = "sign in|log in|login|single sign-on", "subscribe to (?:continue|read)|already a subscriber|this content is for subscribers"
R1, R2, R4, R5_RATIO, R5, R7_ARTICLE, R7_BODY, R8, EXTERNAL, TAIL = 1500, 500, 1000, 20, 2000, 200, 500, 200, 50_000, 600
LOGIN_ARTICLE, CHALLENGE_TEXT, READERABLE, LEAST_PARAGRAPH = 1500, 1500, 20, 140
SCRIPT, DROPPED, TAG = r"(?s)<script[^>]*>(.*?)</script>", r"(?s)<(?:script|style|noscript)[^>]*>.*?</(?:script|style|noscript)>", r"(?s)<[^>]*>"


def catalog_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency of the catalog's tokens."""
    return retrieval.catalog_frequency(table(spark, sf_dir, "documents"), "doc_id")


def retrieval_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency of retrieval's tokens."""
    return retrieval.retrieval_frequency(table(spark, sf_dir, "documents"), "doc_id")


def reading_ease(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of each document without Markdown, its words, syllables, and words of four syllables or more."""
    d = table(spark, sf_dir, "documents").select("doc_id", R.stripped_markdown(F.col("text")).alias("t"))
    d = d.select("doc_id", "t", F.length("t").cast("long").alias("n_chars"), X.word_count(F.col("t")).cast("long").alias("n_words"))
    return R.with_syllables(d, "t").drop("t")


def chosen_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slug for each document from the beginning of its text; equal ones are numbered from the second on, in order of id."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.nullif(R.slug(F.substring("text", 1, 200)), F.lit("")), F.lit("learning")).alias("base"))
    n = F.row_number().over(Window.partitionBy("base").orderBy("doc_id"))
    return d.withColumn("n", n).select("doc_id", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", "n")).alias("slug"))


def page_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A safe file name and a snippet of each page's URL, and its title escaped for HTML."""
    title = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", R.safe_name(F.col("url")).alias("name"), R.snippet(F.col("url"), 24).alias("label"), R.escaped(title).alias("title"))


def markdown_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document looks like Markdown, and its bits per character."""
    return table(spark, sf_dir, "documents").select("doc_id", R.looks_like_markdown(F.col("text")).alias("markdown"))


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of each document by rule, as masked previews."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(R.secrets(F.col("text"))).alias("s"))
    return d.groupBy("doc_id", F.col("s.rule").alias("rule"), X.masked(F.col("s.value")).alias("preview")).agg(F.count("*").alias("n"))


def size_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of each document for people, and a guard's estimate of its tokens."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("b"), F.length("text").alias("n"))
    return d.select("doc_id", R.human_size(F.col("b")).alias("size"), R.guard_estimate(F.col("n")).cast("long").alias("n_estimated"))


def image_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of an image of each part's size and price, and the heights at which a tall one is cut: tiles of 1.4 times the width, with a twentieth in common, six at most."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 40).cast("int").alias("w"), F.floor("p_retailprice").cast("int").alias("h"))
    tile = F.ceil(F.col("w") * 14 / 10)
    n = F.least(F.lit(6), F.greatest(F.lit(1), F.ceil((F.col("h") - tile) / F.floor(tile * 95 / 100)) + 1))
    return p.select("p_partkey", R.image_tokens(F.col("w"), F.col("h")).cast("long").alias("n_tokens"), n.cast("long").alias("n_tiles"))


def call_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of calls by return flag, with cache writes at 1.25 and cache reads at 0.1 of the input's rate, and usage added up."""
    c = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_quantity") * 100).alias("i"), (F.col("l_linenumber") * 50).alias("r"), (F.col("l_tax") * 1000).alias("w"), (F.col("l_discount") * 1000).alias("o"))
    cost = (F.greatest(F.lit(0.0), F.col("i") - F.col("r") - F.col("w")) + F.col("w") * 1.25 + F.col("r") * 0.1) * 3e-6 + F.col("o") * 15e-6
    return c.groupBy("l_returnflag").agg(F.round(F.sum(cost), 4).alias("cost"), F.round(F.sum("i"), 2).alias("n_input"), F.sum("r").alias("n_read"), F.round(F.sum("o"), 2).alias("n_output"))


def colour_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Luminance, contrast to white and hue of a colour made from each part's key."""
    channel = lambda k: (F.col("p_partkey") * k % 256) / 255
    p = table(spark, sf_dir, "part").select("p_partkey", channel(37).alias("r"), channel(91).alias("g"), channel(151).alias("b"))
    lum = R.luminance(F.col("r"), F.col("g"), F.col("b"))
    return p.select("p_partkey", F.round(lum, 6).alias("luminance"), F.round(R.contrast(lum, F.lit(1.0)), 6).alias("contrast"), F.round(R.hue(F.col("r"), F.col("g"), F.col("b")), 4).alias("hue"))


def event_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compact and relative times of each event at 31 January 2024, and a UUID from its id."""
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", R.compact_stamp(ts).alias("stamp"), R.relative_date(ts, now).alias("age"), R.uuid_of(F.md5(F.col("event_id").cast("string").cast("binary"))).alias("uuid"))


def page_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of each page from its HTML, the verdict of nine ordered rules, and whether it is a login or a paywall.

    The article is the text of the paragraphs; it is readable if the roots of what paragraphs have beyond 140 characters add up to over 20.
    """
    flat = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, TAG, " "), r"\s+", " "))
    paragraphs = F.transform(F.regexp_extract_all("html", F.lit(r"(?s)<p(?: [^>]*)?>(.*?)</p>"), 1), flat)
    scripts = F.aggregate(F.regexp_extract_all("html", F.lit(SCRIPT), 1), F.lit(0), lambda a, x: a + F.length(x)) + EXTERNAL * F.regexp_count("html", F.lit("<script[^>]* src="))
    p = table(spark, sf_dir, "pages").select(
        "page_id", "html", flat(F.regexp_replace("html", DROPPED, " ")).alias("body"), paragraphs.alias("p"), scripts.alias("script_bytes"), F.lower(flat(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1))).alias("title"),
        F.lower(F.array_join(F.regexp_extract_all("html", F.lit(r"(?s)<h1[^>]*>(.*?)</h1>"), 1), " ")).alias("h1"), F.lower(F.array_join(F.regexp_extract_all("html", F.lit(r"(?s)<noscript[^>]*>(.*?)</noscript>"), 1), " ")).alias("noscript"),
    )
    article = F.aggregate("p", F.lit(0), lambda a, x: a + F.length(x))
    readable = F.aggregate("p", F.lit(0.0), lambda a, x: a + F.when(F.length(x) >= LEAST_PARAGRAPH, F.sqrt((F.length(x) - LEAST_PARAGRAPH).cast("double"))).otherwise(0.0)) > READERABLE
    s = p.select(
        "page_id", "script_bytes", F.length("body").alias("body_chars"), article.alias("article_chars"), readable.alias("readable"),
        F.col("html").rlike(r"(?s)<div id=\"(?:root|app|__next)\">\s*</div>").alias("empty_mount"), F.col("noscript").rlike(ENABLE_JS).alias("needs_js"), F.col("title").rlike(CHALLENGE).alias("title_challenge"),
        F.regexp_count("html", F.lit("(?i)<form")).alias("n_forms"), F.col("html").rlike("(?i)<input[^>]*type=\"password\"").alias("password"), (F.col("title").rlike(LOGIN_HEADING) | F.col("h1").rlike(LOGIN_HEADING)).alias("login_heading"),
        F.lower(F.substr("body", F.greatest(F.lit(1), F.length("body") - TAIL + 1))).rlike(PAYWALL).alias("paywall"),
    )
    few = F.col("article_chars") < R7_ARTICLE
    verdict = (
        F.when(F.col("article_chars") >= R1, "ok").when((F.col("article_chars") >= R2) & F.col("readable"), "ok").when(F.col("empty_mount"), "client-rendered")
        .when(F.col("needs_js") & (F.col("body_chars") < R4), "client-rendered")
        .when((F.col("script_bytes") / F.greatest("body_chars", F.lit(1)) > R5_RATIO) & (F.col("body_chars") < R5), "client-rendered")
        .when(F.col("title_challenge") & (F.col("body_chars") < CHALLENGE_TEXT), "client-rendered").when(few & (F.col("body_chars") < R7_BODY), "empty").when(F.col("article_chars") >= R8, "ok").otherwise("empty")
    )
    strong = (F.col("password") & (F.col("article_chars") < LOGIN_ARTICLE)).cast("int") + ((F.col("n_forms") >= 1) & F.col("login_heading")).cast("int")
    login = F.when(strong >= 2, "login-required").when(F.col("paywall") & (F.col("article_chars") < LOGIN_ARTICLE), "paywall").when(strong == 1, "one-strong").otherwise("none")
    return s.select("page_id", F.col("script_bytes").cast("long").alias("script_bytes"), F.col("body_chars").cast("long").alias("body_chars"), F.col("article_chars").cast("long").alias("article_chars"), "readable", verdict.alias("verdict"), login.alias("login"))


def suggested_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of equal length, language and source as pairs (each with the next one), without pairs dismissed as both of bad quality, in either order."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.length("text").alias("n"))
    nxt = F.lead("doc_id").over(Window.partitionBy("source", "lang", "n").orderBy("doc_id"))
    pairs = d.withColumn("other", nxt).where("other IS NOT NULL").select(F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b"))
    bad = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id").distinct()
    dismissed = pairs.join(bad.select(F.col("doc_id").alias("a")), "a", "left_semi").join(bad.select(F.col("doc_id").alias("b")), "b", "left_semi").select(F.col("b").alias("x"), F.col("a").alias("y"))
    gone = dismissed.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return pairs.join(gone, ["a", "b"], "left_anti").select("a", "b")


def unreferenced_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents that documents of one language have and those of others no more, by language."""
    d = table(spark, sf_dir, "documents").select("lang", F.sha2("text", 256).alias("sha")).distinct()
    only = d.groupBy("sha").agg(F.count("*").alias("n"), F.min("lang").alias("lang")).where("n = 1")
    return only.groupBy("lang").agg(F.count("*").alias("n_blobs"), F.min("sha").alias("first_sha"))


def added_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents of the second half of ids that the first half doesn't have, each once: what a union by content appends."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    half = d.agg(((F.min("doc_id") + F.max("doc_id")) / 2).alias("half"))
    marked = d.join(F.broadcast(half)).select("doc_id", "sha", (F.col("doc_id") <= F.col("half")).alias("held"))  # one row
    return marked.groupBy("sha").agg(F.bool_or("held").alias("held"), F.min("doc_id").alias("doc_id")).where("NOT held").select("sha", "doc_id")


def pie_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by day of the week for each status as a pie: the four greatest slices in their order and the rest as Other."""
    c = table(spark, sf_dir, "orders").groupBy("o_orderstatus", F.dayofweek("o_orderdate").alias("position")).agg(F.count("*").alias("value"))
    ranked = c.withColumn("r", F.row_number().over(Window.partitionBy("o_orderstatus").orderBy(F.desc("value"), "position")))
    slice_ = F.when(F.col("r") <= 4, F.col("position").cast("string")).otherwise("Other")
    return ranked.groupBy("o_orderstatus", slice_.alias("slice")).agg(F.sum("value").alias("value"))


def ordered_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of brands by total price, greatest first, ties by name."""
    b = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sum(F.col("p_retailprice").cast("decimal(18,2)")).alias("t"))
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last("t"), "p_brand"))  # a row for each brand
    return b.select("p_brand", place.alias("place"), F.col("t").cast("double").alias("total"))


def capped_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as annotations of users: the first of each type counts, and the first three of a user's."""
    one = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("f"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("f"))  # a row for each type
    return one.withColumn("place", place).where("place <= 3").select("user_id", "event_type", F.col("f.event_id").alias("event_id"), "place")


def catalog_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog entries whose title or summary has the words "the" and "and", in order of length (longest first), then of id, the first 20."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("t"), F.length("text").alias("n"))
    found = d.where(F.forall(F.array(F.lit("the"), F.lit("and")), lambda w: F.contains(F.col("t"), w)))
    return found.orderBy(F.desc("n"), "doc_id").limit(20).select("doc_id", F.col("n").cast("long").alias("n"))


def illegal_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of type from an event to its user's next one that no table of allowed changes has."""
    allowed = spark.createDataFrame([(a, b) for a, b in ALLOWED], "a string, b string")
    e = table(spark, sf_dir, "events").select("event_type", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("a")).where("a IS NOT NULL").select("a", F.col("event_type").alias("b"))
    return e.groupBy("a", "b").agg(F.count("*").alias("n")).join(F.broadcast(allowed), ["a", "b"], "left_anti")


# Changes of state that are allowed.
ALLOWED = [("signup", "click"), ("signup", "view"), ("view", "click"), ("view", "purchase"), ("click", "view"), ("click", "purchase"), ("click", "click"), ("view", "view"), ("purchase", "view")]


def retention_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with how many events are kept at 25 January 2024: those of 14 days, and each type's last one however old."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    old = F.col("ts") < F.lit("2024-01-11").cast("timestamp")
    g = e.groupBy("user_id", "event_type").agg(F.count_if(~old).alias("fresh"), F.count("*").alias("n"))
    kept = F.when(F.col("fresh") > 0, F.col("fresh")).otherwise(1)
    return g.groupBy("user_id").agg(F.sum(kept).alias("n_kept"), (F.sum("n") - F.sum(kept)).alias("n_swept"))


def capped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document while 2,000 characters aren't used up; the line that goes beyond is cut, later ones are left out."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.transform(F.split("text", "\n"), F.length).alias("l"), F.length("text").alias("n"))
    whole = F.aggregate("l", F.struct(F.lit(0).alias("used"), F.lit(0).alias("kept")), lambda a, x: F.struct(F.least(F.lit(2000), a["used"] + x).alias("used"), F.when((a["used"] < 2000) | (x == 0) & (a["used"] <= 2000), a["kept"] + 1).otherwise(a["kept"]).alias("kept")))
    return d.select("doc_id", whole["used"].cast("long").alias("n_chars"), (F.aggregate("l", F.lit(0), lambda a, x: a + x) > 2000).alias("truncated"))


def paired_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by day of two statuses side by side; a day that only one has is empty in the other."""
    o = table(spark, sf_dir, "orders").select("o_orderstatus", F.to_date("o_orderdate").alias("day"))
    of = lambda s, n: o.where(F.col("o_orderstatus") == s).groupBy("day").agg(F.count("*").alias(n))
    both = of("F", "f").join(of("P", "p"), "day", "full_outer")
    return both.select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.coalesce(F.col("f").cast("string"), F.lit("")).alias("f"), F.coalesce(F.col("p").cast("string"), F.lit("")).alias("p"))


def baseline_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that have labelled English and other documents: the mean quality of both, and whether the latter is lower."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", (F.col("lang") == "en").alias("en")).join(table(spark, sf_dir, "labels"), "doc_id")
    m = d.groupBy("source").agg(F.avg(F.when(F.col("en"), F.col("quality"))).alias("a"), F.avg(F.when(~F.col("en"), F.col("quality"))).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    return m.select("source", F.round("a", 6).alias("base"), F.round("b", 6).alias("other"), (F.col("b") < F.col("a")).alias("regressed"))


def usable_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents of each source have any block that isn't blank."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(F.col("text").rlike(r"\S")).alias("n_usable"), F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (catalog_terms, retrieval_terms, reading_ease, chosen_slugs, page_names, markdown_texts, secret_scan, size_labels, image_estimates, call_costs, colour_contrasts, event_stamps, page_verdicts, suggested_pairs, unreferenced_blobs, added_sidecars, pie_slices, ordered_bars, capped_annotations, catalog_search, illegal_transitions, retention_sweep, capped_lines, paired_series, baseline_comparison, usable_documents)}


def _listed(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


#: SQL for the tokens of an expression {}, as lists.
CATALOG_TOKENS = r"""list_filter(list_transform(list_filter(regexp_split_to_array(strip_accents({}), '[^\p{{L}}\p{{N}}]+'), lambda w: length(w) >= 2), lambda w:
    CASE WHEN regexp_full_match(w, '[A-Z0-9]*[A-Z][A-Z0-9]*') THEN lower(w) WHEN list_contains(STOP, lower(w)) THEN NULL ELSE
    CASE WHEN ends_with(lower(w), 'ies') THEN CASE WHEN length(w) >= 5 THEN substr(lower(w), 1, length(w) - 3) || 'y' ELSE lower(w) END
         WHEN ends_with(lower(w), 'ing') THEN CASE WHEN length(w) >= 6 THEN substr(lower(w), 1, length(w) - 3) ELSE lower(w) END
         WHEN ends_with(lower(w), 'ed') THEN CASE WHEN length(w) >= 5 THEN substr(lower(w), 1, length(w) - 2) ELSE lower(w) END
         WHEN regexp_matches(lower(w), '(s|x|z|ch|sh)es$') THEN CASE WHEN length(w) >= 5 THEN substr(lower(w), 1, length(w) - 2) ELSE lower(w) END
         WHEN ends_with(lower(w), 's') AND NOT ends_with(lower(w), 'ss') THEN CASE WHEN length(w) >= 4 THEN substr(lower(w), 1, length(w) - 1) ELSE lower(w) END
         ELSE lower(w) END END), lambda t: t IS NOT NULL)""".replace("STOP", _listed(R.CATALOG_STOP))
_PLAIN = r"list_filter(list_transform(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}\p{{M}}]+'), lambda w: strip_accents(w)), lambda w: (length(w) >= 2 OR regexp_full_match(w, '\p{{N}}+')) AND NOT list_contains(STOP, w))".replace("STOP", _listed(R.RETRIEVAL_STOP))
_ONE = "CASE WHEN NOT regexp_full_match(w, '[a-z]+') THEN w WHEN ends_with(w, 'ies') AND length(w) > 4 THEN substr(w, 1, length(w) - 3) || 'y' WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') AND length(w) > 3 THEN substr(w, 1, length(w) - 1) ELSE w END"
RETRIEVAL_TOKENS = f"list_transform(list_transform({_PLAIN}, lambda w: {_ONE}), lambda w: CASE WHEN NOT regexp_full_match(w, '[a-z]+') THEN w WHEN ends_with(w, 'ing') AND length(w) > 5 THEN substr(w, 1, length(w) - 3) WHEN ends_with(w, 'ed') AND length(w) > 5 THEN substr(w, 1, length(w) - 2) ELSE w END)"
_STRIPPED = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '`([^`]*)`', '\1', 'g'), '\*\*(.+?)\*\*', '\1', 'g'), '__(.+?)__', '\1', 'g'), '\s+', ' ', 'g'))"
_SLUG = "regexp_replace(regexp_replace(replace(lower(strip_accents(substr(text, 1, 200))), '&', ' and '), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_FLAT = r"trim(regexp_replace(regexp_replace({}, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"
_LINEAR = "CASE WHEN {0} <= 0.04045 THEN {0} / 12.92 ELSE pow(({0} + 0.055) / 1.055, 2.4) END"
_ENTROPY = "list_sum(list_transform(list_distinct(string_split(v, '')), lambda c: -((length(v) - length(replace(v, c, ''))) / CAST(length(v) AS DOUBLE)) * log2((length(v) - length(replace(v, c, ''))) / CAST(length(v) AS DOUBLE))))"
_RULES = " UNION ALL ".join("SELECT doc_id, '{}' AS rule, unnest(regexp_extract_all(text, '{}', {})) AS v FROM documents".format(k, p.replace("'", "''").replace("\\\"", "\""), g) for k, (p, g) in R.SECRETS.items())
ORACLE_SQL = {
    "catalog_terms": f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({CATALOG_TOKENS.format('text')}) AS term FROM documents) GROUP BY term",
    "retrieval_terms": f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({RETRIEVAL_TOKENS.format('text')}) AS term FROM documents) GROUP BY term",
    "chosen_slugs": f"""WITH s AS (SELECT doc_id, {_SLUG} AS s FROM documents), b AS (SELECT doc_id, coalesce(nullif(CASE WHEN length(s) <= 60 THEN s WHEN substr(s, 61, 1) = '-' THEN regexp_replace(substr(s, 1, 60), '-+$', '')
        WHEN contains(substr(s, 1, 60), '-') THEN regexp_replace(regexp_replace(substr(s, 1, 60), '-[^-]*$', ''), '-+$', '') ELSE substr(s, 1, 60) END, ''), 'learning') AS base FROM s)
        SELECT doc_id, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS slug FROM (SELECT doc_id, base, row_number() OVER (PARTITION BY base ORDER BY doc_id) AS n FROM b)""",
    "page_names": r"""WITH p AS (SELECT page_id, url, regexp_replace(trim(regexp_replace(url, '[/\\\x00-\x1f\x7f]', '', 'g')), '^\.+', '') AS s, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS t FROM pages)
        SELECT page_id, CASE WHEN length(s) <= 120 THEN s ELSE substr(s, 1, 120 - length(regexp_extract(s, '(?i)\.[a-z0-9]{1,8}$'))) || regexp_extract(s, '(?i)\.[a-z0-9]{1,8}$') END AS name,
        CASE WHEN length(url) > 24 THEN substr(url, 1, 23) || '…' ELSE url END AS label, replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS title FROM p""",
    "markdown_texts": r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\r?\n'), lambda x: regexp_matches(x, '^\s{0,3}(?:#{1,6}\s+\S|[-*+]\s+\S|[0-9]{1,9}[.)]\s+\S)'))) >= 2 AS markdown FROM documents",
    "secret_scan": f"""WITH m AS ({_RULES}), g AS (SELECT * FROM m WHERE rule = 'generic-high-entropy' AND {_ENTROPY} > 4.0), s AS (SELECT * FROM m WHERE rule <> 'generic-high-entropy'),
        k AS (SELECT * FROM s UNION ALL SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.doc_id = g.doc_id AND (contains(s.v, g.v) OR contains(g.v, s.v))))
        SELECT doc_id, rule, substr(v, 1, 4) || repeat('*', greatest(0, least(16, length(v) - 4))) AS preview, count(*) AS n FROM k GROUP BY 1, 2, 3""",
    "size_labels": """SELECT doc_id, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN CAST(CAST(floor(b / 1024.0 + 0.5) AS BIGINT) AS VARCHAR) || ' KB' ELSE printf('%.1f', b / 1048576.0) || ' MB' END AS size,
        CAST(ceil(ceil(n / 3.0) * 11 / 10) AS BIGINT) AS n_estimated FROM (SELECT doc_id, octet_length(encode(text)) AS b, length(text) AS n FROM documents)""",
    "image_estimates": """WITH p AS (SELECT p_partkey, p_size * 40 AS w, CAST(floor(p_retailprice) AS INTEGER) AS h, ceil(p_size * 40 * 14 / 10.0) AS tile FROM part), s AS (SELECT *, CAST(least(1.0, 1568.0 / greatest(w, h)) AS DOUBLE) AS s FROM p)
        SELECT p_partkey, CAST(least(1600, ceil(w * s * (h * s) / 750)) AS BIGINT) AS n_tokens, CAST(least(6, greatest(1, ceil((h - tile) / floor(tile * 95 / 100)) + 1)) AS BIGINT) AS n_tiles FROM s""",
    "call_costs": """SELECT l_returnflag, round(sum((greatest(0.0, l_quantity * 100 - l_linenumber * 50 - l_tax * 1000) + l_tax * 1000 * 1.25 + l_linenumber * 50 * 0.1) * 3e-6 + l_discount * 1000 * 15e-6), 4) AS cost,
        round(sum(l_quantity * 100), 2) AS n_input, CAST(sum(l_linenumber * 50) AS BIGINT) AS n_read, round(sum(l_discount * 1000), 2) AS n_output FROM lineitem GROUP BY 1""",
    "colour_contrasts": f"""WITH p AS (SELECT p_partkey, (p_partkey * 37 % 256) / 255.0::DOUBLE AS r, (p_partkey * 91 % 256) / 255.0::DOUBLE AS g, (p_partkey * 151 % 256) / 255.0::DOUBLE AS b FROM part),
        l AS (SELECT *, 0.2126 * {_LINEAR.format('r')} + 0.7152 * {_LINEAR.format('g')} + 0.0722 * {_LINEAR.format('b')} AS l, greatest(r, g, b) AS t, greatest(r, g, b) - least(r, g, b) AS d FROM p),
        h AS (SELECT *, CASE WHEN d = 0 THEN 0 WHEN t = r THEN (g - b) / d WHEN t = g THEN (b - r) / d + 2 ELSE (r - g) / d + 4 END * 60 AS h FROM l)
        SELECT p_partkey, round(l, 6) AS luminance, round(1.05 / (l + 0.05), 6) AS contrast, round(CASE WHEN h < 0 THEN h + 360 ELSE h END, 4) AS hue FROM h""",
    "event_stamps": """WITH e AS (SELECT event_id, ts, greatest(0, CAST(floor(epoch(TIMESTAMP '2024-01-31')) - floor(epoch(ts)) AS BIGINT)) AS s, md5(CAST(event_id AS VARCHAR)) AS h FROM events)
        SELECT event_id, strftime(ts, '%Y%m%dT%H%M%S') AS stamp, CASE WHEN s < 60 THEN 'now' WHEN s < 3600 THEN (s // 60) || 'm' WHEN s < 86400 THEN (s // 3600) || 'h' WHEN s < 604800 THEN (s // 86400) || 'd' WHEN s < 2419200 THEN (s // 604800) || 'w' ELSE strftime(ts, '%Y-%m-%d') END AS age,
        substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-' || substr('89ab', CAST((strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1 AS BIGINT), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM e""",
    "page_verdicts": rf"""WITH p AS (SELECT page_id, html, {_FLAT.format("regexp_replace(html, '(?s)<(?:script|style|noscript)[^>]*>.*?</(?:script|style|noscript)>', ' ', 'g')")} AS body,
          list_transform(regexp_extract_all(html, '(?s)<p(?: [^>]*)?>(.*?)</p>', 1), lambda x: {_FLAT.format('x')}) AS p, CAST(coalesce(list_sum(list_transform(regexp_extract_all(html, '(?s)<script[^>]*>(.*?)</script>', 1), lambda x: length(x))), 0) + 50000 * len(regexp_extract_all(html, '<script[^>]* src=')) AS BIGINT) AS script_bytes,
          lower({_FLAT.format("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}) AS title, lower(array_to_string(regexp_extract_all(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), ' ')) AS h1, lower(array_to_string(regexp_extract_all(html, '(?s)<noscript[^>]*>(.*?)</noscript>', 1), ' ')) AS noscript FROM pages),
        s AS (SELECT *, CAST(length(body) AS BIGINT) AS body_chars, CAST(coalesce(list_sum(list_transform(p, lambda x: length(x))), 0) AS BIGINT) AS article_chars, coalesce(list_sum(list_transform(p, lambda x: CASE WHEN length(x) >= 140 THEN sqrt(CAST(length(x) - 140 AS DOUBLE)) ELSE 0 END)), 0) > 20 AS readable FROM p),
        t AS (SELECT *, CAST(regexp_matches(html, '(?i)<input[^>]*type="password"') AND article_chars < 1500 AS INTEGER) + CAST(regexp_matches(html, '(?i)<form') AND (regexp_matches(title, '{LOGIN_HEADING}') OR regexp_matches(h1, '{LOGIN_HEADING}')) AS INTEGER) AS strong FROM s)
        SELECT page_id, script_bytes, body_chars, article_chars, readable, CASE WHEN article_chars >= 1500 THEN 'ok' WHEN article_chars >= 500 AND readable THEN 'ok' WHEN regexp_matches(html, '(?s)<div id="(?:root|app|__next)">\s*</div>') THEN 'client-rendered'
          WHEN regexp_matches(noscript, '{ENABLE_JS}') AND body_chars < 1000 THEN 'client-rendered' WHEN CAST(script_bytes AS DOUBLE) / greatest(body_chars, 1) > 20 AND body_chars < 2000 THEN 'client-rendered' WHEN regexp_matches(title, '{CHALLENGE}') AND body_chars < 1500 THEN 'client-rendered'
          WHEN article_chars < 200 AND body_chars < 500 THEN 'empty' WHEN article_chars >= 200 THEN 'ok' ELSE 'empty' END AS verdict,
          CASE WHEN strong >= 2 THEN 'login-required' WHEN regexp_matches(lower(substr(body, greatest(1, length(body) - 599))), '{PAYWALL}') AND article_chars < 1500 THEN 'paywall' WHEN strong = 1 THEN 'one-strong' ELSE 'none' END AS login FROM t""",
    "suggested_pairs": """WITH p AS (SELECT doc_id AS a, lead(doc_id) OVER (PARTITION BY source, lang, length(text) ORDER BY doc_id) AS b FROM documents), bad AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0)
        SELECT a, b FROM p WHERE b IS NOT NULL AND NOT (a IN (SELECT doc_id FROM bad) AND b IN (SELECT doc_id FROM bad))""",
    "unreferenced_blobs": "SELECT lang, count(*) AS n_blobs, min(sha) AS first_sha FROM (SELECT sha256(text) AS sha, min(lang) AS lang FROM documents GROUP BY 1 HAVING count(DISTINCT lang) = 1) GROUP BY lang",
    "added_sidecars": "SELECT sha256(text) AS sha, min(doc_id) AS doc_id FROM documents GROUP BY 1 HAVING min(doc_id) > (SELECT (min(doc_id) + max(doc_id)) / 2.0 FROM documents)",
    "pie_slices": """WITH c AS (SELECT o_orderstatus, dayofweek(o_orderdate) + 1 AS p, count(*) AS v FROM orders GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY v DESC, p) AS r FROM c)
        SELECT o_orderstatus, CASE WHEN r <= 4 THEN CAST(p AS VARCHAR) ELSE 'Other' END AS slice, CAST(sum(v) AS BIGINT) AS value FROM r GROUP BY 1, 2""",
    "ordered_bars": "SELECT p_brand, CAST(row_number() OVER (ORDER BY t DESC NULLS LAST, p_brand) AS INTEGER) AS place, CAST(t AS DOUBLE) AS total FROM (SELECT p_brand, sum(CAST(p_retailprice AS DECIMAL(18, 2))) AS t FROM part GROUP BY 1)",
    "capped_annotations": """WITH o AS (SELECT user_id, event_type, ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1)
        SELECT user_id, event_type, event_id, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS place FROM o) WHERE place <= 3""",
    "catalog_search": "SELECT doc_id, length(text) AS n FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'and') ORDER BY n DESC, doc_id LIMIT 20",
    "illegal_transitions": f"SELECT a, b, count(*) AS n FROM (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, event_type AS b FROM events) WHERE a IS NOT NULL AND (a, b) NOT IN ({', '.join(str(x) for x in ALLOWED)}) GROUP BY 1, 2",
    "retention_sweep": """WITH g AS (SELECT user_id, event_type, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-11') AS fresh, count(*) AS n FROM events GROUP BY 1, 2)
        SELECT user_id, CAST(sum(greatest(fresh, 1)) AS BIGINT) AS n_kept, CAST(sum(n) - sum(greatest(fresh, 1)) AS BIGINT) AS n_swept FROM g GROUP BY 1""",
    "capped_lines": "SELECT doc_id, CAST(least(2000, t) AS BIGINT) AS n_chars, t > 2000 AS truncated FROM (SELECT doc_id, length(replace(text, chr(10), '')) AS t FROM documents)",
    "paired_series": """WITH f AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), p AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
        SELECT strftime(coalesce(f.d, p.d), '%Y-%m-%d') AS day, coalesce(CAST(f.n AS VARCHAR), '') AS f, coalesce(CAST(p.n AS VARCHAR), '') AS p FROM f FULL JOIN p ON f.d = p.d""",
    "baseline_comparison": """SELECT source, round(a, 6) AS base, round(b, 6) AS other, b < a AS regressed FROM (SELECT source, avg(quality) FILTER (WHERE lang = 'en') AS a, avg(quality) FILTER (WHERE lang <> 'en') AS b FROM documents JOIN labels USING (doc_id) GROUP BY source) WHERE a IS NOT NULL AND b IS NOT NULL""",
    "usable_documents": r"SELECT source, count(*) FILTER (WHERE regexp_matches(text, '\S')) AS n_usable, count(*) AS n FROM documents GROUP BY source",
}
