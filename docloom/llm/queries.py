"""Queries that run the operators over whole tables, and SQL for those that SQL can express.

Each query takes its rows from its operator; what it adds are the digest columns of its contract.
"""

from __future__ import annotations

import importlib.util
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, decontaminate, jaccard_join, periodic_runs, pii, quality_classifier, quality_rules, sharding, simhash_dedup, token_store, toxicity, turn_repair
from .common import new_path, table


def tokenizer_path(name: str) -> str:
    """A vocabulary file: in the folder that DOCLOOM_TOKENIZERS names, or else among the installed public tokenizers."""
    folder = os.environ.get("DOCLOOM_TOKENIZERS")
    if not folder:
        spec = importlib.util.find_spec("public_tokenizers")
        folder = os.path.dirname(spec.origin) if spec else "/opt/tokenizers"
    return os.path.join(folder, name)


def raw_transcripts(conversations: DataFrame) -> DataFrame:
    """The conversations as transcripts without roles: three turns in five begin with a speaker name in the style of their conversation, the others with none.

    One turn in seven of two lines or more has a decoy: its second line begins with some speaker's name. role and marked stay beside for training and for
    measuring; parse() reads neither.
    """
    styles = [("User: ", "Assistant: ", "System: "), ("### Human:\n", "### Bot:\n", "### Instructions:\n"), ("[customer] ", "[agent] ", "[system] "), ("Q: ", "A: ", "System: "), ("**User:** ", "**AI:** ", "**System:** ")]
    style = F.pmod(F.xxhash64(F.col("conv_id")), F.lit(len(styles)))
    of_role = {r: F.element_at(F.array(*[F.lit(s[i]) for s in styles]), (style + 1).cast("int")) for i, r in enumerate(("user", "assistant", "system"))}
    marked = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(5)) > 1
    other = F.element_at(F.array(*of_role.values()), (F.pmod(F.xxhash64("turn", "conv_id"), F.lit(3)) + 1).cast("int"))
    body = F.coalesce("text", F.lit(""))
    decoy = (F.pmod(F.xxhash64("conv_id", "turn", F.lit(1)), F.lit(7)) == 0) & body.contains("\n")
    body = F.when(decoy, F.concat(F.substring_index(body, "\n", 1), F.lit("\n"), other, F.substr(body, F.instr(body, "\n") + 1))).otherwise(body)
    name = F.when(~marked, "").otherwise(F.coalesce(*[F.when(F.col("role") == r, m) for r, m in of_role.items()], F.lit("")))
    return conversations.select("conv_id", "turn", "role", marked.alias("marked"), F.concat(name, body).alias("text"))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_transcripts(table(spark, sf_dir, "conversations"))
    learn = raw.where(F.crc32(F.col("conv_id").cast("string").cast("binary")) % 3 != 1)
    return chat_format.parse(raw, chat_format.fit(learn))


def op2_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shards_of(table(spark, sf_dir, "documents"), 8)
    crc = F.crc32(F.coalesce(F.col("row.text"), F.lit("")).cast("binary"))
    return found.select("doc_id", F.col("size").cast("long").alias("size"), crc.alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(simhash_dedup.fingerprints(table(spark, sf_dir, "documents")))
    return found.select("doc_id", simhash_dedup.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "store")
    token_store.write(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"), end_id=1)
    return token_store.read_digests(spark, path)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2("items", 256).alias("items_sha256"), "contaminated")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels"))).drop("row")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))).drop("row")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind_ix"] < len(pii.BASE))
    return found.select("doc_id", *[of(k) for k in pii.BASE], F.sha2(pii.described(base), 256).alias("base_sha256"), pii.described(F.col("spans")).alias("spans"), pii.scores(F.col("spans")).alias("scores"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels"))).drop("row")


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    left = turn_repair.damaged(given)
    repair = turn_repair.Repair(left)
    places = left.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).cast("long").alias("gaps")).withColumnRenamed("conv_id", "of")
    found = repair.conversations().join(repair.digests(), "cid").join(places, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    found = found.select(F.col("conv_id").alias("of"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "sha256")
    every = given.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.runs(periodic_runs.with_planted_repeats(table(spark, sf_dir, "documents")), keep_rows=False)
    best = found.withColumn("best", periodic_runs.longest(F.col("runs")))
    share = F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long")
    hashes = [F.sha2(periodic_runs.listed(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")]
    return best.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", share.alias("exponent_milli"), *hashes)


QUERIES = {
    f.__name__: f
    for f in (op1_chat_format, op2_two_pass_shuffle, op3_simhash_dedup, op4_token_store, op5_decontaminate, op6_bpe, op7_line_crf_quality, op8_toxicity, op9_pii, op10_quality_rules, op11_turn_repair, op12_jaccard_join, op13_periodic_runs)
}

ORACLE_SQL = {
    "op5_decontaminate": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[p + 1 : p + n], ' ') AS g FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(0, len(w) - least(10, len(w)) + 1)) AS p FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, p, n, array_to_string(w[p + 1 : p + n], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS p FROM d CROSS JOIN (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT dw.doc_id, dw.p, dw.n, bw.item_id FROM dw JOIN bw USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS i FROM (SELECT DISTINCT doc_id, p, n FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(words.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items.items, '')) AS items_sha256, coalesce(words.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""",
}
