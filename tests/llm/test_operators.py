"""Each operator against a plain version of its contract, over whole small tables and over odd rows."""

import glob
import hashlib
import os
import re
import shutil
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from docloom.llm import bpe, chat_format, components, decontaminate, line_crf, pii, quality_rules, queries, sharding, simhash_dedup, token_store, toxicity
from docloom.llm.common import new_path

ODD = [
    (1, "", "a"), (2, None, "b"), (None, "no id here, two words repeated repeated", "c"), (None, None, None), (5, "same text of five words", "d"), (6, "same text of five words", "d"),
    (6, "same text of five words", "d"), (7, "x" * 5000, None), (8, " \n\t ", "e"), (9, "mail a.b@c.d.e at 10.0.0.255 or 4111 1111 1111 1111, +1 (499) 555-6503", "f"), (10, "été naïve 中文 😀 <|endoftext|> Ünder\x1cscore", "g"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with columns whose names the operators use themselves."""
    rows = [(i, t, "en", s, None, 1, "k", 2.0) for i, t, s in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row int, shard string, score double")


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}


def result(spark, sf_dir, name):
    return {r.doc_id: r for r in queries.QUERIES[name](spark, sf_dir).collect()}


# 1 chat formatting


def test_roles_are_recovered(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    got = {(r.conv_id, r.turn): r for r in queries.op1_chat_format(spark, sf_dir).collect()}
    truth = {(r.conv_id, r.turn): r for r in turns.collect()}
    assert got.keys() == truth.keys()
    marked = {(r.conv_id, r.turn): r.marked for r in queries.raw_transcripts(turns).collect()}
    right = [got[k].role == truth[k].role for k in truth if marked[k]]
    assert sum(right) >= 0.95 * len(right)
    whole = "".join(got[k].rendered for k in sorted(k for k in got if k[0] == 0))
    assert whole.startswith("<|") and whole.endswith("<|end|>\n") and whole.count("<|end|>") == sum(got[k].n_turns for k in got if k[0] == 0)


def plain_viterbi(seen, model):
    score = model.scores(seen)
    best, back = model.start + score[0], []
    for row in score[1:]:
        ways = best[:, None] + model.moves
        back.append(ways.argmax(axis=0))
        best = ways.max(axis=0) + row
    out = [int(best.argmax())]
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return out[::-1]


def test_blocks_decode_as_one_pass(spark, sf_dir, monkeypatch):
    learn = queries.raw_transcripts(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    model = chat_format.fit(learn)
    monkeypatch.setattr(chat_format, "BLOCK", 2)
    monkeypatch.setattr(chat_format, "FAN", 2)
    rows = [(7, t, f"{['User: ', '', 'A: '][t % 3]}line {t}?\nmore of {t}.") for t in range(23)] + [(8, 0, f"tie {k}") for k in range(40)] + [(None, None, "Q: alone"), (9, 3, None), (9, 3, None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    got = chat_format.parse(turns, model).collect()
    assert sum(r.n_copies for r in got) == len(rows)
    lines = [line for _, t, text in rows[:23] for line in text.split("\n")]
    states = plain_viterbi([chat_format.observe(line)[0] for line in lines], model)
    assert [r.role for r in sorted((r for r in got if r.conv_id == 7), key=lambda r: r.turn)] == [chat_format.STATES[s][0] for s in states[::2]]
    assert len([r for r in got if r.conv_id == 8]) == 40 and chat_format.parse(turns.limit(0), model).count() == 0


@pytest.mark.parametrize("size", [2, 64])
def test_null_and_negative_turns(spark, sf_dir, monkeypatch, size):
    model = chat_format.fit(queries.raw_transcripts(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    monkeypatch.setattr(chat_format, "BLOCK", size)
    monkeypatch.setattr(chat_format, "FAN", size)
    made = []

    def written(df, name="cut"):
        made.append(name)
        assert len(made) < 60, "the run tree doesn't end"
        return new_written(df, name)

    new_written = chat_format.written
    monkeypatch.setattr(chat_format, "written", written)
    turns = {1: [None, -1, 0, 1], 2: [None, *range(-9, 12)], 3: [-70, 5], 4: [None, 900], None: [None, 3], 5: [0, 1]}
    rows = [(c, t, f"{['User: ', '', 'A: '][i % 3]}line {i}?\nmore of {i}.") for c, ts in turns.items() for i, t in enumerate(ts)]
    got = {(r.conv_id, r.turn): r for r in chat_format.parse(spark.createDataFrame(rows, "conv_id long, turn long, text string"), model).collect()}
    assert len(got) == len(rows)
    for c, ts in turns.items():
        lines = [line for d, _, text in rows if d == c for line in text.split("\n")]
        states = plain_viterbi([chat_format.observe(line)[0] for line in lines], model)
        assert [got[c, t].role for t in ts] == [chat_format.STATES[s][0] for s in states[::2]]
        assert got[c, ts[0]].rendered.startswith("<|") and got[c, ts[-1]].rendered.endswith("<|end|>\n")


def test_held_out_roles_beside_a_majority_rule(spark):
    sf_dir = "/root/testdata/sf0.1"
    raw = queries.raw_transcripts(spark.read.parquet(f"{sf_dir}/conversations.parquet")).collect()
    got = {(r.conv_id, r.turn): r.role for r in queries.op1_chat_format(spark, sf_dir).collect()}
    held = [r for r in raw if zlib.crc32(str(r.conv_id).encode()) % 3 == 1]
    share = {m: np.mean([got[r.conv_id, r.turn] == r.role for r in held if r.marked == m]) for m in (True, False)}
    unmarked = [r.role for r in held if not r.marked]
    majority = max(map(unmarked.count, set(unmarked))) / len(unmarked)
    print(share, majority)
    assert share[True] >= 0.97 and share[False] >= majority + 0.08


def test_equal_paths_go_to_the_earlier_states(spark):
    n = len(chat_format.STATES)
    flat = chat_format.Hmm(np.zeros(n), np.zeros((n, n)), [{} for _ in range(chat_format.FEATURES)], [np.zeros(n)] * chat_format.FEATURES)
    turns = spark.createDataFrame([(1, t, f"line {t}\nmore") for t in range(5)], "conv_id long, turn long, text string")
    assert {r.role for r in chat_format.parse(turns, flat).collect()} == {chat_format.STATES[0][0]}


# 2 sharding


def test_shards(spark, sf_dir, texts):
    got = result(spark, sf_dir, "op2_two_pass_shuffle")
    assert got.keys() == texts.keys()
    for i, r in got.items():
        data = texts[i].encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data)) and r.grown_shard in (r.shard, 8)
    for s in range(8):
        slots = [r.slot for r in got.values() if r.shard == s]
        assert sorted(slots) == list(range(len(slots)))
    order = sorted((r.shard, r.slot, i) for i, r in got.items())
    assert [i for _, _, i in order] != sorted(i for _, _, i in order)


def spark_hash(*parts):
    """XXH64 of Spark: integers as 4 or 8 little-endian bytes, text as UTF-8, chained through the seed; a null leaves it as it is."""
    h = 42
    for kind, v in parts:
        if v is not None:
            h = xxhash.xxh64_intdigest(struct.pack("<i" if kind == "int" else "<q", v) if kind != "text" else v.encode(), h)
    return h - (1 << 64) if h >> 63 else h


def plain_shard(doc_id, n):
    return max(range(n), key=lambda i: spark_hash(("int", sharding.SEED), ("int", i), ("long", doc_id)))


def test_shards_recomputed(spark, sf_dir, texts):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    size = 64 << 10
    rows = sharding.shards_of(docs, 8, bucket_bytes=size).select("doc_id", "shard", "bucket", "slot", "grown_shard").collect()
    each = -(-sum(len(t.encode()) + 1 for t in texts.values()) // (8 * size))
    for r in rows:
        assert (r.shard, r.grown_shard) == (plain_shard(r.doc_id, 8), plain_shard(r.doc_id, 9))
        assert r.bucket == r.shard * each + spark_hash(("int", sharding.SEED + 1), ("long", r.doc_id), ("text", texts[r.doc_id]), ("long", 0)) % each
    order = sorted((r.shard, r.slot, r.bucket) for r in rows)
    assert [b for _, _, b in order] == sorted(b for _, _, b in order) and len({(r.shard, r.slot) for r in rows}) == len(texts)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, sharding.shards_of(docs.repartition(3), 8, bucket_bytes=size).select("doc_id", "shard", "bucket", "slot", "grown_shard").collect()))


def test_files_are_in_slot_order(spark, sf_dir):
    import glob

    import pyarrow.parquet as pq

    path = new_path(spark, "shards")
    sharding.write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, 4, bucket_bytes=64 << 10)
    files = glob.glob(f"{path}/records/shard=*/*.parquet")
    assert len(files) > 4
    for f in files:
        t = pq.ParquetFile(f).read(columns=["bucket", "place"]).to_pydict()
        assert len(set(t["bucket"])) == 1 and t["place"] == list(range(len(t["place"])))


def test_equal_rows_are_split(spark):
    same = spark.range(4000).select(F.lit(7).cast("long").alias("doc_id"), F.repeat(F.lit("ab "), 100).alias("text"))
    docs = same.unionByName(spark.range(300).select(F.col("id").alias("doc_id"), F.lit("short").alias("text")))
    got = sharding.shards_of(docs, 2, bucket_bytes=64 << 10)
    biggest = got.groupBy("bucket").agg(F.sum("size").alias("b")).agg(F.max("b")).first()[0]
    assert biggest <= 3 * (64 << 10) and got.count() == 4300
    slots = got.where("shard = 0").select("slot").collect()
    assert sorted(r.slot for r in slots) == list(range(len(slots)))


def test_shards_of_odd_rows(spark, odd):
    def shards():
        return sharding.shards_of(odd, 3, bucket_bytes=64).select("doc_id", "shard", "slot", "row.score")

    rows = shards().collect()
    assert len(rows) == len(ODD)
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sorted(map(str, rows)) == sorted(map(str, shards().collect()))
    assert sharding.shards_of(odd.limit(0)).count() == 0


# 3 SimHash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_simhash(spark, sf_dir, texts):
    got = result(spark, sf_dir, "op3_simhash_dedup")
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r.component_id for i, r in got.items()} == plain_components(prints)


def test_simhash_chains(spark):
    chain = [0]
    for k in range(40):
        chain.append(chain[-1] ^ (0b11 << (k % 31) * 2))
    signed = [(10 + i, i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(dict.fromkeys(chain))] + [(None, 900, 0), (3, 901, -1)]
    prints = spark.createDataFrame(signed, "doc_id long, uid long, fp long")
    got = {r.uid: r.component_id for r in simhash_dedup.near_duplicates(prints).collect()}
    want = plain_components({u: p & (1 << 64) - 1 for _, u, p in signed})
    name = {}
    for d, u, _ in signed:
        if d is not None:
            name[want[u]] = min(d, name.get(want[u], d))
    assert got == {u: name[want[u]] for u in got}


def test_simhash_odd_rows(spark, odd):
    got = simhash_dedup.near_duplicates(simhash_dedup.fingerprints(odd)).collect()
    assert len(got) == len(ODD) and {r.component_id for r in got if r.fp == 0} == {1}
    assert simhash_dedup.near_duplicates(simhash_dedup.fingerprints(odd.limit(0))).count() == 0


def test_components_of_a_star_and_a_path(spark):
    edges = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(50)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(60)} | {100 + i: 100 for i in range(51)}


# 4 token store


def plain_ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def word_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))


def test_token_store(spark, sf_dir, texts, word_tokenizer):
    got = result(spark, sf_dir, "op4_token_store")
    start = 0
    for i in sorted(texts):
        ids = [*plain_ids(word_tokenizer, texts[i]), 1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)


def test_token_store_odd_rows(spark, odd, word_tokenizer):
    path = new_path(spark, "store")
    token_store.write(odd, path, queries.tokenizer_path("word_bpe_49k.json"))
    got = token_store.read(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((i for i, _, _ in ODD), key=lambda i: (i is not None, i or 0)) and got[0].start == 0
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    want = sorted(struct.pack(f"<{len(x) + 1}I", *x, 1) for x in (plain_ids(word_tokenizer, t) for _, t, _ in ODD))
    assert sorted(bytes(r.ids) for r in got) == want
    assert {(r.start, r.ids_crc32) for r in token_store.read_digests(spark, path).collect()} == {(r.start, zlib.crc32(bytes(r.ids))) for r in got}
    other = new_path(spark, "store")
    shutil.copytree(path, other)
    os.remove(glob.glob(f"{other}/chunks/*.parquet")[0])
    with pytest.raises(Exception, match="put together"):
        token_store.read_digests(spark, other).count()


def test_store_shares_chunks_and_copies(spark, word_tokenizer):
    base = " ".join(f"word{i % 997} and" for i in range(4000))
    docs = spark.createDataFrame([(1, base), (2, base), (3, base + " tail"), (4, "x " + base)], "doc_id long, text string")
    path = new_path(spark, "store")
    token_store.write(docs, path, queries.tokenizer_path("word_bpe_49k.json"))
    got = {r.doc_id: bytes(r.ids) for r in token_store.read(spark, path).collect()}
    for i, t in ((1, base), (2, base), (3, base + " tail"), (4, "x " + base)):
        ids = [*plain_ids(word_tokenizer, t), 1]
        assert got[i] == struct.pack(f"<{len(ids)}I", *ids)
    listed = spark.read.parquet(f"{path}/recipes").select(F.explode("hashes").alias("h"))
    assert spark.read.parquet(f"{path}/chunks").count() == listed.distinct().count() < 0.5 * listed.count()
    empty = new_path(spark, "store")
    token_store.write(docs.limit(0), empty, queries.tokenizer_path("word_bpe_49k.json"))
    assert token_store.read_digests(spark, empty).count() == 0


def test_word_encoder_fuzz(word_tokenizer):
    import random

    own, rnd = token_store.WordEncoder(queries.tokenizer_path("word_bpe_49k.json")), random.Random(8)
    letters = [*"aBz1 .'st-\n\t \x1c\x1f\x85\xa0éÉßİ中😀²́_<|>\r", "<|endoftext|>", "e\u0301", "the", "  ", "ﬁ"]
    made = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(4000)]
    ids, bounds = own.encode_all(made)
    for t, a, b in zip(made, bounds, bounds[1:]):
        assert ids[a:b].tolist() == plain_ids(word_tokenizer, t), repr(t)


# 5 decontamination


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_contamination(texts, items):
    windows = {}
    for i, t in items:
        w = plain_words(t)
        n = min(10, len(w))
        for p in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[p : p + n]), set()).add(i)
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, t in texts:
        w, hit, found = plain_words(t), set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if (ids := windows.get(tuple(w[p : p + n]))) is not None:
                    hit |= set(range(p, p + n))
                    found |= ids
        out.append((doc_id, len(w), len(hit), len(found), ",".join(sorted(str(i) for i in found)), bool(hit)))
    return out


def test_decontamination(spark, sf_dir, texts):
    got = result(spark, sf_dir, "op5_decontaminate")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = plain_contamination(texts.items(), items)
    assert any(w[-1] for w in want)
    for i, n_words, n_hit, n_items, listed, bad in want:
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n_words, n_hit, n_items, hashlib.sha256(listed.encode()).hexdigest(), bad)


def test_decontamination_short_items(spark, odd):
    items = [(1, "Same TEXT"), (2, "same text"), (3, ""), (4, None), (5, "words"), (6, "a b c d e f g h i j k l"), (7, "text of five words same text of five")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([*[(i, t) for i, t, _ in ODD], (20, "z a b c d e f g h i j a b c d e f g h i j k l l"), (21, "b c d e f g h i j k")], "doc_id long, text string")
    got = decontaminate.decontaminate(docs, bench)
    rows = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r["items"], r.contaminated) for r in got.collect()]
    want = plain_contamination([(r.doc_id, r.text) for r in docs.collect()], [i for i in items if i[1]])
    assert sorted(map(str, rows)) == sorted(map(str, want))
    assert decontaminate.decontaminate(odd, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.decontaminate(odd.limit(0), bench).count() == 0


# 6 BPE


def test_bpe(spark, sf_dir, texts, odd):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    got = result(spark, sf_dir, "op6_bpe")
    for i, t in texts.items():
        ids = plain_ids(tokenizer, t)
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    for r in bpe.encode(odd, queries.tokenizer_path("byte_bpe_50k.json")).select("row.text", "ids", "decoded").collect():
        ids = plain_ids(tokenizer, r.text)
        assert bytes(r.ids) == struct.pack(f"<{len(ids)}I", *ids) and r.decoded == tokenizer.decode(ids, skip_special_tokens=False)


def test_bpe_fuzz():
    import random

    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    tokenizer, own, rnd = Tokenizer.from_file(path), bpe.ByteBpe(path), random.Random(5)
    letters = [*"aB1 .'stre\n\t \x1c\x85\xa0é中😀²́_-<|>\r", "<|endoftext|>", "'re", "  "]
    for _ in range(4000):
        t = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 80)))
        assert list(struct.unpack(f"<{len(own.encode(t)) // 4}I", own.encode(t))) == plain_ids(tokenizer, t), repr(t)


# 7 and 8 classifiers


@pytest.mark.parametrize(("name", "label", "least"), [("op7_line_crf_quality", "quality", 0.95), ("op8_toxicity", "toxic", 0.97)])
def test_held_out_accuracy(spark, name, label, least):
    sf_dir = "/root/testdata/sf0.1"
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = result(spark, sf_dir, name)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 for i, r in got.items())
    held = [(r.predicted, truth[i]) for i, r in got.items() if r.held_out and i in truth]
    assert sum(t == 1 for _, t in held) < least * len(held) and sum(t == 0 for _, t in held) < least * len(held)  # no constant answer passes
    assert sum(p == t for p, t in held) >= least * len(held)


def test_marginals_and_viterbi_against_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    lengths, moves = [1, 4, 3], rng.normal(size=(2, 2))
    start = np.concatenate([[0], np.cumsum(lengths)])
    node = rng.normal(size=start[-1])
    good, pairs, log_z = line_crf.marginals(node, moves, start)
    best = line_crf.viterbi(node, moves, start)
    total = 0.0
    for a, b in zip(start, start[1:]):
        paths = list(itertools.product((0, 1), repeat=int(b - a)))
        score = np.array([sum(node[a + i] * s for i, s in enumerate(p)) + sum(moves[x, y] for x, y in zip(p, p[1:])) for p in paths])
        weight = np.exp(score - np.logaddexp.reduce(score))
        total += np.logaddexp.reduce(score)
        assert np.allclose(good[a:b], weight @ np.array(paths)) and tuple(best[a:b]) == paths[int(score.argmax())]
    assert np.isclose(total, log_z) and np.isclose(pairs.sum(), sum(lengths) - len(lengths))


def plain_profile(word):
    import itertools

    at = [(i + 1, c) for i, c in enumerate(word) if c != " "]
    if not at:
        return {}
    at = [(at[0][0] - 1, "<"), *at, (at[-1][0] + 1, ">")]
    out = {}
    for size in toxicity.LENGTHS:
        for picked in itertools.combinations(range(len(at)), size):
            if picked[-1] - picked[0] <= toxicity.REACH and len(at) >= 4:
                code = int(toxicity._buckets([np.array([ord(at[i][1])], np.uint32) for i in picked])[0])
                out[code] = out.get(code, 0) + toxicity.DECAY ** (at[picked[-1]][0] - at[picked[0]][0] + 1)
    norm = np.sqrt(sum(v * v for v in out.values())) or 1
    return {k: v / norm for k, v in out.items()}


def test_kernel_against_definition():
    words = ["idiot", "i d i o t", "banana", "ab", "pathetic", "réêou", "", "中文字"]
    word, code, weight = toxicity.profile(words)
    for i, w in enumerate(words):
        have, want = dict(zip(code[word == i], weight[word == i])), plain_profile(w)
        assert have.keys() == want.keys() and all(abs(have[k] - want[k]) < 1e-9 for k in want)


def test_folded_weights_are_the_kernel_expansion():
    """A machine's weights against its decision written with k(x, landmark) for every landmark."""
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdeé"), 6)) for _ in range(60)]
    kernel = np.array([[sum(v * plain_profile(b).get(k, 0) for k, v in plain_profile(a).items()) for b in words[:20]] for a in words])
    table = np.zeros((toxicity.BUCKETS, 20), np.float32)
    word, code, weight = toxicity.profile(words[:20])
    table[code, word] = weight
    value, vector = np.linalg.eigh((table.T @ table).astype(float))
    root = (vector / np.sqrt(np.maximum(value, 1e-3))) @ vector.T
    x = toxicity._features(words, table, root.astype(np.float32))
    assert np.allclose(x[:, :-1], kernel @ root, atol=1e-4)
    w, bias = toxicity._linear_svm(x, np.stack([np.arange(60) % 2, 1 - np.arange(60) % 2], axis=1).astype(float))
    machine = toxicity.Machine(table @ (root @ w), bias, np.zeros(len(toxicity.LEVELS)), np.zeros(3))
    assert np.allclose(machine.decisions(words), kernel @ (root @ w) + bias, atol=1e-3)


@pytest.fixture(scope="module")
def trained(spark):
    sf_dir = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.join(labels, "doc_id").select("doc_id", "text", "toxic", "lang").collect()
    return toxicity.Scorer(toxicity.fit(docs, labels)), [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]


def found(scorer, texts):
    return scorer.machine.probability(scorer.worst(texts), scorer.sizes) >= 0.7


def test_toxicity_by_language(trained):
    scorer, rows = trained
    got = found(scorer, [r.text for r in rows])
    toxic = np.array([r.toxic == 1 for r in rows])
    lang = np.array([r.lang for r in rows])
    recall = {k: float(got[toxic & (lang == k)].mean()) for k in sorted(set(lang))}
    wrong = {k: float(got[~toxic & (lang == k)].mean()) for k in sorted(set(lang))}
    print("recall", float(got[toxic].mean()), recall, "precision", float(toxic[got].mean()), "clean taken for toxic", wrong)
    assert got[toxic].mean() >= 0.9 and toxic[got].mean() >= 0.9 and min(recall.values()) >= 0.8 and max(wrong.values()) <= 0.04


def test_altered_insults_of_held_out_rows(trained):
    scorer, rows = trained
    insult = re.compile(r"\b(idiot|stupid|scum|clown|disgusting|loser|worthless|trash|moron|pathetic)\b")
    toxic = [r.text for r in rows if r.toxic and insult.search(r.text)]

    def put(add):
        return [insult.sub(lambda m, k=k: (w := m[0])[: (at := 1 + k % (len(w) - 1))] + add(k, w[at - 1]) + w[at:], t) for k in range(40) for t in toxic]

    made = {"inserted": put(lambda k, _: chr(97 + k * 7 % 26)), "doubled": put(lambda _, c: c), "gap": put(lambda _, c: "."), "spaced": [insult.sub(lambda m: " ".join(m[0]), t) for t in toxic]}
    recall = {k: float(found(scorer, t).mean()) for k, t in made.items()}
    print(len(toxic), recall)
    assert len(toxic) >= 50 and min(recall.values()) >= 0.9


def test_classifiers_on_odd_rows(spark, odd):
    from docloom.llm import quality_classifier

    labels = spark.createDataFrame([(i, 1, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    crf = quality_classifier.fit(odd, labels)
    assert quality_classifier.score(odd, crf).count() == len(ODD) and quality_classifier.score(odd.limit(0), crf).count() == 0
    machine = toxicity.fit(odd, labels)
    rows = toxicity.score(odd, machine).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert quality_rules.judge(odd, crf).where("base_failed and kept").count() == 0


# 9 PII


def plain_pii(text):
    def luhn(d):
        return sum(v if i % 2 == 0 else 2 * v - 9 * (v > 4) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0

    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    out = []
    for k, p in enumerate(patterns):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if k == 0 or k == 1 and all(int(x) <= 255 for x in m[0].split(".")) or k == 2 and 14 <= len(d) <= 19 and luhn(d) or k == 3 and 10 <= len(d) <= 15:
                out.append((m.start(), k, m.end()))
    return [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out)]


def test_pii(spark, sf_dir, texts):
    got = result(spark, sf_dir, "op9_pii")
    for i, t in texts.items():
        want = plain_pii(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.BASE] == [sum(x.startswith(k + ":") for x in want) for k in pii.BASE]


def test_pii_cases(spark):
    import random

    rnd = random.Random(3)
    parts = ["a.b@c.d", "x@y", "@", "..", "1.2.3.4", "999.1.1.1", "4111111111111111", "4111-1111 1111-1111", " ", "-", "--", "+1 499 555 6503", "+", "12", ".", "é", "😀", "DE89370400440532013000", "\x01", "\x02", "007.0.0.01", "a_b%c@d-e.f.g", "\n"]
    cases = ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 12))) for _ in range(3000)]
    cases += ["1" * 20000, "a" * 50000, "a@" + "b." * 5000 + "c", "1-" * 9000 + "1", "+1 " + "2 3(" * 4000, " ".join(["+14995556503"] * 3000), "iban DE89370400440532013000 ok", "my ssn is 123-45-6789", None]
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(df).select("doc_id", pii.described(F.col("spans")).alias("s"), pii.redacted(F.col("text"), F.col("spans")).alias("clean")).collect()}
    for i, t in enumerate(cases):
        assert [x for x in got[i].s.split(",") if x.split(":")[0] in pii.BASE] == plain_pii(t), repr(t)[:200]
    assert "iban:5:27" in got[len(cases) - 3].s and got[len(cases) - 3].clean == "iban <IBAN> ok"
    assert got[len(cases) - 2].s == "ssn:10:21" and got[len(cases) - 1].clean == ""


def test_pii_of_a_long_text_takes_linear_time(spark):
    import time

    text = " ".join(f"u{i}x.y@mail{i % 7}.example.org" for i in range(36_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    r = pii.find(docs).select(pii.described(F.col("spans")).alias("s"), pii.redacted(F.col("text"), F.col("spans")).alias("clean")).first()
    assert time.time() - began < 60 and len(text) > 900_000
    assert r.s.split(",") == plain_pii(text) and r.clean == " ".join(["<EMAIL>"] * 36_000)


def test_pii_added_kinds(spark):
    cases = ["IBAN DE89 3704 0044 0532 0130 00 ok", "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\"", "no name 04dbebab91ab85687d33eeaaf9ac699e1188f962", "my account GB82WEST12345698765432."]
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(df).select("doc_id", pii.described(F.col("spans")).alias("s"), pii.scores(F.col("spans")).alias("p")).collect()}
    assert [got[i].s for i in range(4)] == ["iban:5:32", "secret:9:49", "", "iban:11:33"] and got[0].p == "1.00" and got[1].p == "0.80"


# 10 quality rules


def plain_counts(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(hit)


def test_quality_rules(spark, sf_dir, texts):
    got = result(spark, sf_dir, "op10_quality_rules")
    for i, t in texts.items():
        if len(t) < 20000:
            r = got[i]
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(t)
            assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept)
    for t in ("", "a b a b a b a b a b a b", "a\na\n \n \na", "x " * 40 + "y"):
        assert quality_rules.counts_of(t) == plain_counts(t)


def test_quality_rules_against_labels(spark):
    sf_dir = "/root/testdata/sf0.1"
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [(r.base_failed, r.kept, good[r.doc_id]) for r in queries.op10_quality_rules(spark, sf_dir).collect() if r.doc_id in good]
    passed = [(k, g) for failed, k, g in rows if not failed]
    assert sum(k for k, g in passed if g) >= 0.97 * sum(g for _, g in passed)


# long texts and slices


def test_slices_by_rows_and_bytes():
    import pyarrow as pa

    from docloom.llm.common import slices

    texts = pa.array(["a" * 10, None, "b" * 100, "c", "d", "é" * 6])
    assert list(slices(texts, 3, 24)) == [(0, 2), (2, 3), (3, 6)] and list(slices(texts, 1, 1000)) == [(i, i + 1) for i in range(6)]
    assert list(slices(pa.array([], pa.string()), 3, 24)) == []


def test_long_texts_in_pieces(monkeypatch):
    text = "\n".join(f"alpha beta {i % 50} gamma delta epsilon zeta eta {i % 7} theta" for i in range(3000))
    whole = line_crf.lines_of([text, "", "x\n\ny"]).x, simhash_dedup.fingerprint(text), quality_rules.repeated_words(text.encode(), text.encode().split())
    hashes = decontaminate.shingle_hashes([text.encode().split(), [b"one", b"two"]], [1, 2, 5])
    monkeypatch.setattr(line_crf, "PART", 1000)
    monkeypatch.setattr(quality_rules, "LONG", 10)
    monkeypatch.setattr(decontaminate, "PART", 77)
    assert np.allclose(line_crf.lines_of([text, "", "x\n\ny"]).x, whole[0]) and simhash_dedup.fingerprint(text) == whole[1] == plain_fingerprint(text)
    assert quality_rules.repeated_words(text.encode(), text.encode().split()) == whole[2]
    for k, (h, at) in decontaminate.shingle_hashes([text.encode().split(), [b"one", b"two"]], [1, 2, 5]).items():
        assert (h == hashes[k][0]).all() and (at == hashes[k][1]).all()


def test_a_text_longer_than_a_slice(spark):
    """One text longer than a slice goes whole through every operator that maps texts."""
    from docloom.llm import quality_classifier

    words = 6_000_000 // 8
    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(words)), lambda i: F.concat(F.lit("w"), (i.cast("long") * 48271 % 2147483647 % 10000019).cast("string"), F.when(i % 12 == 0, "\n").otherwise(""))), " ").alias("text"))
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    assert docs.select(F.octet_length("text")).first()[0] > 5_000_000
    crf = quality_classifier.fit(docs, labels)
    counts = quality_rules.judge(docs, crf).first()
    assert counts.n_words == words and counts.kept
    assert quality_classifier.score(docs, crf).count() == 1 and toxicity.score(docs, toxicity.fit(docs, labels)).first().predicted == 0
    assert simhash_dedup.fingerprints(docs).first().fp != 0
    bench = docs.select(F.lit(1).alias("item_id"), F.substring_index(F.substring("text", 3_000_000, 200), " ", 14).alias("text"))
    assert decontaminate.decontaminate(docs, bench).first().contaminated
    ids = bpe.encode(docs, queries.tokenizer_path("byte_bpe_50k.json")).select(F.sha2("decoded", 256), F.sha2("row.text", 256)).first()
    assert ids[0] == ids[1]
