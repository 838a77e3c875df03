"""Bytes, lines and listings on their way in, against plain versions and files."""

import random

import pytest
from pyspark.sql import types as T

from docloom.operators import listings
from docloom.sources import payloads, rejects


def plain_text(b):
    if b is None:
        return None, None
    for mark, name, codec in ((b"\xef\xbb\xbf", "utf-8", "utf-8"), (b"\xff\xfe", "utf-16le", "utf-16-le"), (b"\xfe\xff", "utf-16be", "utf-16-be")):
        if b.startswith(mark):
            body = b[len(mark) :]
            return name, (body if name == "utf-8" else body[: len(body) // 2 * 2]).decode(codec, "replace")
    text = b.decode("utf-8", "replace")
    if text and text.count("�") / len(text) > 0.01:
        return "windows-1252", "".join(bytes([c]).decode("cp1252", "ignore") or chr(c) for c in b)
    return "utf-8", text


def test_files_read_back(spark, tmp_path):
    texts = ["plain", "été €uro “quoted”", "中文 😀", "", "a" * 500]
    made = {}
    for i, t in enumerate(texts):
        for codec, mark in (("utf-8", b""), ("utf-8", b"\xef\xbb\xbf"), ("utf-16-le", b"\xff\xfe"), ("utf-16-be", b"\xfe\xff"), ("cp1252", b"")):
            if codec != "cp1252" or i in (0, 1):
                made[f"{i}-{codec}-{len(mark)}"] = mark + t.encode(codec)
    made |= {"odd": b"\xff\xfeA\x00B", "lone": b"\xfe\xff\xd8\x00\x00A", "few": b"x" * 500 + b"\xe9", "undefined": b"\x81\x8d\x80"}
    (tmp_path / "sub").mkdir()
    for name, b in made.items():
        (tmp_path / "sub" / name).write_bytes(b)
    got = {r.path.rsplit("/", 1)[1]: (r.encoding, r.text) for r in payloads.decoded(payloads.files(spark, str(tmp_path))).collect()}
    assert got == {name: plain_text(b) for name, b in made.items() if b}  # Spark's reader leaves out empty files
    with pytest.raises(ValueError):
        payloads.decoded(spark.createDataFrame([(b"", "x")], "content binary, text string"))


def test_kinds(spark):
    want = [
        (b"%PDF-1.4", "pdf"), (b"\x89PNG\r\n\x1a\n..", "png"), (b"\xff\xd8\xff\xe0", "jpeg"), (b"GIF89a", "gif"), (b"PK\x03\x04", "zip"), (b"RIFF1234WEBP", "webp"), (b"RIFF1234WAVE\x00", "binary"), (b"", "text"), (b"text", "text"),
        (b"\n <!DOCTYPE html>", "html"), (b"<html lang=en>", "html"), (b"<htmlx>", "text"), (b"a\x00b", "binary"), (b"\xff\xfea\x00", "text"), (b"\xe9" * 3 + b"x" * 97, "binary"), (b"\xe9" + b"x" * 99, "text"), ("�" * 9).encode(), None,
    ]
    want = [w if isinstance(w, tuple) else (w, "text") for w in want if w is not None] + [(None, None)]
    df = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(want)], "i int, content binary")
    assert {r.i: r.k for r in df.select("i", payloads.kind(df["content"]).alias("k")).collect()} == {i: k for i, (_, k) in enumerate(want)}


def test_kept_and_rejected_lines_add_up(spark):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("day", T.DateType()), T.StructField("name", T.StringType())])
    lines = [
        ("a", "1,2024-01-02,x", None), ("a", '2,,"y, z"', None), ("a", "x,2024-01-02,n", "E_VALUE"), ("a", "3,2024-01-02", "E_FIELDS"), ("a", "", "E_EMPTY"), ("a", None, "E_EMPTY"), ("a", "4,2024-01-02,ok", None), ("a", "5,,", None),
        ("b", "1,2,3,4", "E_FIELDS"), ("b", "1,someday,x", "E_VALUE"), ("b", "1,2024-01-02,x", "E_FILE"), (None, "7,2024-01-02,x", None),
    ]
    df = spark.createDataFrame([(i, f, x, "other") for i, (f, x, _) in enumerate(lines)], "key int, file string, line string, row string")
    got = {r.key: r for r in rejects.parsed(df, schema).collect()}
    assert {k: r.code for k, r in got.items()} == {i: c for i, (*_, c) in enumerate(lines)}
    assert all((r.code is None) == (r.row is not None) and (r.code is None) == (r.reason is None) for r in got.values())
    assert tuple(got[1].row) == (2, None, "y, z") and got[2].reason == "not readable: id" and got[3].reason == "2 fields of 3"
    assert rejects.parsed(df.limit(0), schema).count() == 0


def test_history_of_all_listings_and_one_by_one(spark):
    rng = random.Random(8)
    last = 14
    seen = [(d, n, rng.choice(["live", "live", "trash"])) for d in range(20) for n in range(last + 1) if rng.random() < rng.choice([0.3, 0.9]) for _ in range(rng.choice([1, 1, 2]))] + [(None, 3, "live"), (3, None, "live")]
    want = set()
    for d in range(20):
        state, since = None, None
        for n in range(last + 1):
            kinds = {k for x, m, k in seen if x == d and m == n}
            now = "live" if "live" in kinds else "trashed" if kinds else None if state is None else "purged" if state in ("trashed", "purged") else "absent"
            if now != state:
                if state:
                    want.add((d, state, since, n))
                state, since = now, n
        if state:
            want.add((d, state, since, None))
    df = spark.createDataFrame(seen, "doc long, listing int, kind string")
    assert {tuple(r) for r in listings.history(df, last).collect()} == want
    past = listings.history(df.where("listing <= 9"), 9)
    for n in range(10, last + 1):
        past = spark.createDataFrame(listings.merge(past, df.where(f"listing = {n}"), n).collect(), "doc long, state string, valid_from long, valid_to long")
    assert {tuple(r) for r in past.collect()} == want
    assert listings.history(df.limit(0), 3).count() == 0
