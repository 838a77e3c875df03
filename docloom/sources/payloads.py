"""Bytes on their way in: what a file is by its first bytes, and its text by mark or fallback.

Files come by Spark's binaryFile reader; everything is column expressions but the decoding of marked UTF-16, for which Spark has no function that replaces what is malformed.

Nulls and edge cases: null bytes give null; no bytes are an empty text (of empty files Spark's reader makes no rows); malformed parts become U+FFFD; an odd last byte of UTF-16 is dropped; whole payloads are looked at, not their beginnings.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# First bytes of formats, byte order marks, shares of invalid UTF-8 of a text and before the fallback.
MAGIC = {"25504446": "pdf", "89504E470D0A1A0A": "png", "FFD8FF": "jpeg", "47494638": "gif", "504B0304": "zip", "D0CF11E0A1B11AE1": "ole", "424D": "bmp", "49492A00": "tiff", "4D4D002A": "tiff"}
MARKS = {"EFBBBF": "utf-8", "FFFE": "utf-16le", "FEFF": "utf-16be"}
TEXT_INVALID, FALLBACK_INVALID = 0.02, 0.01
REPLACEMENT = "�"
#: What the codes 80 to 9F stand for in windows-1252; five of them stay.
_CODES = [c for c in range(0x80, 0xA0) if bytes([c]).decode("cp1252", "ignore")]
_FROM, _TO = "".join(map(chr, _CODES)), bytes(_CODES).decode("cp1252")


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, length and content of all files below a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


@F.pandas_udf(T.StringType())
def _utf16(content: pd.Series, little: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else bytes(c[: len(c) // 2 * 2]).decode("utf-16-le" if x else "utf-16-be", "replace") for c, x in zip(content, little)], dtype=object)


def _mark(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 3))
    return F.coalesce(*[F.when(head.startswith(m), name) for m, name in MARKS.items()])


def _utf8(content: Column) -> Column:
    return F.make_valid_utf8(content.cast("string"))


def _latin(content: Column) -> Column:
    return F.translate(F.decode(content, "ISO-8859-1"), _FROM, _TO)


def decoded(df: DataFrame, content: str = "content") -> DataFrame:
    """df with encoding and text: by mark, else UTF-8, or windows-1252 where over FALLBACK_INVALID of UTF-8's characters are replacements."""
    if clash := sorted({"encoding", "text"} & set(df.columns)):
        raise ValueError(f"columns {clash} of the input would be lost")
    raw, mark = F.col(content), _mark(F.col(content))
    body = F.when(mark == "utf-8", F.substring(raw, 4, 2**31 - 1)).when(mark.isNotNull(), F.substring(raw, 3, 2**31 - 1)).otherwise(raw)
    plain = _utf8(body)
    lost = F.length(plain) - F.length(F.replace(plain, F.lit(REPLACEMENT), F.lit("")))
    fallback = mark.isNull() & (F.length(plain) > 0) & (lost / F.length(plain) > FALLBACK_INVALID)
    wide = F.when(mark.startswith("utf-16"), body)
    encoding = F.when(raw.isNull(), None).when(fallback, "windows-1252").otherwise(F.coalesce(mark, F.lit("utf-8")))
    marked = df.select("*", encoding.alias("encoding"), _utf16(wide, mark == "utf-16le").alias("text"))
    return marked.withColumn("text", F.when(F.col("encoding").startswith("utf-16"), F.col("text")).when(F.col("encoding") == "windows-1252", _latin(raw)).otherwise(plain))


def kind(content: Column) -> Column:
    """The format: by first bytes, else html or text, or binary where a zero byte or too much that is no UTF-8 stands in it."""
    head = F.hex(F.substring(content, 1, 12))
    magic = F.coalesce(*[F.when(head.startswith(m), name) for m, name in MAGIC.items()], F.when(head.rlike("^52494646.{8}57454250"), "webp"))
    plain = _utf8(content)
    own = F.regexp_count(F.decode(content, "ISO-8859-1"), F.lit("ï¿½"))  # replacement characters that the file itself has
    invalid = F.regexp_count(plain, F.lit(REPLACEMENT)) - own
    is_text = _mark(content).startswith("utf-16") | (~F.contains(plain, F.lit("\0")) & (invalid <= TEXT_INVALID * F.octet_length(content)))
    html = plain.rlike(r"(?i)^﻿?\s*<(?:!doctype\s+html|html[\s>])")
    return F.when(content.isNull(), None).otherwise(F.coalesce(magic, F.when(F.coalesce(is_text, F.lit(False)), F.when(html, "html").otherwise("text")), F.lit("binary")))
