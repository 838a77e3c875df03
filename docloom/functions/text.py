"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token estimates, and ranges that count as CJK.
CJK = r"[぀-ヿ㐀-䶿一-鿿가-힯]"
CJK_SHARE, CJK_CHARS, OTHER_CHARS = 0.3, 1.5, 3.5
# Fixed value: whole numbers up to this one don't count as stated numbers.
SMALL_NUMBER = 10


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits of two characters or more."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) >= 2)


def sentences(text: Column) -> Column:
    """Pieces between . ! ? or a line feed and what follows."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s)), lambda s: s != "")


def word_count(text: Column) -> Column:
    """White-space tokens that hold a letter or a digit."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]\S*+"))


def estimated_tokens(text: Column) -> Column:
    """Characters over 3.5, or over 1.5 where over 30 % are CJK, rounded up; an empty text has none."""
    n = F.length(text)
    share = F.regexp_count(text, F.lit(CJK)) / n
    return F.when(n == 0, 0).otherwise(F.ceil(n / F.when(share > CJK_SHARE, CJK_CHARS).otherwise(OTHER_CHARS))).cast("long")


def two_instructions(sentence: Column) -> Column:
    return sentence.rlike(r"(?i)\band then\b") | sentence.rlike(r";\s")


def stated_numbers(text: Column) -> Column:
    """Distinct numbers of a text without thousands separators, but for whole ones from 0 to SMALL_NUMBER."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"[0-9][0-9,]*(?:\.[0-9]+)?"), 0), lambda n: F.replace(n, F.lit(",")).cast("double"))
    return F.array_distinct(F.filter(found, lambda v: ~((v == F.floor(v)) & v.between(0, SMALL_NUMBER))))


def bold_terms(text: Column) -> Column:
    """Distinct **terms** of 3 to 60 characters in lower case."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\*\*([^*\n]+)\*\*"), 1), lambda t: F.lower(F.trim(t)))
    return F.array_distinct(F.filter(found, lambda t: F.length(t).between(3, 60)))


def masked(secret: Column) -> Column:
    """The first four characters, then at most 16 stars."""
    return F.concat(F.substring(secret, 1, 4), F.repeat(F.lit("*"), F.greatest(F.lit(0), F.least(F.lit(16), F.length(secret) - 4))))


def key_url(url: Column) -> Column:
    """A URL for comparison: trimmed, one layer of quotes off, https before a bare host, scheme and host in lower case, no fragment."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"^[<\"'](.*)[>\"']$", "$1"), r"#.*$", "")
    full = F.when(bare.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), bare).otherwise(F.concat(F.lit("https://"), bare))
    head = F.regexp_extract(full, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1)
    return F.concat(F.lower(head), F.substr(full, F.length(head) + 1))


def host_of(url: Column) -> Column:
    """The host in lower case, without port, credentials and a dot at its end; an IPv6 address keeps its brackets."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?(\[[^\]/]*\]|[^/:?#]+)", 1))
    return F.when(F.length(host) > 1, F.regexp_replace(host, r"\.$", "")).otherwise(host)


# What private IPv4 addresses begin with, and names and IPv6 addresses of private hosts.
PRIVATE_V4 = r"(?:0|10|127|192\.168|169\.254|172\.(?:1[6-9]|2[0-9]|3[01]))\."
PRIVATE_NAME = r"^(?:localhost|.*\.local|.*\.internal|.*\.localhost)$"
PRIVATE_V6 = rf"^\[(?:::1?|::ffff:{PRIVATE_V4}[0-9.]+|f[cd][0-9a-f]{{2}}:.*|fe[89ab][0-9a-f]:.*)\]$"


def is_private(host: Column) -> Column:
    """Whether a host is a local name or an address of a private range; a name that begins as such an address isn't."""
    return host.rlike(PRIVATE_NAME) | (host.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$") & host.rlike("^" + PRIVATE_V4)) | host.rlike(PRIVATE_V6)


def url_skip_code(url: Column) -> Column:
    """Why a URL isn't fetched: unsupported-scheme, has-credentials, private-host, or null."""
    host = host_of(url)
    private = is_private(host)
    return (
        F.when(~url.rlike(r"^(?i)https?://"), "unsupported-scheme").when(url.rlike(r"^[A-Za-z]+://[^/?#]*@"), "has-credentials").when(private, "private-host")
    )
