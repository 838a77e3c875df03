"""Rules over texts, numbers, colours and times as column expressions: tokens of two kinds, syllables, slugs, names, secrets, sizes.

Nulls and edge cases: a null argument gives null (a null array for tokens); an empty text has no tokens and an empty slug.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Stop words of the catalog's tokens, and of retrieval's.
CATALOG_STOP = (
    "about above after again against all also am an and any are aren as at be because been before being below between both but by can cannot could did do does doing don "
    "down during each else etc few for from further get gets got had has have having he her here hers herself him himself his how however if in into is it its itself just let "
    "like made make many may me might more most much must my myself no nor not now of off on once only or other ought our ours ourselves out over own per same shall she should "
    "so some such than that the their theirs them themselves then there these they this those through thus to too under until up upon us use used using very via was we were "
    "what when where whether which while who whom whose why will with within without would yet you your yours yourself yourselves"
).split()
RETRIEVAL_STOP = (
    "a about above after again against all also am an and any are as at be because been before being below between both but by can could did do does doing down during each few "
    "for from further had has have having he her here hers him his how i if in into is it its itself just me more most my no nor not now of off on once only or other our ours "
    "out over own same she should so some such than that the their theirs them then there these they this those through to too under until up very was we were what when where "
    "which while who whom why will with would you your yours"
).split()
# Images, estimates, secrets.
LONG_EDGE, PIXELS_EACH, IMAGE_TOKENS = 1568, 750, 1600
SECRETS = {
    "private-key-block": (r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----", 0),
    "cloud-access-key-id": (r"\b(?:A3T[A-Z0-9]|AKIA|ASIA|ABIA|ACCA|AGPA|AIDA|AROA|AIPA|ANPA|ANVA)[A-Z0-9]{16}\b", 0),
    "llm-api-key": (r"\bsk-(?:ant-|proj-)[A-Za-z0-9_-]{20,}|\bsk-[A-Za-z0-9_-]{40,}", 0),
    "code-host-token": (r"\b(?:gh[pos]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{22,})", 0),
    "bearer-header": (r"(?i)\bAuthorization\s*:\s*Bearer\s+[A-Za-z0-9._~+/=-]{20,}", 0),
    "url-credentials": (r"(?i)\b[a-z][a-z0-9+.-]*://[^\s:@/'\"<>]+:[^\s@/'\"<>]+@[^\s/'\"<>]+", 0),
    "generic-high-entropy": (r"(?i)(?:secret|token|password|api[_-]?key)\s*[:=]\s*['\"]?([^\s'\"<>]{24,})", 1),
}
GENERIC_ENTROPY = 4.0
# Names of settings that hold secrets, shapes of keys, what is cut out of free text, and from where on a token is too random.
SECRET_NAME = "(?i)(api[-_]?key|secret|token|password|passwd|credential|private[-_]?key|client[-_]?secret|bearer)"
SECRET_SHAPES = (r"^sk-(ant-)?[A-Za-z0-9_-]{20,}", r"^gh[pousr]_[A-Za-z0-9]{30,}", "^github_pat_", r"^AKIA[0-9A-Z]{16}$", "^xox[abpr]-", "-----BEGIN [A-Z ]*PRIVATE KEY-----", r"^eyJ[\w-]+\.[\w-]+\.[\w-]+$")
REDACTED_SHAPES = (r"sk-(ant-)?[A-Za-z0-9_-]{20,}", r"gh[pousr]_[A-Za-z0-9]{30,}", "github_pat_[A-Za-z0-9_]+", "AKIA[0-9A-Z]{16}", "xox[abpr]-[A-Za-z0-9-]+", r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?(-----END [A-Z ]*PRIVATE KEY-----|\z)", r"eyJ[\w-]+\.[\w-]+\.[\w-]+")
TOKEN_LENGTH, TOKEN_ENTROPY = 32, 4.5
BLANK = r"\s\x0b\p{Z}\x{FEFF}"
CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}ー"


def _plain_letters() -> tuple[str, str]:
    """Every character of the first plane that compatibility decomposition turns into one character and marks, and that character."""
    pairs = []
    for c in map(chr, range(0xA0, min(0xFFFF, sys.maxunicode))):
        rest = [x for x in unicodedata.normalize("NFKD", c) if not unicodedata.category(x).startswith("M")]
        if len(rest) == 1 and rest[0] != c and not "가" <= c <= "힣":
            pairs.append((c, rest[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_MARKED, _PLAIN = _plain_letters()


def unmarked(text: Column) -> Column:
    """The text with letters in their plain form and without marks; a character that decomposes into several letters stays."""
    return F.regexp_replace(F.translate(text, _MARKED, _PLAIN), r"\p{M}+", "")


# The longest endings that the catalog's stems lose, if three characters are left, and what they get instead.
CATALOG_ENDINGS = (("^(.{2,})ies$", "$1y"), ("^(.{3,})(?:ing|ed|(?<=[sxz]|ch|sh)es|(?<!s|ie|[sxz]e|che|she)s)$", "$1"))
# What retrieval's stems replace in Latin words, one after the other.
RETRIEVAL_ENDINGS = ((r"^([a-z]{2,})ies$", "$1y"), (r"^([a-z]{2,}[a-rt-z])s$", "$1"), (r"^(?:([a-z]{3,})ing|([a-z]{4,})ed)$", "$1$2"))


def catalog_stem(word: Column) -> Column:
    """The word without its longest known ending, if enough is left."""
    for pattern, added in CATALOG_ENDINGS:
        word = F.regexp_replace(word, pattern, added)
    return word


def catalog_words(text: Column) -> Column:
    """Runs of letters and digits of two characters or more, in plain letters; each is made a term by catalog_term()."""
    return F.filter(F.split(unmarked(text), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 2)


def catalog_term(word: Column) -> Column:
    """A word in capitals in lower case as it is, others stemmed; null for a stop word."""
    low = F.lower(word)
    return F.when(word.rlike("^[A-Z0-9]*[A-Z][A-Z0-9]*$"), low).when(~low.isin(*CATALOG_STOP), catalog_stem(low))


def catalog_tokens(text: Column) -> Column:
    """The terms of a short text as one column; for whole tables, explode catalog_words() and take catalog_term() of a column, which Spark compiles."""
    return F.filter(F.transform(catalog_words(text), catalog_term), lambda t: t.isNotNull())


def retrieval_stem(word: Column) -> Column:
    for pattern, kept in RETRIEVAL_ENDINGS:
        word = F.regexp_replace(word, pattern, kept)
    return word


def retrieval_words(text: Column) -> Column:
    """Lower-case runs of CJK characters, and of other letters, digits and marks."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"[{CJK}]+|[[\p{{L}}\p{{N}}\p{{M}}]&&[^{CJK}]]+"), 0)


def retrieval_terms_of(run: Column, plain: Column) -> Column:
    """The terms of a run and its form without marks: neighbouring pairs of CJK characters, else its stem, or none for stop words and single letters."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: F.substr(run, i, F.lit(2)))
    good = ((F.length(plain) >= 2) | plain.rlike(r"^\p{N}+$")) & ~plain.isin(*RETRIEVAL_STOP)
    return F.when(run.rlike(f"^[{CJK}]"), pairs).when(good, F.array(retrieval_stem(plain))).otherwise(F.array().cast("array<string>"))


def retrieval_tokens(text: Column) -> Column:
    """The terms of a short text as one column; for whole tables use operators.retrieval.retrieval_counts()."""
    each = F.transform(retrieval_words(text), lambda w: F.struct(w.alias("run"), unmarked(w).alias("plain")))
    return F.flatten(F.transform(each, lambda w: retrieval_terms_of(w["run"], w["plain"])))


def stripped_markdown(text: Column) -> Column:
    """Links as their text, no code ticks, no bold or emphasis marks, white space as one blank. Each pattern begins with what is rare, as texts are scanned for it."""
    for pattern, to in ((r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"`([^`]*)`", "$1"), (r"\*\*(.+?)\*\*", "$1"), (r"__(.+?)__", "$1"), (r"[*_](?<![A-Za-z0-9_*].)([^*_\n]+)[*_](?=$|[^A-Za-z0-9_*])", "$1"), (r"\s(?:\s+|(?<! ))", " ")):
        text = F.regexp_replace(text, pattern, to)
    return F.trim(text)


def syllables(word: Column) -> Column:
    """Groups of vowels of an English word without its silent ending; one at least, for a word with letters."""
    low = F.regexp_replace(F.lower(word), "[^a-z]", "")
    bare = F.regexp_replace(F.regexp_replace(low, "(?:[^laeiouy]es|ed|[^laeiouy]e)$", ""), "^y", "")
    return F.when(low == "", 0).when(F.length(low) <= 3, 1).otherwise(F.greatest(F.lit(1), F.regexp_count(bare, F.lit("[aeiouy]{1,2}"))))


# Syllables of words of a to z: a short word, one without a vowel that counts, and else each group of vowels but a silent ending and a y at the beginning.
_SILENT = "(?:ed|(?<=[b-df-hj-km-np-tv-xz])es?)(?![a-z])"
_GROUP = f"(?!{_SILENT})[aeiouy]{{1,2}}+"
_SYLLABLE = rf"(?<![a-z])(?:[a-z]{{1,3}}+(?![a-z])|(?=[a-z]{{4}})y?+[b-df-hj-np-tv-xz]*+(?:{_SILENT}|(?![a-z])))|(?=[aeiouy])(?!(?<![a-z])y){_GROUP}"
HARD_SYLLABLES = 4
HARD_WORD = rf"(?<![a-z])(?=[a-z]{{7}})y?+(?:[b-df-hj-np-tv-xz]*+{_GROUP}){{{HARD_SYLLABLES}}}[a-z]*+"


def with_syllables(df: DataFrame, text: str) -> DataFrame:
    """df with n_syllables and n_hard (words of four or more) of a text whose words have one blank between: as syllables() of each word, by patterns over the whole text."""
    low = df.withColumn("low", F.regexp_replace(F.lower(text), "[^a-z ]+", ""))
    return low.withColumns({"n_syllables": F.regexp_count("low", F.lit(_SYLLABLE)).cast("long"), "n_hard": F.regexp_count("low", F.lit(HARD_WORD)).cast("long")}).drop("low")


def slug(text: Column, most: int = 60) -> Column:
    """Lower-case ASCII letters and digits with dashes between, cut at a dash where it is too long."""
    whole = F.regexp_replace(F.regexp_replace(F.replace(F.lower(unmarked(text)), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    head = F.substring(whole, 1, most)
    at_dash = F.when(F.substring(whole, most + 1, 1) == "-", head).when(head.contains("-"), F.regexp_replace(head, "-[^-]*$", "")).otherwise(head)
    return F.when(F.length(whole) <= most, whole).otherwise(F.regexp_replace(at_dash, "-+$", ""))


def safe_name(name: Column, most: int = 120) -> Column:
    """A file name without separators, control characters or leading dots, cut before its extension."""
    s = F.regexp_replace(F.trim(F.regexp_replace(name, r"[/\\\x00-\x1f\x7f]", "")), r"^\.+", "")
    ext = F.regexp_extract(s, r"(?i)\.[a-z0-9]{1,8}$", 0)
    return F.when(F.length(s) <= most, s).otherwise(F.concat(F.substr(s, F.lit(1), most - F.length(ext)), ext))


def snippet(text: Column, most: int = 80) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def escaped(text: Column) -> Column:
    """& < > for HTML, without control characters."""
    s = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    return F.replace(F.replace(F.replace(s, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def looks_like_markdown(text: Column) -> Column:
    """Whether two lines at least are headings or list items."""
    return F.size(F.filter(F.split(text, r"\r?\n"), lambda x: x.rlike(r"^\s{0,3}(?:#{1,6}\s+\S|[-*+]\s+\S|[0-9]{1,9}[.)]\s+\S)"))) >= 2


def entropy(text: Column) -> Column:
    """Bits per character, from the counts of the distinct characters of one text; an empty text has none."""
    n = F.length(text).cast("double")
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    chars = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    return F.when(n == 0, 0.0).otherwise(F.aggregate(chars, F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c))))


@F.pandas_udf(T.DoubleType())
def text_entropy(text: pd.Series) -> pd.Series:
    """As entropy(), for whole texts: one count of code points a text, in Arrow batches."""

    def bits(t: str | None) -> float | None:
        if t is None:
            return None
        n = np.bincount(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)) if t else np.zeros(0, np.int64)
        share = n[n > 0] / max(1, n.sum())
        return float(-(share * np.log2(share)).sum()) + 0.0

    return text.map(bits).astype(object)


def secrets(text: Column) -> Column:
    """Matches of the rules, as structs of rule and value; what the generic rule finds counts if it is random enough and part of no other match."""
    of = lambda rule: F.transform(F.regexp_extract_all(text, F.lit(SECRETS[rule][0]), SECRETS[rule][1]), lambda v: F.struct(F.lit(rule).alias("rule"), v.alias("value")))
    *special, generic = SECRETS
    sure = F.concat(*map(of, special))
    loose = F.filter(of(generic), lambda g: (entropy(g["value"]) > GENERIC_ENTROPY) & ~F.exists(sure, lambda s: F.contains(s["value"], g["value"]) | F.contains(g["value"], s["value"])))
    return F.concat(sure, loose)


def _too_random(token: Column) -> Column:
    return F.when(F.length(token) >= TOKEN_LENGTH, entropy(token) > TOKEN_ENTROPY).otherwise(False)


def looks_secret(value: Column) -> Column:
    """Whether a value has the shape of a key or is one random token; of a folder's path, whether one of its parts is."""
    shaped = lambda v: reduce(or_, [v.rlike(s) for s in SECRET_SHAPES])
    token = lambda v: ~v.rlike(f"[{BLANK}]") & _too_random(v)
    parts = F.when(value.rlike("^(/|~/)"), F.split(value, "/")).otherwise(F.array(value))
    return shaped(value) | F.exists(parts, lambda v: shaped(v) | token(v))


def redacted(text: Column) -> Column:
    """The text without keys of known shapes and without long random tokens."""
    for shape in REDACTED_SHAPES:
        text = F.regexp_replace(text, shape, "[REDACTED]")
    runs = F.regexp_extract_all(text, F.lit(f"[^{BLANK}]+|[{BLANK}]+"), 0)
    cleaned = F.array_join(F.transform(runs, lambda t: F.when(_too_random(t) & ~t.rlike(f"^[{BLANK}]"), F.lit("[REDACTED]")).otherwise(t)), "")
    return F.when(text.rlike(f"[^{BLANK}]{{{TOKEN_LENGTH}}}"), cleaned).otherwise(text)


def image_tokens(width: Column, height: Column) -> Column:
    scale = F.least(F.lit(1.0), F.lit(LONG_EDGE) / F.greatest(width, height))
    return F.when((width <= 0) | (height <= 0), IMAGE_TOKENS).otherwise(F.least(F.lit(IMAGE_TOKENS), F.ceil(width * scale * (height * scale) / PIXELS_EACH)))


def human_size(size: Column) -> Column:
    kb, mb = F.floor(size / 1024 + 0.5).cast("string"), F.format_string("%.1f", size / (1024 * 1024))
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1024 * 1024, F.concat(kb, F.lit(" KB"))).otherwise(F.concat(mb, F.lit(" MB")))


def guard_estimate(chars: Column) -> Column:
    """A third of the characters and a tenth more, rounded up at each step."""
    return F.ceil(F.ceil(chars / 3) * 11 / 10)


def luminance(r: Column, g: Column, b: Column) -> Column:
    """Relative luminance of channels from 0 to 1."""
    linear = lambda x: F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))
    return 0.2126 * linear(r) + 0.7152 * linear(g) + 0.0722 * linear(b)


def contrast(a: Column, b: Column) -> Column:
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)


def hue(r: Column, g: Column, b: Column) -> Column:
    top, d = F.greatest(r, g, b), F.greatest(r, g, b) - F.least(r, g, b)
    raw = F.when(d == 0, 0.0).when(top == r, (g - b) / d).when(top == g, (b - r) / d + 2).otherwise((r - g) / d + 4)
    return F.pmod(raw * 60, F.lit(360.0))


def compact_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd'T'HHmmss")


def relative_date(ts: Column, now: Column) -> Column:
    """now, minutes, hours, days or weeks back, then the date; the future counts as now."""
    s = F.greatest(F.lit(0), F.unix_seconds(now) - F.unix_seconds(ts))
    part = lambda n, unit: F.concat(F.floor(s / n).cast("string"), F.lit(unit))
    return F.when(s < 60, "now").when(s < 3600, part(60, "m")).when(s < 86400, part(3600, "h")).when(s < 7 * 86400, part(86400, "d")).when(s < 28 * 86400, part(7 * 86400, "w")).otherwise(F.date_format(ts, "yyyy-MM-dd"))


def uuid_of(hex32: Column) -> Column:
    """32 hexadecimal digits in the layout of a random UUID."""
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(hex32, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    cut = lambda a, n: F.substring(hex32, a, n)
    return F.concat(cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-4"), cut(14, 3), F.lit("-"), variant, cut(18, 3), F.lit("-"), cut(21, 12))


def nice_step(span: Column, parts: int) -> Column:
    """The least of 1, 2, 5 or 10 times a power of ten by which `parts` steps hold a span; a span that isn't positive has none."""
    raw = span / parts
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    return F.when(span > 0, F.when(raw <= power, power).when(raw <= 2 * power, 2 * power).when(raw <= 5 * power, 5 * power).otherwise(10 * power))
