"""Personal data by regular expressions, checksum validators and context, in DataFrame expressions alone.

Expressions propose spans; a validator (Luhn for cards, modulo 97 for IBANs, number ranges for the rest) confirms or drops each; words within
CONTEXT code points before a span raise its score. The base kinds (email, ip, card, phone) count once their validator holds; the added kinds
count from THRESHOLD on: iban (its checksum suffices), ssn and local_phone (which need a word of their context nearby), and secret (a long value
of letters and digits given to a name such as token or password).

Positions come from cutting the text at its matches: the lengths of what lies between and of the matches add up to offsets. A text is also cut into
pieces of PIECE code points once, and what stands at an offset is read from those, as a walk from the text's beginning for each span would take
quadratic time. Sums and maxima run in blocks, so time grows near linearly with the length of a text and the number of its matches. Java's expressions overflow the stack on repeated groups, so text is
first marked: one character stands for a separator between two digits, another for a dot between two label characters. The
expressions then need no repeated group, and begin only where a run begins, which keeps them linear in the length of a run.

Nulls and edge cases: a null text is read as empty; null ids, repeated rows and empty tables are no special cases; input columns
stay in the struct `row`. Nothing is shuffled and no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed

#: Code points before a span in which a context word counts, and what it adds to a score.
CONTEXT, BONUS, THRESHOLD = 40, 0.3, 0.7
#: Matches that are summed in one go, and code points of a piece of text.
BLOCK, PIECE = 128, 128

# Marks in prepared text, and the characters that take the place of any that stand there already.
SEP, DOT = "\x01", "\x02"

# Kinds in the order of the contract, then the added ones, with score before context and context words.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "local_phone", "secret")
BASE = KINDS[:4]
START_SCORE = {"email": 0.8, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.5, "local_phone": 0.5, "secret": 0.5}
WORDS = {
    "email": "mail|email|contact|kontakt|correo|courriel",
    "ip": "ip|host|server|address|adresse",
    "card": "card|visa|mastercard|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|telefon|fax",
    "iban": "iban|account|konto|compte|cuenta",
    "ssn": "ssn|social security",
    "local_phone": "phone|tel|call|mobile|telefon|fax",
    "secret": "token|secret|password|passwd|key|apikey|auth",
}
# The expressions, over prepared text. A lookbehind or \G keeps a match from beginning inside a run that was tried already.
PATTERN = {
    "email": rf"(?:\G|(?<![A-Za-z0-9._%+\-{DOT}]))[A-Za-z0-9._%+\-{DOT}]+@[A-Za-z0-9-]+{DOT}[A-Za-z0-9{DOT}-]+",
    "ip": rf"(?:\G|(?<![0-9]))[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": rf"[0-9][0-9{SEP}]+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)\b",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9+)(-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]{0,64}[0-9])[A-Za-z0-9_-]{20,128}(?![A-Za-z0-9_-])",
}


def prepared(text: Column, kind: str) -> Column:
    """The text as the expression of a kind reads it, of the same number of code points."""
    if kind == "card":
        return F.regexp_replace(F.translate(text, SEP, "?"), r"(?<=[0-9])[\x20-](?=[0-9])", SEP)
    if kind == "email":
        return F.regexp_replace(F.translate(text, DOT, "?"), r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", DOT)
    return text


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a right Luhn check digit."""
    last = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, last - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.transform(F.sequence(F.lit(0), last - 1), worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """Remainder of an IBAN modulo 97: blanks don't count, its first four characters go last, and letters count from 10 on."""
    bare = F.replace(iban, F.lit(" "))
    moved = F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4))

    def step(a: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step)


def valid(match: Column, kind: str) -> Column:
    """Whether a proposed match of a kind passes its validator."""
    n = F.length(digits_of(match))
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.coalesce(F.ltrim(p, F.lit("0")).rlike(r"^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"), F.lit(False)))
    if kind == "card":
        return F.when((n >= 14) & (n <= 19), luhn(digits_of(match))).otherwise(False)
    if kind == "phone":
        return (n >= 10) & (n <= 15)
    if kind == "iban":
        return mod97(match) == 1
    return F.lit(True)


def let(value: Column, body) -> Column:
    """body of a value that is computed once, however often body uses it, also inside its own lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, kind: str) -> Column:
    """The sum or the maximum of an array of integers up to each of them, by blocks and over blocks."""
    join = (lambda a, x: a + x) if kind == "sum" else F.greatest
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def blocks(all_: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int")), lambda b: F.slice(all_, b * BLOCK + 1, F.lit(BLOCK)))

    def step(a: Column, x: Column) -> Column:
        return F.struct(join(a["at"], x).alias("at"), F.concat(a["out"], F.array(join(a["at"], x))).alias("out"))

    def over(summed: Column) -> Column:
        bases = F.aggregate(F.transform(summed, lambda x: x["at"]), zero, step)["out"]
        return let(bases, lambda base: F.flatten(F.transform(summed, lambda x, i: F.when(i == 0, x["out"]).otherwise(F.transform(x["out"], lambda y: join(y, F.get(base, i - 1)))))))

    return let(F.transform(let(values, blocks), lambda b: F.aggregate(b, zero, step)), over)


def cut(text: Column) -> Column:
    """A text in pieces of PIECE code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), 0)


def between(cuts: Column, begin: Column, end: Column) -> Column:
    """What stands from begin to before end in a text that was cut."""
    first, last = F.floor(begin / PIECE).cast("int"), F.floor(end / PIECE).cast("int")
    head, tail = F.coalesce(F.get(cuts, first), F.lit("")), F.coalesce(F.get(cuts, last), F.lit(""))
    inner = F.when(last > first + 1, F.array_join(F.slice(cuts, first + 2, F.greatest(last - first - 1, F.lit(0))), "")).otherwise("")
    apart = F.concat(F.substring(head, begin % PIECE + 1, F.lit(PIECE)), inner, F.substring(tail, F.lit(1), end % PIECE))
    return F.when(first == last, F.substring(head, begin % PIECE + 1, end - begin)).otherwise(apart)


SPAN = "array<struct<start:int,kind_ix:int,end:int,kind:string,score:double>>"
#: A text without these has no match of the kind; the costly expressions then don't run.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "iban": "[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", "ssn": "[0-9]{3}-[0-9]{2}-", "local_phone": r"[0-9]{3}\)?[-. ][0-9]{3}", "secret": "[A-Za-z0-9_-]{20}"}


def spans_of(text: Column, cuts: Column, kind: str, digits: Column) -> Column:
    """Spans of a kind in order: leftmost, not overlapping, validated, scored and, for added kinds, above the threshold.

    cuts are the text's pieces; digits tells whether the text has any: a text without can only have kinds that need none.
    """
    none = F.array().cast(SPAN)

    def scored(x: Column) -> Column:
        near = F.lower(between(cuts, F.greatest(x["start"] - CONTEXT, F.lit(0)), x["start"])).rlike(rf"(?<![a-z])(?:{WORDS[kind]})(?![a-z])")
        return F.struct(
            x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind_ix"), (x["start"] + F.length(x["match"])).alias("end"), F.lit(kind).alias("kind"),
            F.when(near, F.least(F.lit(1.0), F.lit(START_SCORE[kind] + BONUS))).otherwise(F.lit(START_SCORE[kind])).alias("score"),
        )

    def placed(ready: Column, found: Column) -> Column:
        gaps = F.slice(F.split(ready, PATTERN[kind], -1), 1, F.size(found))

        def at_ends(ends: Column) -> Column:
            each = F.transform(found, lambda m, i: F.struct(m.alias("match"), (F.get(ends, i) - F.length(m)).alias("start")))
            spans = F.transform(F.filter(each, lambda x: valid(x["match"], kind)), scored)
            return spans if kind in BASE else F.filter(spans, lambda x: x["score"] >= THRESHOLD)

        return let(running(F.zip_with(gaps, found, lambda g, m: F.length(g) + F.length(m)), "sum"), at_ends)

    def proposed(ready: Column) -> Column:
        return let(F.regexp_extract_all(ready, F.lit(PATTERN[kind]), 0), lambda found: F.when(F.exists(found, lambda m: valid(m, kind)), placed(ready, found)).otherwise(none))

    may = F.contains(text, F.lit("@")) if kind == "email" else digits & text.rlike(NEEDS[kind])
    return F.when(may, let(prepared(text, kind), proposed)).otherwise(none)


def find(docs: DataFrame) -> DataFrame:
    """row, doc_id, text and spans (struct of start, kind_ix, end, kind, score; by start, then kind) of every row of docs; end is exclusive."""
    base = packed(docs).withColumn("text", F.coalesce("text", F.lit("")))
    base = base.withColumn("digits", F.col("text").rlike("[0-9]"))
    base = base.withColumn("cuts", F.when(F.col("digits") | F.contains("text", F.lit("@")), cut(F.col("text"))).otherwise(F.array().cast("array<string>")))
    each = base.select("*", *[spans_of(F.col("text"), F.col("cuts"), k, F.col("digits")).alias(f"of_{k}") for k in KINDS])
    return each.select("row", "doc_id", "text", F.array_sort(F.concat(*[F.col(f"of_{k}") for k in KINDS])).alias("spans"))


def described(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scores(spans: Column) -> Column:
    """The score of each span, with two digits, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.format_number(s["score"], 2)), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span, and each run of overlapping spans as one, replaced by the kind in angle brackets."""

    def joined(cuts: Column, reach: Column) -> Column:
        before = lambda i: F.when(i == 0, 0).otherwise(F.get(reach, i - 1))
        parts = F.transform(spans, lambda s, i: F.when(s["start"] >= before(i), F.concat(between(cuts, before(i), s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise(""))
        return F.concat(F.array_join(parts, ""), between(cuts, F.element_at(reach, -1), F.length(text)))

    whole = let(cut(text), lambda cuts: let(running(F.transform(spans, lambda s: s["end"]), "max"), lambda reach: joined(cuts, reach)))
    return F.when(F.size(spans) == 0, text).otherwise(whole)
