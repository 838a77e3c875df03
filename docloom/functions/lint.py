"""Sentences and style rules of texts as column expressions, linear in a text's length.

Nulls and edge cases: a null text has null sentences; an empty one none.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import HARD_SYLLABLES as LONG_WORD
from .rules import HARD_WORD, stripped_markdown
from .text import two_instructions, word_count

# Abbreviations that don't end a sentence, words that begin one, forms of "be", words that only look like participles, and everyday long words.
ABBREVIATIONS = "e.g i.e etc vs cf mr mrs ms dr prof st fig approx inc ltd co corp jr sr u.s u.k a.m p.m".split()
STARTERS = "a an and as at but for he i if in it its no now on our she so that the then there these they this those we when yes you".split()
BE = "is|are|was|were|be|been|being"
NOT_PARTICIPLES = "often even then when open seven eleven ten men women children garden kitchen golden sudden green token need speed red bed hundred indeed seed limited fixed related skewed hidden broken".split()
EVERYDAY = (
    "actually everybody everything information understanding usually especially probably definitely immediately automatically unfortunately necessary ordinary material materials "
    "america american experience experiences television computer computers community activity activities electricity everyday interesting comfortable available situation situations "
    "education organization organizations conversation conversations opportunity temperature vegetable vegetables calculator difference differences already together similarity "
    "variety particular particularly"
).split()
SYMBOLS = "[=^σμΣ∑≈≤≥λθβ]"
# Limits in words.
PROCEDURAL_WORDS, DESCRIPTIVE_WORDS, PLAIN_WORDS, PLAIN_AVERAGE = 20, 25, 20, 15
ORDERED = r"^\s*[0-9]{1,3}[.)]\s+\S"
# A line feed between pieces of one sentence: "No." before a digit, an initial before a word that begins no sentence, an abbreviation.
_OPENS = r"""["'“‘(\[]*+"""
_RUNS_ON = (
    rf"\n(?:(?<=(?<![A-Za-z.])[Nn][Oo]\.\n)(?=[0-9])|(?<=(?<![A-Za-z.])[A-Za-z]\.\n)(?={_OPENS}[A-Za-z])(?!{_OPENS}(?i:{'|'.join(STARTERS)})(?![A-Za-z]))"
    rf"|(?<=(?<![A-Za-z.])(?i:{'|'.join(re.escape(a) for a in ABBREVIATIONS)})\.\n))"
)
#: A word that may have LONG_WORD syllables: as many groups of vowels have so many characters at least.
_MAY_BE_LONG = rf"\S(?<!\S\S)\S{{{2 * LONG_WORD - 2},}}+"


def lint_sentences(text: Column) -> Column:
    """Sentences of a text without Markdown: they end at . ! or ? before a capital, a digit or a quote, but not after an abbreviation or an initial.

    A line feed is put at each end; whether a piece runs on depends on its last word and the next piece's first one, which patterns see around the line feed.
    """
    joined = F.regexp_replace(stripped_markdown(text), r"""([.!?]["'"”’)\]]*)\s+(?=["'“‘(\[]?[A-Z0-9])""", "$1\n")
    joined = F.regexp_replace(joined, _RUNS_ON, " ")
    return F.filter(F.transform(F.split(joined, "\n"), lambda s: F.trim(s)), lambda s: s != "")


def is_passive(sentence: Column) -> Column:
    """Whether a form of "be" stands before a word in -ed or -en that isn't one of those that only look like participles."""
    return sentence.rlike(rf"(?i)(?:{BE})(?<![A-Za-z0-9_](?:{BE}))\s+(?!(?:{'|'.join(NOT_PARTICIPLES)})(?![A-Za-z0-9_]))[A-Za-z]+(?<=[A-Za-z]e[dn])(?![A-Za-z0-9_])")


def steps(text: Column) -> Column:
    """Lines of a text as structs of line (without its number) and procedural (whether it had one)."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"\S"))
    return F.transform(lines, lambda x: F.struct(F.regexp_replace(x, r"^\s*(?:[0-9]{1,3}[.)]|[-*•])\s+(?=\S)", "").alias("line"), x.rlike(ORDERED).alias("procedural")))


def style_of(text: Column) -> Column:
    """One struct for each sentence of each line: long, two, passive (all that was found) and fails (passives fail in steps only)."""

    def of(step: Column) -> Column:
        def judge(s: Column) -> Column:
            long = word_count(s) > F.when(step["procedural"], PROCEDURAL_WORDS).otherwise(DESCRIPTIVE_WORDS)
            two, passive = step["procedural"] & two_instructions(s), is_passive(s)
            return F.struct(long.alias("long"), two.alias("two"), passive.alias("passive"), (long | two | (passive & step["procedural"])).alias("fails"))

        return F.transform(lint_sentences(step["line"]), judge)

    return F.flatten(F.transform(steps(text), of))


def long_words(sentence: Column) -> Column:
    """Words of four syllables or more, as bare lower-case letters, but for everyday ones and those with a hyphen."""
    words = F.regexp_extract_all(sentence, F.lit(_MAY_BE_LONG), 0)
    bare = F.transform(words, lambda w: F.regexp_replace(F.lower(w), "[^a-z-]", ""))
    return F.filter(bare, lambda w: ~w.contains("-") & w.rlike(HARD_WORD) & ~w.isin(*EVERYDAY))


def plain_language_of(text: Column) -> Column:
    """One struct for each section (text between blank lines): n_sentences, n_words, n_long, long_words (each once) and symbol."""

    def of(section: Column) -> Column:
        sentences = F.flatten(F.transform(steps(section), lambda s: lint_sentences(s["line"])))
        each = F.transform(sentences, lambda s: F.struct(word_count(s).alias("n"), long_words(s).alias("w")))
        return F.struct(each.alias("s"), F.when(section.rlike(SYMBOLS), stripped_markdown(section).rlike(SYMBOLS)).otherwise(False).alias("symbol"))

    def add(each: Column) -> Column:
        n = F.aggregate(each["s"], F.lit(0), lambda a, s: a + s["n"])
        words = F.array_distinct(F.flatten(F.transform(each["s"], lambda s: s["w"])))
        return F.struct(F.size(each["s"]).alias("n_sentences"), n.alias("n_words"), F.size(F.filter(each["s"], lambda s: s["n"] > PLAIN_WORDS)).alias("n_long"), words.alias("long_words"), each["symbol"].alias("symbol"))

    sections = F.filter(F.split(text, r"\n[^\S\n]*\n"), lambda b: b.rlike(r"\S"))
    return F.transform(F.transform(sections, of), add)
