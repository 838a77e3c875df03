"""Revisions of texts: words that two versions share in order, what the later one inserted, and which block of the later one revises which of the earlier one.

Words (with inner apostrophes, hyphens, points and separators) and single signs are tokens. Versions are aligned by a longest common subsequence, whatever their length: one bit for a
combination of two tokens, of which HELD bytes are held at once and the rest is worked out again. Tokens are cut by column expressions, two versions (or the blocks of two) meet in one row, and small
Arrow functions align them row by row: a task holds the tokens of one pair only, and no row is made for a token or for two blocks that share one.

Nulls and edge cases: a null text is an empty one; two empty texts are alike (1), an empty and another one not (0); a later text without a letter or digit has nothing inserted; one
without a common token is inserted whole; keys must be unique for each pair of versions, and a null key is a key; an empty table gives an empty result; columns are named in the
docstrings, others are left out. Offsets are in code points.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tokens, signs at the edges of an inserted run that don't count, what a run must hold, the least similarity of a revised block, bytes of an alignment that are held at once.
TOKEN = r"[\p{L}\p{N}]+(?:['’.,-][\p{L}\p{N}]+)*|[^\s\p{L}\p{N}]"
EDGE, WORDISH = r"^[,.;:!?…'\"“”‘’()\[\]—–-]$", r"[\p{L}\p{N}]"
LEAST = 0.35
HELD = 8 << 20
#: The combinations to which the reference limits an alignment. No query does; aligned() does if it is told to.
CELLS = 250_000


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?U){TOKEN}"), 0)


def aligned(old: list[str], new: list[str], cells: int | None = None) -> np.ndarray:
    """For each new token the old one that it continues, or -1. Of equally long alignments the one that leaves old tokens out first.

    If cells is given, more combinations than that between common beginning and end aren't looked at, and all new tokens there count as new.
    """
    number: dict[str, int] = {}
    return _aligned(*(np.array([number.setdefault(t, len(number)) for t in side], np.int64) for side in (old, new)), cells)


def _aligned(a: np.ndarray, b: np.ndarray, cells: int | None = None) -> np.ndarray:
    out = np.full(len(b), -1, np.int32)
    both = min(len(a), len(b))
    head = int(np.argmin(np.append(a[:both] == b[:both], False)))
    tail = int(np.argmin(np.append(a[::-1][: both - head] == b[::-1][: both - head], False)))
    out[:head] = np.arange(head)
    if tail:
        out[-tail:] = np.arange(len(a) - tail, len(a))
    at = np.arange(head, len(a) - tail)
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if cells is not None and len(a) * len(b) > cells:
        return out
    held = np.isin(a, b)  # old tokens that the new text hasn't are left out wherever they stand
    a, at = a[held], at[held]
    if len(a):
        for j, i in _shared(a, b):
            out[head + j] = at[i]
    return out


def _shared(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int]]:
    """Places in b and a of a longest common subsequence, in order.

    Let best(i, j) be how many tokens a[i:] and b[j:] share. For each j a number has a bit for each i, the last in the lowest place, which is not set where best(i, j) is more than
    best(i + 1, j): there the old token can't be left out. The number of j comes from that of j + 1 by an addition (Crochemore, Hyyrö).
    """
    n, tokens = len(a), b.tolist()
    full, most = (1 << n) - 1, max(1, 8 * HELD // n)  # numbers that are held at once
    places: dict[int, list[int]] = {}
    for place, token in enumerate(a[::-1].tolist()):
        places.setdefault(token, []).append(place)
    masks: dict[int, int] = {}

    def equal(token: int) -> int:
        """A bit for each place of the token in a."""
        if token not in masks:
            if len(masks) >= most:
                masks.clear()
            bits = bytearray(n // 8 + 1)
            for place in places.get(token, ()):
                bits[place >> 3] |= 1 << (place & 7)
            masks[token] = int.from_bytes(bits, "little")
        return masks[token]

    def before(j: int, number: int) -> int:
        same = number & equal(tokens[j])
        return ((number + same) | (number ^ same)) & full if same else number

    def rows(low: int, high: int, number: int) -> Iterator[tuple[int, int]]:
        """Each j from low to high with its number, given that of high; of more than are held, those at the ends of up to 64 pieces are kept, and the pieces are worked out again."""
        step = max(most, -(-(high - low) // 64)) if high - low > most and high - low > 64 else 1
        kept = []
        for j in range(high - 1, low - 1, -1):
            if step > 1 and (high - 1 - j) % step == 0:
                kept.append((j + 1, number))
            number = before(j, number)
            if step == 1:
                kept.append((j, number))
        for j, number in reversed(kept):
            if step == 1:
                yield j, number
            else:
                yield from rows(max(low, j - step), j, number)

    i, rest = 0, full  # rest: a bit for each place from i on
    for j, number in rows(0, len(tokens), full):
        same = equal(tokens[j]) & rest
        # the next old token that is equal, or that can't be left out
        left = rest & ~number | same
        if not left:
            return
        place = left.bit_length() - 1
        if same >> place:
            yield j, n - 1 - place
            place -= 1
        if n - 1 - place > i:
            i = n - 1 - place
            rest = (1 << (n - i)) - 1


def _by_row(df: DataFrame, compute: Callable[[dict], object], made: T.DataType, arrow: pa.DataType) -> DataFrame:
    """key of df and made, what compute makes of the other columns of a row; one row at a time is taken out of an Arrow batch, so what is held is one pair."""
    names = [c for c in df.columns if c != "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = {c: batch.column(batch.schema.get_field_index(c)) for c in names}
            found = pa.array((compute({c: _value(sides[c][i]) for c in names}) for i in range(batch.num_rows)), type=arrow)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("key")), found], names=["key", "made"])

    return df.mapInArrow(run, T.StructType([df.schema["key"], T.StructField("made", made)]))


def _value(held: pa.Scalar) -> object:
    """As Python has it, but lists of numbers or truths as arrays."""
    plain = held.is_valid and pa.types.is_list(held.type) and (pa.types.is_integer(held.type.value_type) or pa.types.is_boolean(held.type.value_type))
    return held.values.to_numpy(zero_copy_only=False) if plain else held.as_py()


def _joined(words: Column) -> Column:
    """Tokens as one text: none holds white space."""
    return F.array_join(words, " ")


def _split(words: str) -> list[str]:
    return words.split(" ") if words else []


def similarity(pairs: DataFrame) -> DataFrame:
    """key and similarity of pairs (key, old, new): the share of tokens, whatever their case, that both have in order."""
    cut = pairs.select("key", *[_joined(tokens(F.lower(side))).alias(side) for side in ("old", "new")])

    def dice(row: dict) -> float:
        old, new = _split(row["old"]), _split(row["new"])
        return _dice(len(old), len(new), int((aligned(old, new) >= 0).sum()))

    return _by_row(cut, dice, T.DoubleType(), pa.float64()).withColumnRenamed("made", "similarity")


def _dice(old: int, new: int, shared: int) -> float:
    return 2.0 * shared / (old + new) if old + new else 1.0


def _runs(row: dict, label: str) -> list[dict]:
    """The runs of one new text: tokens of one merge beside each other, without the signs at the edges of an inserted run; what has no letter or digit is no run."""
    old, new = _split(row["old"]), _split(row["new"])
    source = aligned(old, new)
    if not (source >= 0).any():
        return [{"merge": label, "start": 0, "stop": row["size"]}] if np.any(row["said"]) else []
    # The ranges are in order, and the first that holds a token counts.
    stop = np.cumsum(row["old_widths"])
    start, held = stop - [len(w) for w in old], np.full(len(old), -1)
    ranges = row["ranges"] or []
    for n in range(len(ranges) - 1, -1, -1):
        held[np.searchsorted(start, ranges[n]["start"]) : np.searchsorted(stop, ranges[n]["stop"], side="right")] = n
    number = {label: 0}  # of each merge; -1 is none
    merges = np.array([-1 if r["merge"] is None else number.setdefault(r["merge"], len(number)) for r in ranges] + [-1])
    of = np.where(source < 0, 0, merges[held[np.maximum(source, 0)]])
    stop = np.cumsum(row["new_widths"])
    start = stop - [len(w) for w in new]
    said, names = np.array(row["said"]), list(number)
    bounds = np.flatnonzero(np.diff(of, prepend=-2, append=-2))
    out = []
    for at, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if of[at] >= 0 and said[at:end].any():
            if of[at] == 0:
                while re.match(EDGE, new[at]):
                    at += 1
                while re.match(EDGE, new[end - 1]):
                    end -= 1
            out.append({"merge": names[of[at]], "start": int(start[at]), "stop": int(stop[end - 1])})
    return out


def insertions(pairs: DataFrame, label: str, ranges: DataFrame | Column | None = None) -> DataFrame:
    """key, merge, start and stop of the runs of the new text that the old one hasn't, marked with label, and of earlier ranges carried over tokens that stayed.

    pairs has key, old and new, ranges key, merge, start and stop in the old text (or it is a column of pairs, an array of structs of start, stop and merge); of ranges that hold a token the one of least start (then stop, then merge) counts.
    """
    kind = "array<struct<start: bigint, stop: bigint, merge: string>>"
    if ranges is None or isinstance(ranges, Column):
        valid = F.filter(F.lit(None).cast(kind) if ranges is None else ranges.cast(kind), lambda r: r["start"] < r["stop"])
        met = pairs.withColumn("ranges", F.sort_array(valid))
    else:
        each = F.struct(F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), F.col("merge").cast("string").alias("merge"))
        held = ranges.where("start < stop").groupBy(F.col("key").alias("of")).agg(F.sort_array(F.collect_list(each)).alias("ranges"))  # a key is one document
        met = pairs.join(held, F.col("key").eqNullSafe(F.col("of")), "left")
    # Pieces of white space and one token cover a text, so their lengths add up to offsets.
    widths = lambda side: F.transform(F.regexp_extract_all(F.coalesce(side, F.lit("")), F.lit(rf"(?U)\s*(?:{TOKEN})"), 0), F.length)
    new = tokens(F.col("new"))
    cut = met.select(
        "key", _joined(tokens(F.col("old"))).alias("old"), _joined(new).alias("new"), widths(F.col("old")).alias("old_widths"), widths(F.col("new")).alias("new_widths"),
        F.transform(new, lambda w: w.rlike(WORDISH)).alias("said"), F.coalesce(F.length("new"), F.lit(0)).alias("size"), "ranges",
    )
    made, arrow = T.StructType().add("merge", "string").add("start", "long").add("stop", "long"), pa.struct([("merge", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])
    return _by_row(cut, lambda row: _runs(row, label), T.ArrayType(made), pa.list_(arrow)).select("key", F.inline("made"))


def _origins(row: dict) -> list[dict]:
    """For each new block in order the old one that it takes: an equal one (the first), else the most similar one (the last of these) of those not taken.

    The tokens that both have bound a similarity from above, so blocks are aligned from the highest bound down, until none left can be better.
    """
    old, new = row["old"] or [], row["new"] or []
    number: dict[str, int] = {}
    cut = [[np.array([number.setdefault(t, len(number)) for t in _split(b["words"])], np.int64) for b in side] for side in (old, new)]
    counts = [Counter(w.tolist()) for w in cut[0]]
    having: dict[int, list[int]] = {}  # the old blocks that have a token
    for i, c in enumerate(counts):
        for t in c:
            having.setdefault(t, []).append(i)
    equal: dict[str, list[int]] = {}
    for i in range(len(old) - 1, -1, -1):
        if old[i]["text"] is not None:
            equal.setdefault(old[i]["text"], []).append(i)
    size = np.array([len(w) for w in cut[0]], np.int64)
    free, out = np.ones(len(old), bool), []
    for k, block in enumerate(new):
        same = equal.get(block["text"], [])
        while same and not free[same[-1]]:
            same.pop()
        best, at = LEAST, -1
        if same:
            best, at = 2.0, same[-1]
        elif len(cut[1][k]):
            most = np.zeros(len(old), np.int64)
            for t, n in Counter(cut[1][k].tolist()).items():
                for i in having.get(t, ()):
                    most[i] += min(n, counts[i][t])
            bound = 2.0 * most / np.maximum(1, size + len(cut[1][k]))
            near = np.flatnonzero(free & (bound >= LEAST))
            for i in near[np.lexsort((-near, -bound[near]))].tolist():
                if bound[i] < best:
                    break
                score = _dice(int(size[i]), len(cut[1][k]), int((_aligned(cut[0][i], cut[1][k]) >= 0).sum()))
                if score > best or (score == best and i > at):
                    best, at = score, i
        if at >= 0:
            free[at] = False
        out.append({"place": block["place"], "origin": "new" if at < 0 else "same" if best == 2 else "revised", "old_place": old[at]["place"] if at >= 0 else None, "similarity": min(best, 1.0) if at >= 0 else None})
    return out


def block_origins(old: DataFrame, new: DataFrame) -> DataFrame:
    """key, place, origin (same, revised or new), old_place and similarity of each block of new; both have key, place (from 0) and text.

    The blocks of a key are assigned in order: a key is one document, whose blocks come into one row. Blocks whose text is null equal none.
    """
    sides = F.col("side") == "old", F.col("side") == "new"
    each = old.select("key", F.lit("old").alias("side"), "place", "text").unionByName(new.select("key", F.lit("new").alias("side"), "place", "text"))
    blocks = each.groupBy("key").agg(*[F.sort_array(F.collect_list(F.when(s, F.struct("place", "text")))).alias(name) for s, name in zip(sides, ("old", "new"))])
    return _assigned(blocks)


def line_origins(pairs: DataFrame) -> DataFrame:
    """As block_origins(), for the lines of pairs (key, old, new) of texts."""
    lines = lambda text: F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("place"), x.alias("text")))
    return _assigned(pairs.select("key", lines("old").alias("old"), lines("new").alias("new")))


def _assigned(blocks: DataFrame) -> DataFrame:
    """Origins of key, old and new, arrays of structs of place and text in order."""
    words = lambda name: F.transform(name, lambda b: F.struct(b["place"].cast("int").alias("place"), b["text"].alias("text"), _joined(tokens(F.lower(b["text"]))).alias("words"))).alias(name)
    made = T.StructType().add("place", "integer").add("origin", "string").add("old_place", "integer").add("similarity", "double")
    arrow = pa.struct([("place", pa.int32()), ("origin", pa.string()), ("old_place", pa.int32()), ("similarity", pa.float64())])
    return _by_row(blocks.where(F.size("new") > 0).select("key", words("old"), words("new")), _origins, T.ArrayType(made), pa.list_(arrow)).select("key", F.inline("made"))
