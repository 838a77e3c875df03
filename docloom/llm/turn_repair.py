"""Repair of the turn structure of conversations, with an audit of the edits: a cheapest list of edits by a persistent dynamic program.

A repaired conversation is empty or has the role initials s?(ua)+. Edits, in the order of the turns: K keeps a turn (0), R gives it the role user or assistant (1),
D deletes it (2; a must for blank turns and duplicates), I inserts an empty turn of user or assistant (5). A truncated turn that stays costs 5 more. Of
equally cheap audits the least one in ASCII order is taken.

The program walks the turns with the best audit for each of four states (nothing yet, last was system, user or assistant). Audits share their
beginnings as linked nodes; each node has the rolling hash of its whole audit and its ancestors 1, 2, 4 ... back. Ties are decided at the end of the longest
common beginning, which the hashes find over these ancestors; it is then compared node by node, so a collision of hashes changes nothing.

No task holds a conversation: turns are sorted in ranges and cut into blocks. Blocks of a conversation that spans several give a matrix of costs between
states; a scan over the later blocks tells each what the rest costs from each state, and a scan over the earlier ones in which state it begins. Inserts
before a turn belong to its block, so no block's audit is the beginning of another's and ties are decided inside blocks.

Nulls and edge cases: a null role or text reads as one space; conv_id may be null and is then a conversation of its own; null turns come first; turns that tie come by role,
then text; equal rows are one turn and its duplicates; an empty table gives no rows; a turn whose role begins with another letter than s, u or a
can be given a role or deleted; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, written

#: Turns and bytes of text in a block at most (one longer text is a block of its own).
BLOCK = 1024
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
NONE, SYSTEM, USER, ASSISTANT = range(4)
STATE_OF = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
DELETE, INSERT, REROLE, CUT = 2, 5, 1, 5
INSERTS = ((NONE, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER))
#: What ends a conversation from each state, and its cost.
CLOSING = ("", "II", "I", "")
END = tuple(INSERT * len(x) for x in CLOSING)
FAR = 1 << 40
BASE, MODULUS = 1_000_003, (1 << 61) - 1
GAPS = " \t\n\x0b\x0c\r"


def faults(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, fault (of the first of equal rows) and n (equal rows); of the n, all but the first are duplicates (blank: blank)."""
    space = F.lit(" ")
    each = (
        turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
        .groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    )
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    again = each.groupBy("conv_id", "role", "text").agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1")
    again = again.select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("text").alias("_t"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("text") == F.col("_t"))
    body = F.rtrim("text", F.lit(GAPS))
    fault = F.when(body == "", BLANK).when(F.col("first") < place, DUPLICATE).when(~F.substring(body, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(0)
    return each.join(again, same, "left").select("conv_id", "turn", "role", "text", fault.alias("fault"), "n")


BLOCKS = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int64()), ("seq", pa.int64()), ("alone", pa.bool_()), ("codes", pa.binary()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
    ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
])


def code(role: str, fault: int) -> int:
    """The state that a turn's role would lead to (0: none), and its fault, in one number."""
    return STATE_OF.get(role[:1], NONE) * 4 + fault


def legal(one: int, two: int) -> bool:
    return (one, two) in ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER))


def blocks(turns: DataFrame) -> DataFrame:
    """The turns in order, cut into blocks; alone tells that a block is a whole conversation for sure."""
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, conv, begun, sure, size, rows = TaskContext.get().partitionId(), 0, None, False, False, 0, []

        def block(alone: bool) -> pa.RecordBatch:
            codes = [code(r, f) for r, _, f in rows]
            count = [sum(f == k for _, _, f in rows) for k in (BLANK, DUPLICATE, TRUNCATED)]
            illegal = sum(not legal(a >> 2, b >> 2) for a, b in zip(codes, codes[1:]))
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([conv, part, seq, alone, bytes(codes), [r for r, _, _ in rows], [t for _, t, _ in rows], *count, illegal], BLOCKS)], schema=BLOCKS)

        for batch in batches:
            for c, role, text, fault, n in zip(*(x.to_pylist() for x in batch.columns)):
                if not begun or c != conv:
                    if rows:
                        yield block(sure)
                        seq += 1
                    sure = begun  # the first conversation of a range may have begun in the range before
                    conv, begun, size, rows = c, True, 0, []
                for k in range(n):
                    if rows and (len(rows) >= BLOCK or size + len(text) > SLICE_BYTES):
                        yield block(False)
                        seq, sure, size, rows = seq + 1, False, 0, []
                    rows.append((role, text, fault if not k or fault == BLANK else DUPLICATE))
                    size += len(text)
        if rows:
            yield block(False)

    dealt = faults(turns).repartitionByRange(*order).sortWithinPartitions(*order)
    return written(dealt.select("conv_id", "role", "text", "fault", "n").mapInArrow(cut, spark_schema(BLOCKS)), "turns")


def spark_schema(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.bool_(): "boolean", pa.binary(): "binary", pa.string(): "string", pa.list_(pa.string()): "array<string>", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def edits(state: int, turn: int) -> list[tuple[str, int, int]]:
    """Letter, cost and next state of what may be done with a turn of that code."""
    role, fault = divmod(turn, 4)
    found = [("D", DELETE, state)]
    if fault not in (BLANK, DUPLICATE):
        extra = CUT if fault == TRUNCATED else 0
        due = ASSISTANT if state == USER else USER
        if role == due or role == SYSTEM and state == NONE:
            found.append(("K", extra, role))
        found.append(("R", extra + REROLE, due))
    return found


def costs(codes: bytes) -> list[int]:
    """The cheapest cost from each state before a block to each state at its end, row by row."""
    out = []
    for entry in range(4):
        now = [FAR] * 4
        now[entry] = 0
        for turn in codes:
            for _ in range(3):
                for a, b in INSERTS:
                    now[b] = min(now[b], now[a] + INSERT)
            after = [FAR] * 4
            for state in range(4):
                if now[state] < FAR:
                    for _, cost, to in edits(state, turn):
                        after[to] = min(after[to], now[state] + cost)
            now = after
        out += now
    return out


class Audits:
    """Strings as linked nodes: parent, last letter, length, rolling hash and the ancestors 1, 2, 4 ... back. Node 0 is the empty one."""

    def __init__(self, base: int = BASE, modulus: int = MODULUS):
        self.base, self.modulus = base, modulus
        self.letter, self.depth, self.hash, self.up = [""], [0], [0], [[]]

    def add(self, parent: int, letter: str) -> int:
        up, k = [parent], 0
        while k < len(self.up[up[k]]):
            up.append(self.up[up[k]][k])
            k += 1
        self.letter.append(letter)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * self.base + ord(letter)) % self.modulus)
        self.up.append(up)
        return len(self.up) - 1

    def ancestor(self, node: int, depth: int) -> int:
        back, k = self.depth[node] - depth, 0
        while back:
            if back & 1:
                node = self.up[node][k]
            back, k = back >> 1, k + 1
        return node

    def less(self, a: int, b: int) -> bool:
        """Whether audit a comes before audit b."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self.ancestor(a, depth), self.ancestor(b, depth)
        differ = None
        if self.hash[x] != self.hash[y]:
            for k in reversed(range(len(self.up[x]))):  # to the first letters after the longest common beginning
                if k < len(self.up[x]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                    x, y = self.up[x][k], self.up[y][k]
            differ = self.letter[x], self.letter[y]
            x, y = self.up[x][0], self.up[y][0]
        while x != y:  # equal hashes are not yet equal beginnings
            if self.letter[x] != self.letter[y]:
                differ = self.letter[x], self.letter[y]
            x, y = self.up[x][0], self.up[y][0]
        return differ[0] < differ[1] if differ else self.depth[a] < self.depth[b]

    def text(self, node: int) -> str:
        found = []
        while node:
            found.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(found))


def solve(codes: bytes, entry: int, rest: list[int], audits: Audits | None = None) -> tuple[int, int, str]:
    """Last state, cost and audit of a block that begins in state entry, where what follows costs rest[state]."""
    audits = audits or Audits()
    now: dict[int, tuple[int, int]] = {entry: (0, 0)}

    def offer(best: dict[int, tuple[int, int]], state: int, cost: int, parent: int, letter: str) -> bool:
        if state in best and best[state][0] < cost:
            return False
        node = audits.add(parent, letter)
        if state in best and best[state][0] == cost and not audits.less(node, best[state][1]):
            return False
        best[state] = cost, node
        return True

    for turn in codes:
        changed = True
        while changed:
            changed = False
            for a, b in INSERTS:
                if a in now and (b not in now or now[a][0] + INSERT <= now[b][0]):
                    changed |= offer(now, b, now[a][0] + INSERT, now[a][1], "I")
        after: dict[int, tuple[int, int]] = {}
        for state, (cost, node) in now.items():
            for letter, more, to in edits(state, turn):
                offer(after, to, cost + more, node, letter)
        now = after
    best = None
    for state, (cost, node) in now.items():
        total = cost + rest[state]
        if best is None or total < best[0] or total == best[0] and audits.less(node, best[3]):
            best = total, state, cost, node
    return best[1], best[2], audits.text(best[3])


def _times(a: list[int], b: list[int]) -> list[int]:
    """What two neighbouring stretches of blocks cost together; beside the matrices, the role of the first turn."""
    return [min(FAR, min(a[4 * i + k] + b[4 * k + j] for k in range(4))) for i in range(4) for j in range(4)] + [a[16]]


def _after(a: list[int], b: list[int]) -> list[int]:
    return [b[k] for k in a]


def scanned(df: DataFrame, combine: Callable[[list[int], list[int]], list[int]], back: bool) -> DataFrame:
    """cid, part, seq and others: the values of all earlier blocks (back: later ones) of the conversation combined in order, null where there are none.

    First the blocks of a range, then the ranges of a conversation, so a group holds a range's blocks or one row for each range at most.
    """

    def ordered(pdf: pd.DataFrame, by: str) -> pd.DataFrame:
        return pdf.sort_values(by, ascending=not back)

    def joined(a, b):
        return b if a is None else a if b is None else combine(b, a) if back else combine(a, b)

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        now = None
        for v in ordered(pdf, "seq")["value"]:
            now = joined(now, [int(x) for x in v])
        return pd.DataFrame({"cid": [pdf["cid"].iloc[0]], "part": [pdf["part"].iloc[0]], "value": [now]})

    def before(pdf: pd.DataFrame, by: str, start) -> list:
        now, found = start, []
        for v in ordered(pdf, by)["value"]:
            found.append(now)
            now = joined(now, [int(x) for x in v])
        return found

    def over_ranges(pdf: pd.DataFrame) -> pd.DataFrame:
        return ordered(pdf, "part")[["cid", "part"]].assign(others=before(pdf, "part", None))

    def over_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
        start = pdf["others"].iloc[0]
        return ordered(pdf, "seq")[["cid", "part", "seq"]].assign(others=before(pdf, "seq", None if start is None else [int(x) for x in start]))

    ranges = df.groupBy("cid", "part").applyInPandas(total, "cid string, part long, value array<long>")
    bases = ranges.groupBy("cid").applyInPandas(over_ranges, "cid string, part long, others array<long>")
    return df.join(bases, ["cid", "part"]).groupBy("cid", "part").applyInPandas(over_blocks, "cid string, part long, seq long, others array<long>")


SOLVED = pa.schema([("cid", pa.string()), ("part", pa.int64()), ("seq", pa.int64()), ("states", pa.list_(pa.int64())), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])


class Repair:
    """The blocks of a table of turns and their audits, both written once; tables stay until the innermost scratch() ends."""

    def __init__(self, turns: DataFrame):
        cid = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
        self.blocks = blocks(turns).withColumn("cid", cid)
        spread = self.blocks.where("not alone")

        def matrices(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in parts:
                values = [[*costs(c), c[0] >> 2] for c in b.column("codes").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("cid", "part", "seq")), pa.array(values, pa.list_(pa.int64()))], names=["cid", "part", "seq", "value"])

        later = scanned(spread.select("cid", "part", "seq", "codes").mapInArrow(matrices, "cid string, part long, seq long, value array<long>"), _times, back=True)
        keys = ["cid", "part", "seq"]
        known = written(spread.select(*keys).join(later, keys, "left"), "later")

        def audits(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in parts:
                found = []
                for codes, alone, rest in zip(*(b.column(n).to_pylist() for n in ("codes", "alone", "others"))):
                    toll = [min(rest[4 * s + t] + END[t] for t in range(4)) for s in range(4)] if rest else END
                    found.append([solve(codes, entry, toll) for entry in range(1 if alone else 4)])
                columns = [pa.array([[x[i] for x in rows] for rows in found], SOLVED.field(n).type) for i, n in enumerate(("states", "costs", "audits"))]
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keys), *columns], schema=SOLVED)

        asked = self.blocks.select(*keys, "alone", "codes").join(known, keys, "left")
        solved = written(asked.mapInArrow(audits, spark_schema(SOLVED)), "audits")
        earlier = scanned(solved.join(spread.select(*keys), keys).select(*keys, F.col("states").alias("value")), _after, back=False)
        entry = F.coalesce(F.col("others")[0], F.lit(0)).cast("int")
        of = lambda c: F.get(c, F.col("entry")).alias(c[:-1])
        placed = solved.join(earlier, keys, "left").withColumn("entry", entry).select(*keys, "entry", of("states"), of("costs"), of("audits"))
        follows = known.select(*keys, F.col("others")[16].alias("next"))
        self.audits = written(placed.join(follows, keys, "left"), "audits")

    def conversations(self) -> DataFrame:
        """conv_id, blank, duplicate, truncated, illegal, cost, audit and closing (turns that are inserted at the end) of every conversation."""
        last = F.conv(F.hex(F.substring("codes", -1, 1)), 16, 10).cast("int").bitwiseAND(12) / 4  # the role of a block's last turn
        ok = F.when(F.col("next").isNull(), True).otherwise(((last == SYSTEM) & (F.col("next") == USER)) | ((last == USER) & (F.col("next") == ASSISTANT)) | ((last == ASSISTANT) & (F.col("next") == USER)))
        rows = self.blocks.drop("roles", "texts").join(self.audits, ["cid", "part", "seq"]).withColumn("illegal", F.col("illegal") + F.when(ok, 0).otherwise(1))
        sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
        found = rows.groupBy("cid").agg(F.first("conv_id").alias("conv_id"), *sums, F.array_sort(F.collect_list(F.struct("part", "seq", "audit"))).alias("pieces"), F.max(F.struct("part", "seq", "state")).alias("end"))
        closing = F.element_at(F.array(*map(F.lit, CLOSING)), (F.col("end.state") + 1).cast("int"))
        audit = F.concat(F.array_join(F.transform("pieces", lambda p: p["audit"]), ""), closing)
        return found.select("cid", "conv_id", "blank", "duplicate", "truncated", "illegal", (F.col("cost") + F.length(closing) * INSERT).alias("cost"), audit.alias("audit"), closing.alias("closing"))

    def turns(self) -> DataFrame:
        """cid, conv_id, part, seq, alone and kept: the repaired turns of each block, (edit, role, text) in order, without what closes a conversation."""

        def apply(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in parts:
                found = []
                for roles, texts, state, audit in zip(*(b.column(n).to_pylist() for n in ("roles", "texts", "entry", "audit"))):
                    at, kept = 0, []
                    for letter in audit:
                        role, text = (roles[at], texts[at]) if letter != "I" else ("", "")
                        at += letter != "I"
                        if letter == "D":
                            continue
                        if letter != "K":
                            role = "assistant" if state == USER else "user"
                        state = STATE_OF[role[0]]
                        kept.append({"edit": letter, "role": role, "text": text})
                    found.append(kept)
                kind = pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("cid", "conv_id", "part", "seq", "alone")), pa.array(found, kind)], names=["cid", "conv_id", "part", "seq", "alone", "kept"])

        rows = self.blocks.join(self.audits.select("cid", "part", "seq", "entry", "audit"), ["cid", "part", "seq"])
        return rows.select("cid", "conv_id", "part", "seq", "alone", "roles", "texts", "entry", "audit").mapInArrow(apply, "cid string, conv_id long, part long, seq long, alone boolean, kept array<struct<edit string, role string, text string>>")

    def digests(self) -> DataFrame:
        """cid and sha256 of the repaired role:text lines of every conversation.

        A digest takes the text in order, so a conversation of several blocks is read block by block from a sorted partition; memory stays that of a block.
        """
        pieces = self.turns().select("cid", "part", "seq", "alone", F.transform("kept", lambda t: F.concat(t["role"], F.lit(":"), t["text"])).alias("lines"))
        closed = self.conversations().select("cid", F.filter(F.split(F.when(F.col("closing") == "II", "user:\nassistant:").when(F.col("closing") == "I", "assistant:").otherwise(""), "\n"), lambda x: x != "").alias("closing"))
        named = pieces.join(closed, "cid").select("cid", "part", "seq", "alone", "lines", "closing")
        whole = named.where("alone").select("cid", F.sha2(F.array_join(F.concat("lines", "closing"), "\n"), 256).alias("sha256"))

        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cid, digest, some, closing = None, None, False, []

            def add(lines: list[str]) -> None:
                nonlocal some
                for x in lines:
                    digest.update((b"\n" if some else b"") + x.encode("utf-8", "surrogatepass"))
                    some = True

            def end() -> pa.RecordBatch:
                add(closing)
                return pa.RecordBatch.from_pydict({"cid": [cid], "sha256": [digest.hexdigest()]})

            for batch in batches:
                for c, lines, close in zip(*(x.to_pylist() for x in batch.columns)):
                    if c != cid:
                        if cid is not None:
                            yield end()
                        cid, digest, some, closing = c, hashlib.sha256(), False, close
                    add(lines)
            if cid is not None:
                yield end()

        spread = named.where("not alone").repartition("cid").sortWithinPartitions("cid", "part", "seq").select("cid", "lines", "closing")
        return whole.unionByName(spread.mapInArrow(stream, "cid string, sha256 string"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after the damage that the crc32 of conv_id:turn modulo 20 names: 0 drops, 1 empties, 2 strips stops, 3 repeats, 4 makes it the user's. Nulls read as one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    said = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text"))
    rows = conversations.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(text("role")).alias("role"), said.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("times"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("copy")).drop("copy")
