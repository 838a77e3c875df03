"""Chat formatting: a hidden Markov model recovers the roles of a transcript's lines, then turns are rendered in one canonical form.

States are a role and whether the line begins a turn or goes on with one. A line is observed through discrete features: its speaker marker, its
length, and how it begins and ends; where records begin isn't observed, as a record may hold part of a turn or several. A marker is evidence
only: a line inside a turn may begin with a name as well, and then keeps it when turns are rendered. Start, transition and emission probabilities are relative
frequencies, smoothed, over labelled transcripts, counted by Spark; what reaches the driver is a table of counts whose size
depends on the model alone.

Viterbi runs over a whole transcript, however long. Records are dealt into blocks of BLOCK positions at most; each block gives its max-plus matrix
(the best score from each state before it to each state at its end), matrices are combined FAN at a time in a tree over the transcript's blocks,
and the way back down the tree gives each block the state before it, from which it decodes its own lines. No transcript meets
in one task, and the result is that of one pass.

Records are rows (conv_id, turn, text). Equal ones (also in all that is observed) are merged and counted in n_copies. Nulls and edge cases: a null
conv_id or turn is a value of its own, and comes first; a null text is an empty line; records of one turn that differ are
ordered by hash, then by text; of paths with equal scores the one through the earlier states of STATES is taken; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, written

ROLES = ("system", "user", "assistant")
STATES = [(r, b) for r in ROLES for b in (True, False)]
BLOCK, FAN = 64, 64
SMOOTHING = 0.5

# Speaker names that transcripts use for each role.
NAMES = {"system": ("system", "instructions"), "user": ("user", "human", "customer", "question", "q"), "assistant": ("assistant", "bot", "ai", "agent", "answer", "a")}
_ROLE_OF = {n: r for r, names in NAMES.items() for n in names}
_MARKER = re.compile(r"^\s*(?:#{1,4}\s*|\*\*|\[|<)?\s*(" + "|".join(sorted(_ROLE_OF, key=len, reverse=True)) + r")\s*(?:\*\*|\]|>)?\s*(?::|-|$|(?<=[\]>])\s)\s*(?:\*\*)?\s*", re.IGNORECASE)
FEATURES = 4


def observe(line: str) -> tuple[tuple[str, ...], str]:
    """The features of a line and the line without its speaker marker."""
    m = _MARKER.match(line)
    rest = line[m.end() :] if m else line
    n = len(rest)
    head = rest.lstrip()[:1]
    return (
        "marker:" + (_ROLE_OF[m[1].lower()] if m else "none"), "empty" if not n else f"length:{min(n.bit_length(), 10)}",
        "upper" if head.isupper() else "lower" if head.islower() else "other", "asks" if rest.rstrip().endswith("?") else "ends" if rest.rstrip().endswith((".", "!")) else "open",
    ), rest


@dataclass
class Hmm:
    """Log probabilities: start[state], moves[from, to], emit[feature index][value] as a row over states."""

    start: np.ndarray
    moves: np.ndarray
    emit: list[dict[str, np.ndarray]]
    unseen: list[np.ndarray]

    def scores(self, seen: list[tuple[str, ...]]) -> np.ndarray:
        return np.array([sum(self.emit[k].get(v, self.unseen[k]) for k, v in enumerate(o)) for o in seen]).reshape(len(seen), len(STATES))


def lines_of(text: str | None) -> list[str]:
    return (text or "").split("\n")


def fit(labelled: DataFrame) -> Hmm:
    """Count over transcripts with a column role; roles other than those known are not learnt from."""
    keyed = labelled.where(F.col("role").isin(*ROLES)).select("conv_id", "turn", "role", "text")

    def count(parts):
        for pdf in parts:
            rows = []
            for role, text in zip(pdf["role"], pdf["text"]):
                before = None
                for i, line in enumerate(lines_of(text)):
                    state = STATES.index((role, i == 0))
                    rows += [(f"f{k}", v, state) for k, v in enumerate(observe(line)[0])]
                    if before is not None:
                        rows.append(("move", str(before), state))
                    before = state
                rows.append(("last", role, before))
            c = pd.DataFrame(rows, columns=["what", "value", "state"])
            yield c.groupby(["what", "value", "state"]).size().reset_index(name="n")

    counts = keyed.mapInPandas(count, "what string, value string, state int, n long").groupBy("what", "value", "state").agg(F.sum("n").alias("n")).collect()
    # Moves between turns, from pairs of neighbouring turns: an equality join on the next turn, as no window may hold a whole transcript.
    turns = keyed.groupBy("conv_id", "turn").agg(F.max("role").alias("role"), F.count("*").alias("n")).where("n = 1")
    follow = turns.join(turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next")), ["conv_id", "turn"]).groupBy("role", "next").count().collect()
    starts = turns.where("turn = 0").groupBy("role").count().collect()
    n = len(STATES)
    start, moves = np.full(n, 1e-3), np.full((n, n), 1e-3)
    emit: list[dict[str, np.ndarray]] = [{} for _ in range(FEATURES)]
    ends = {r.value: {} for r in counts if r.what == "last"}
    for r in counts:
        if r.what == "last":
            ends[r.value][r.state] = r.n
        elif r.what == "move":
            moves[int(r.value), r.state] += r.n
        else:
            emit[int(r.what[1:])].setdefault(r.value, np.full(n, SMOOTHING))[r.state] += r.n
    for r in starts:
        start[STATES.index((r.role, True))] += r["count"]
    for r in follow:  # a turn's last line is a first or a later one in the share counted for its role
        share, total = ends.get(r.role, {}), sum(ends.get(r.role, {}).values()) or 1
        for state, k in share.items():
            moves[state, STATES.index((r.next, True))] += r["count"] * k / total
    totals = [sum(e.values(), np.zeros(n)) + SMOOTHING for e in emit]
    return Hmm(np.log(start / start.sum()), np.log(moves / moves.sum(axis=1, keepdims=True)), [{v: np.log(c / t) for v, c in e.items()} for e, t in zip(emit, totals)], [np.log(SMOOTHING / t) for t in totals])


RECORD = ("turn", "h", "text", "n_copies")
LEAF = ["cid", "run", "at", "part"]


def _blocks(turns: DataFrame) -> DataFrame:
    """Blocks of distinct records in transcript order: a run of BLOCK turns, or, where a run holds over 4 * BLOCK, parts of a turn by hash.

    cid, run, at and part order and name the blocks without nulls; records is the block's array, bounded as said. Null turns are run 0 and
    the table's least turn lies in run 1, so no run is negative and all runs of a transcript meet at 0 in the tree.
    """
    run = F.floor(F.col("turn").cast("long") / BLOCK)
    least = turns.agg(F.min(run)).first()[0] or 0
    each = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("text", F.lit("")).alias("text"))
    each = each.groupBy("conv_id", "turn", "text").agg(F.count("*").alias("n_copies"))
    each = each.withColumns({"h": F.xxhash64("text"), "cid": F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), "run": F.coalesce(run - F.lit(least) + 1, F.lit(0)).cast("long")})
    crowd = each.groupBy("cid", "run").agg(F.count("*").alias("crowd")).where(F.col("crowd") > 4 * BLOCK)
    # A turn of a crowded run is cut by ranges of the hash, which keeps the order (turn, hash).
    parts = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("crowd") / BLOCK)))
    part = F.floor((F.col("h").cast("double") / F.lit(2.0**64) + 0.5) * parts).cast("long")
    zero = F.lit(0).cast("long")
    placed = each.join(crowd, ["cid", "run"], "left").withColumns({"at": F.when(F.col("crowd").isNull(), zero).otherwise(F.coalesce("turn", F.lit(-1))), "part": F.when(F.col("crowd").isNull(), zero).otherwise(part)})
    return placed.groupBy(*LEAF).agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(F.struct(*RECORD))).alias("records"))


def _observed(records: list[dict]) -> tuple[list[list[str]], list[tuple]]:
    split = [lines_of(r["text"]) for r in records]
    return split, [observe(line) for s in split for line in s]


def _step(v: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A vector of best scores (or a matrix of such) followed by a matrix of moves."""
    return (v[..., :, None] + m).max(axis=-2)


NODE = "m array<double>, v array<double>"


def _leaves(blocks: DataFrame, model: Hmm) -> DataFrame:
    """For each block its max-plus matrix m, and v, the best scores at its end if the transcript begins with it."""

    def run(batches):
        for b in batches:
            out = []
            for records in b.column(len(LEAF)).to_pylist():
                score = model.scores([o for o, _ in _observed(records)[1]])
                m, v = model.moves + score[0], model.start + score[0]
                for row in score[1:]:
                    m, v = _step(m, model.moves + row), _step(v, model.moves + row)
                out.append((m.ravel().tolist(), v.tolist()))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(LEAF)], pa.array([m for m, _ in out], pa.list_(pa.float64())), pa.array([v for _, v in out], pa.list_(pa.float64()))], names=[*LEAF, "m", "v"])

    return blocks.select(*LEAF, "records").mapInArrow(run, f"cid string, run long, at long, part long, {NODE}")


def _matrix(values: list[float]) -> np.ndarray:
    return np.array(values).reshape(len(STATES), len(STATES))


def _above(nodes: DataFrame) -> DataFrame:
    """Nodes whose key is up_run, up_at, up_part: each combines its children, at most FAN of them (or the turns of one run), in order."""
    up = nodes.groupBy("cid", "up_run", "up_at", "up_part").agg(F.sort_array(F.collect_list(F.struct("run", "at", "part", "m", "v"))).alias("children"))

    def run(batches):
        for b in batches:
            ms, vs = [], []
            for children in b.column(4).to_pylist():
                m, v = _matrix(children[0]["m"]), np.array(children[0]["v"])
                for c in children[1:]:
                    step = _matrix(c["m"])
                    m, v = _step(m, step), _step(v, step)
                ms.append(m.ravel().tolist())
                vs.append(v.tolist())
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(ms, pa.list_(pa.float64())), pa.array(vs, pa.list_(pa.float64()))], names=[*LEAF, "m", "v"])

    return up.mapInArrow(run, f"cid string, run long, at long, part long, {NODE}")


def _below(above: DataFrame, nodes: DataFrame) -> DataFrame:
    """States before (-1: none) and at the end of each node, from those of the nodes above; is_last marks the transcript's end."""
    kids = nodes.groupBy("cid", "up_run", "up_at", "up_part").agg(F.sort_array(F.collect_list(F.struct("run", "at", "part", "m", "v"))).alias("children"))
    known = above.select("cid", F.col("run").alias("up_run"), F.col("at").alias("up_at"), F.col("part").alias("up_part"), "into", "out", "is_last")
    joined = kids.join(known, ["cid", "up_run", "up_at", "up_part"]).select("cid", "children", "into", "out", "is_last")

    def run(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                kids_ = r["children"]
                best = np.array(kids_[0]["v"]) if r["into"] < 0 else _matrix(kids_[0]["m"])[r["into"]]
                back = []
                for c in kids_[1:]:
                    ways = best[:, None] + _matrix(c["m"])
                    back.append(ways.argmax(axis=0))
                    best = ways.max(axis=0)
                ends = [r["out"]]
                for k in reversed(back):
                    ends.append(int(k[ends[-1]]))
                ends.reverse()
                for i, c in enumerate(kids_):
                    rows.append((r["cid"], c["run"], c["at"], c["part"], r["into"] if i == 0 else ends[i - 1], ends[i], r["is_last"] and i == len(kids_) - 1))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
            columns = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[*LEAF, "into", "out", "is_last"])

    return joined.mapInArrow(run, "cid string, run long, at long, part long, into int, out int, is_last boolean")


def _entries(leaves: DataFrame) -> DataFrame:
    """For each block the states of the best path of its whole transcript before it and at its end."""
    levels, now = [], leaves
    zero = F.lit(0).cast("long")
    while True:
        top = now.agg(F.max("part"), F.min("at"), F.max("at"), F.count("*"), F.count_distinct("cid")).first()
        if top[0]:  # parts of crowded turns first
            keys = {"up_run": F.col("run"), "up_at": F.col("at"), "up_part": F.floor(F.col("part") / FAN).cast("long")}
        elif top[1] != top[2]:  # then the turns of crowded runs
            keys = {"up_run": F.col("run"), "up_at": zero, "up_part": zero}
        elif top[3] > top[4]:  # then runs
            keys = {"up_run": F.floor(F.col("run") / FAN).cast("long"), "up_at": zero, "up_part": zero}
        else:
            break
        level = written(now.withColumns(keys), "level")
        drop(now)
        levels.append(level)
        now = written(_above(level), "nodes")
    out = F.expr("cast(array_position(v, array_max(v)) - 1 as int)")
    states = now.select(*LEAF, F.lit(-1).alias("into"), out.alias("out"), F.lit(True).alias("is_last"))
    for level in reversed(levels):
        above, states = states, written(_below(states, level), "states")
        drop(above, level, now)
    return states


def parse(turns: DataFrame, model: Hmm) -> DataFrame:
    """conv_id, turn, role (of the record's first line), n_turns (turns that begin in it), n_lines, rendered and n_copies, a row for each distinct record.

    rendered is the record's part of the canonical transcript: <|role|> and a line feed before each turn, <|end|> and a line feed after it. A turn may go
    on into the next record, so the end of a turn is written before the next one begins, or after a transcript's last record.
    """
    blocks = written(_blocks(turns), "blocks")
    states = _entries(written(_leaves(blocks, model), "leaves"))
    fields = "conv_id long, turn long, role string, n_turns long, n_lines long, rendered string, n_copies long"
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()]

    def decode(batches):
        for b in batches:
            rows = [row for r in b.to_pylist() for row in _decoded(r, model)]
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in fields.split(", ")])

    return blocks.join(states, LEAF).select("conv_id", "records", "into", "out", "is_last").mapInArrow(decode, fields)


def _decoded(block: dict, model: Hmm):
    """The rows of one block, decoded between the states that the whole transcript's best path has at its ends."""
    split, seen = _observed(block["records"])
    into = block["into"]
    score = model.scores([o for o, _ in seen])
    best = (model.start if into < 0 else model.moves[into]) + score[0]
    back = []
    for row in score[1:]:
        ways = best[:, None] + model.moves
        back.append(ways.argmax(axis=0))
        best = ways.max(axis=0) + row
    states = [block["out"]]
    for k in reversed(back):
        states.append(int(k[states[-1]]))
    states.reverse()
    at = 0
    for i, (record, lines) in enumerate(zip(block["records"], split)):
        out, begun = [], 0
        for line, state, (features, rest) in zip(lines, states[at:], seen[at:]):
            role, begins = STATES[state]
            first = into < 0 and not at and not out
            if begins or first:
                out.append(("" if first else "<|end|>\n") + f"<|{role}|>\n")
                begun += 1
            kept = rest if begins or first else line
            if kept or features[0] == "marker:none":
                out.append(kept + "\n")
        if block["is_last"] and i == len(split) - 1:
            out.append("<|end|>\n")
        yield block["conv_id"], record["turn"], STATES[states[at]][0], begun, len(lines), "".join(out), record["n_copies"]
        at += len(lines)
