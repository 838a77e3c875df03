"""Turn repair against a program that carries whole audits, and that against all lists of edits."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from docloom.llm import queries, turn_repair

OUTSIDE = re.compile(r"[^\x20\x09-\x0D]")


def plain_damage(rows):
    out = []
    for c, t, role, text in rows:
        c_, t_, role, text = (" " if v is None else v for v in (c, t, role, text))
        k = zlib.crc32(f"{c_}:{t_}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        role = "user" if k == 4 else role
        out += [(c, t, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def plain_faults(rows):
    seen, found = set(), []
    for _, role, text in rows:
        signs = OUTSIDE.findall(text)
        found.append("blank" if not signs else "duplicate" if (role, text) in seen else "truncated" if signs[-1] not in ".!?" else "")
        seen.add((role, text))
    return found


def plain_best(rows, faults):
    """(cost, audit, repaired lines): for each state the least cost and audit, with the audit as a string."""
    now = {"": (0, "", ())}

    def insert(now):
        for _ in range(4):
            for a, b in (("", "u"), ("s", "u"), ("u", "a"), ("a", "u")):
                if a in now:
                    c = (now[a][0] + 5, now[a][1] + "I", now[a][2] + (("user:" if b == "u" else "assistant:"),))
                    now[b] = min(now.get(b, c), c)
        return now

    for (_, role, text), fault in zip(rows, faults):
        after = {}
        for state, (cost, audit, lines) in insert(now).items():
            options = [(state, (cost + 2, audit + "D", lines))]
            if fault not in ("blank", "duplicate"):
                more, due = 5 * (fault == "truncated"), "a" if state == "u" else "u"
                if role[:1] == due or role[:1] == "s" and state == "":
                    options.append((role[:1], (cost + more, audit + "K", lines + (f"{role}:{text}",))))
                options.append((due, (cost + more + 1, audit + "R", lines + (("user:" if due == "u" else "assistant:") + text,))))
            for s, o in options:
                after[s] = min(after.get(s, o), o)
        now = after
    now = insert(now)
    return min(now[s] for s in ("", "a") if s in now)


def plain(rows):
    """All columns of the query but conv_id, for one conversation's rows after damage."""
    rows = sorted(((t, role, text) for _, t, role, text in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults = plain_faults(rows)
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, lines = plain_best(rows, faults)
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest())


def row_of(r):
    return (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)


def expected(rows):
    left = plain_damage(rows)
    return {c: plain([r for r in left if r[0] == c]) for c in {r[0] for r in rows}}


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: row_of(r) for r in queries.op11_turn_repair(spark, sf_dir).collect()}
    assert got == expected(rows)


def made(seed, conversations=40):
    rng, rows = random.Random(seed), []
    for c in range(conversations):
        for t in range(rng.choice([0, 1, 3, 9, 60])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = rng.choice(["Fine.", "cut", "Why?", f"Turn {t}!", "", " \t", None, "No end é", "\n\nYes!\n"])
            for _ in range(rng.choice([1, 1, 1, 2, 3])):
                rows.append((None if c == 1 else c, rng.choice([t, t, t, None]), role, text))
    return rows


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_made_turns_in_blocks(spark, tmp_path, monkeypatch, block):
    """Blocks of one turn, of three and whole conversations give one result, over several ranges too."""
    monkeypatch.setattr(turn_repair, "BLOCK", block)
    rows = made(block)
    spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, audit string").repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: row_of(r) for r in queries.op11_turn_repair(spark, str(tmp_path)).collect()}
    assert got == expected(rows)


def test_one_conversation_over_all_ranges(spark):
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", f"{t}!", f"{t}?"])) for t in range(3000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges would be read as one
    try:
        repair = turn_repair.Repair(turns)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    (got,) = repair.conversations().join(repair.digests(), "cid").collect()
    assert repair.blocks.select("part").distinct().count() > 1
    assert (got.blank, got.duplicate, got.truncated, got.illegal, got.cost, got.audit, got.sha256) == plain(rows)[1:]


def test_no_rows(spark):
    repair = turn_repair.Repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert repair.conversations().count() == repair.digests().count() == 0


def test_against_all_lists_of_edits():
    rng = random.Random(11)
    for _ in range(300):
        rows = [(t, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["a.", "b", "", "c!"])) for t in range(rng.randint(0, 4))]
        faults = plain_faults(rows)
        best = (0, "") if not rows else None
        # Before each turn and at the end at most two inserts are of use; each turn is kept, given a role or deleted.
        for edits in product("DKR", repeat=len(rows)):
            for inserts in product(range(3), repeat=len(rows) + 1):
                cost, audit, roles, ok = 0, "", [], True
                for i in range(len(rows) + 1):
                    audit, cost = audit + "I" * inserts[i], cost + 5 * inserts[i]
                    roles += ["ua"] * inserts[i]
                    if i < len(rows):
                        audit += edits[i]
                        ok &= edits[i] == "D" or faults[i] not in ("blank", "duplicate")
                        cost += {"D": 2, "K": 0, "R": 1}[edits[i]] + 5 * (edits[i] != "D" and faults[i] == "truncated")
                        roles += [] if edits[i] == "D" else [rows[i][1][0]] if edits[i] == "K" else ["ua"]
                if ok and (best is None or (cost, audit) < best):
                    if any(re.fullmatch("(s?(ua)+)?", "".join(r)) for r in product(*roles)):
                        best = cost, audit
        assert plain_best(rows, faults)[:2] == best
        codes = bytes(turn_repair.code(role, ("", "blank", "duplicate", "truncated").index(f)) for (_, role, _), f in zip(rows, faults))
        state, cost, audit = turn_repair.solve(codes, turn_repair.NONE, list(turn_repair.END))
        assert (cost + turn_repair.END[state], audit + turn_repair.CLOSING[state]) == best


@pytest.mark.parametrize("modulus", [(1 << 61) - 1, 101, 3, 1])
def test_audits_compare_as_strings_even_where_all_hashes_collide(modulus):
    rng = random.Random(modulus)
    audits = turn_repair.Audits(modulus=modulus)
    texts, nodes = [""], [0]
    for _ in range(400):
        i = rng.randrange(len(nodes)) if rng.random() < 0.3 else len(nodes) - 1
        letter = rng.choice("DIKR" if rng.random() < 0.3 else "K")
        texts.append(texts[i] + letter)
        nodes.append(audits.add(nodes[i], letter))
    for _ in range(3000):
        i, j = rng.randrange(len(nodes)), rng.randrange(len(nodes))
        assert audits.less(nodes[i], nodes[j]) == (texts[i] < texts[j])
    assert all(audits.text(n) == t for n, t in zip(nodes, texts))
