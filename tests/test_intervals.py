"""Interval joins and acceptance against loops."""

import random

import pytest

from docloom.operators import intervals


def made(spark, seed, n=300, hot=0.5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lo = rng.randint(-50, 900)
        rows.append((i, None if i % 17 == 0 else "hot" if rng.random() < hot else rng.choice("abc"), lo, lo + rng.choice([0, 1, 1, 2, 3, 5, 8, 40, 300]), "x"))
    rows += [(n, "a", None, 5, "x"), (n + 1, "a", 5, None, "x"), (n + 2, "a", 9, 3, "x")]
    return rows, spark.createDataFrame(rows, "id long, k string, start long, stop long, cell string").repartition(5)


def meets(a, b):
    return a[1] == b[1] and None not in (*a[2:4], *b[2:4]) and a[2] < a[3] and b[2] < b[3] and a[2] < b[3] and b[2] < a[3]


def test_overlap_containment_and_clear_rows(spark):
    (a, left), (b, right) = made(spark, 1), made(spark, 2, 200)
    got = [(r.left.id, r.right.id) for r in intervals.overlapping(left, right, ["k"]).collect()]
    want = {(x[0], y[0]) for x in a for y in b if meets(x, y)}
    assert len(got) == len(set(got)) and {p for p in got} == want
    inside = {(r.left.id, r.right.id) for r in intervals.containing(left, right, ["k"]).collect()}
    of, by = {x[0]: x for x in a}, {y[0]: y for y in b}
    assert inside == {(i, j) for i, j in want if by[j][2] <= of[i][2] and of[i][3] <= by[j][3]}
    clear = {r.id for r in intervals.clear_of(left, right, ["k"], "id").collect()}
    assert clear == {x[0] for x in a} - {i for i, _ in want}
    plan = intervals.overlapping(left, right, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and plan.count("BroadcastNestedLoopJoin") <= 2  # only the one row of grids


@pytest.mark.parametrize("coalesce", ["true", "false"])  # the hot key lies in one range, or in several
def test_acceptance(spark, coalesce):
    rows, df = made(spark, 3, 400, 0.8)
    taken, upto = set(), {}
    for i, k, lo, hi, _ in sorted((r for r in rows if None not in r[2:4] and r[2] < r[3]), key=lambda r: (r[2], r[3], r[0])):
        if upto.get(k, lo) <= lo:
            taken.add(i)
            upto[k] = hi
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        got = [r.id for r in intervals.accepted(df, ["k"], "id").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(got) == sorted(taken)
    assert intervals.accepted(df.limit(0), ["k"], "id").count() == intervals.overlapping(df.limit(0), df, ["k"]).count() == 0


def test_small_keys_are_read_in_order_and_large_ones_in_ranges(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, "a", "b", "b", "b"]), i, lo, lo + rng.randint(0, 6)) for i in range(300) for lo in [rng.randint(0, 200)]]
    want, ends = [], {}
    for k, i, lo, hi in sorted(rows, key=lambda r: (r[2], r[3], r[1])):
        if lo < hi and lo >= ends.get(k, lo):
            ends[k] = hi
            want.append(i)
    df = spark.createDataFrame(rows, "k string, id long, start long, stop long")
    for hot in (0, 100, 1000):  # all keys are large, one is, none is
        assert sorted(r.id for r in intervals.accepted(df, ["k"], "id", hot=hot).collect()) == sorted(want)
    plan = intervals.accepted(df, ["k"], "id")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_counts_of_overlapping_intervals(spark, monkeypatch):
    rows, df = made(spark, 4)
    rows = [(r[0] % 280 if r[0] % 3 == 0 else r[0], *r[1:]) for r in rows]  # some ids come twice
    df = spark.createDataFrame(rows, df.schema).repartition(5)
    met = {i: [(x, y) for x in rows if x[0] == i for y in rows if y[0] != i and meets(x, y)] for i, *_ in rows}
    want = {(i, len(p), sum(y[2] <= x[2] and x[3] <= y[3] for x, y in p)) for i, p in met.items()}
    for hot in (1000, 100, 0):  # no key is joined, one is, all are
        assert {tuple(r) for r in intervals.overlap_counts(df, ["k"], "id", hot=hot).collect()} == want
    plan = intervals.overlap_counts(df, ["k"], "id")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert intervals.overlap_counts(df.limit(0), ["k"], "id").count() == 0
