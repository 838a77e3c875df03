"""Substring joins, budgets, lanes and host keys against loops."""

import random

import pytest

from docloom.operators import budgets, substrings, suffixes


def test_substrings(spark):
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abé 中") for _ in range(n))
    texts = [(i, text(rng.randint(0, 60))) for i in range(200)] + [(200, None), (None, "abba abé"), (202, "")]
    terms = [text(n) for n in (1, 1, 2, 2, 3, 3, 4, 5, 5, 6, 9) for _ in range(8)] + ["", None, "zz", "abéabéabéa"]
    got = {(r.key, r.term) for r in substrings.containing(spark.createDataFrame(texts, "key long, text string"), spark.createDataFrame([(t, 1) for t in terms], "term string, gram int")).collect()}
    assert got == {(k, t) for k, x in texts for t in terms if x and t and t in x}
    empty = spark.createDataFrame([], "term string")
    assert substrings.containing(spark.createDataFrame(texts, "key long, text string"), empty).count() == 0
    for held in (0, 10**6):  # through the index and inside the tasks
        got = {(r.key, r.term) for r in substrings.containing(spark.createDataFrame(texts, "key long, text string"), spark.createDataFrame([(t,) for t in terms], "term string"), held).collect()}
        assert got == {(k, t) for k, x in texts for t in terms if x and t and t in x}
    # no row is made for a gram
    plan = substrings.containing(spark.createDataFrame(texts, "key long, text string"), spark.createDataFrame([(t,) for t in terms], "term string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan and "Join" not in plan


def test_mentions_and_what_is_not_mentioned(spark):
    texts = spark.createDataFrame([(1, "The  Neural\nnet was big"), (2, "networks, plural"), (3, None)], "key long, text string")
    terms = spark.createDataFrame([("neural nets",), ("Networks",), ("was  big",), ("absent",), (None,), (" ",)], "term string")
    assert {(r.key, r.term) for r in substrings.mentions(texts, terms).collect()} == {(1, "neural nets"), (2, "Networks"), (1, "was  big")}
    assert [r.term for r in substrings.unmentioned(texts, terms).collect()] == ["absent"]
    plan = substrings.unmentioned(texts, terms)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("announced", [0, 2, 50])
def test_budget_is_that_of_a_loop(spark, announced):
    rng = random.Random(announced)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice(["request", "request", "priority", "release"]), rng.choice([None, 1, 5, 9, 30, 90]), announced) for i in range(600)]
    want, state = {}, {}
    for job, place, kind, size, _ in rows:
        s = state.setdefault(job, [0, 0, announced])
        size = size or 0
        if kind == "release":
            s[0], s[1], fits = max(0, s[0] - 1), max(0, s[1] - size), None
        else:
            hold = 0 if kind == "priority" else s[2]
            fits = s[0] + hold + 1 <= 12 and s[1] + hold * 7 + size <= 200
            if fits:
                s[0], s[1] = s[0] + 1, s[1] + size
                s[2] -= kind == "priority" and s[2] > 0
        want[job, place] = (fits, s[0], s[1])
    df = spark.createDataFrame(rows, "job string, place long, kind string, bytes long, announced int").repartition(7)
    got = {(r.job, r.place): (r.admitted, r.used, r.used_bytes) for r in budgets.admitted(df, 12, 200, 7).collect()}
    assert got == want
    assert {f for f, *_ in want.values()} == ({True, False, None} if announced < 50 else {True, False, None})
    assert budgets.admitted(df.limit(0), 1, 1).count() == 0


def test_queue_positions(spark):
    rng = random.Random(9)
    waiting = [(i, rng.choice("xyz"), rng.randint(0, 20)) for i in range(60)]
    lanes = {"x": (0, 3), "y": (2, 3), "z": (5, 3)}
    want = {}
    for lane, (running, slots) in lanes.items():
        for n, (i, _, _) in enumerate(sorted((r for r in waiting if r[1] == lane), key=lambda r: (r[2], r[0]))):
            want[i] = 0 if n < slots - running else n + max(1, running - slots + 1)
    got = budgets.queue_positions(spark.createDataFrame(waiting, "id long, lane string, at long"), spark.createDataFrame([(k, *v) for k, v in lanes.items()], "lane string, running int, slots int"))
    assert {r.id: r.position for r in got.collect()} == want


def test_host_keys(spark):
    rules = spark.createDataFrame([(r,) for r in ("com", "uk", "co.uk", "*.ck", "!www.ck", "blogs.com", "co.uk")], "rule string")
    want = {
        "a.b.example.com": "example.com", "example.com": "example.com", "com": "com", "x.y.co.uk": "y.co.uk", "y.uk": "y.uk", "a.b.c.ck": "b.c.ck", "c.ck": "c.ck", "www.ck": "www.ck", "a.www.ck": "www.ck",
        "me.blogs.com": "me.blogs.com", "x.me.blogs.com": "me.blogs.com", "blogs.com": "blogs.com", "10.0.0.1": "10.0.0.1", "[::1]": "[::1]", "host": "host", "a.b.unknown": "b.unknown", None: None,
    }
    hosts = spark.createDataFrame([(h, 1) for h in [*want, "example.com"]], "host string, i int")
    got = suffixes.host_keys(hosts, rules).collect()
    assert len(got) == len(want) + 1 and {r.host: r.host_key for r in got} == want
    assert {r.host: r.host_key for r in suffixes.host_keys(hosts, rules.limit(0)).collect()}["a.b.example.com"] == "example.com"
    with pytest.raises(ValueError):
        suffixes.host_keys(hosts.withColumnRenamed("i", "host_key"), rules)
