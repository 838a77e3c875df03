"""Operators that keep sets of rows in step, on rows made for them."""

from docloom.operators import sync


def rows(spark, schema, *values):
    return spark.createDataFrame(list(values), schema)


def test_merged_catalog(spark):
    local = rows(spark, "key string, sha string, pinned boolean, unread boolean", ("a", "1", True, False), ("b", "1", False, False), ("c", None, True, True), (None, "1", True, True))
    remote = rows(spark, "key string, sha string, replaces string", ("a", "1", None), ("b", "2", None), ("d", "1", "c"), ("e", "1", None), (None, "1", None))
    got = {r.key: (r.action, r.sha, r.pinned, r.unread) for r in sync.merged_catalog(local, remote).collect()}
    assert got == {"a": ("same", "1", True, False), "b": ("update", "2", False, True), "c": ("delete", None, True, True), "d": ("insert", "1", True, True), "e": ("insert", "1", False, True)}
    assert sync.merged_catalog(local.limit(0), remote.limit(0)).count() == 0
    # rows that replace none don't meet in the join on replaces, where they would all be one key
    plan = sync.merged_catalog(local, remote)._jdf.queryExecution().optimizedPlan().toString()
    assert [x for x in ("FullOuter", "LeftOuter") if x in plan] == ["FullOuter", "LeftOuter"] and plan.index("FullOuter") < plan.index("LeftOuter") and "isnotnull(replaces" in plan


def test_newest_accepted(spark):
    updates = rows(spark, "key string, n long, id long", ("a", 1, 1), ("a", 3, 2), ("b", None, 3), ("b", 9, 4), ("c", 2, 5), (None, 1, 6), ("a", 3, 2))
    seen = rows(spark, "key string, n long", ("a", 2), ("b", 9), ("c", 2), ("c", 1))
    assert {(r.key, r.n, r.id) for r in sync.newest_accepted(updates, seen).collect()} == {("a", 3, 2), ("b", None, 3)}


def test_roles(spark):
    claims = rows(spark, "account string, device string, ms long, file string", ("x", "me", 900, "1"), ("x", "old", 500, "2"), ("x", "far", 400, "3"), ("x", "me", 100, "4"), ("y", "me", 5, "5"), ("z", "me", 900, "6"), ("z", "lost", 890, "7"), (None, "me", 1, "8"))
    devices = rows(spark, "device string, role string, seen long", ("old", "mirror", 999), ("far", "primary", 995), ("far", "mirror", 1))
    got = {(r.account, r.device): (r.role, r.waits_for) for r in sync.roles(claims, devices, 1000, 50).collect()}
    assert got == {("x", "me"): ("waiting", "far"), ("x", "old"): ("mirror", None), ("x", "far"): ("mirror", None), ("y", "me"): ("primary", None), ("z", "me"): ("primary", None), ("z", "lost"): ("mirror", None)}
    assert sync.roles(claims, devices, 10_000, 50).where("role = 'waiting'").count() == 0


def test_collection(spark):
    now = 100 * sync.DAY
    terminal = rows(spark, "job string, at long", ("a", now), ("b", now), ("c", now - 31 * sync.DAY), ("d", now))
    senders, acks = rows(spark, "job string, device string", ("a", "p"), ("b", "p")), rows(spark, "device string, job string", ("p", "a"), ("q", "b"), ("q", "d"))
    done = sync.done_jobs(terminal, senders, acks, now)
    assert sorted(r.job for r in done.collect()) == ["a", "c", "d"]
    files = rows(
        spark, "file string, kind string, device string, ref string, at long", ("f1", "job", "p", "a", 0), ("f2", "job", "p", "b", 0), ("f3", "att", "p", "s1", now), ("f4", "att", "p", "s2", now), ("f5", "att", "p", "s3", 0),
        ("f6", "acks", "q", None, 0), ("f7", "claim", "p", None, 5), ("f8", "claim", "q", None, 6), ("f9", "att", "p", None, 0),
    )
    uses = rows(spark, "job string, sha string", ("a", "s1"), ("a", "s2"), ("b", "s2"))
    got = {r.file: r.reason for r in sync.collection(files, done, uses, rows(spark, "device string", ("q",)), now).collect()}
    assert got == {"f1": "job-done", "f3": "job-done", "f5": "orphan-att", "f6": "phone-silent", "f7": "old-claim"}


def test_acknowledged(spark):
    jobs = rows(spark, "device string, id long, at long", ("p", 1, 1), ("p", 2, 1), ("p", 3, 0), (None, 4, 1))
    a, b = sync.acknowledged(jobs, 2).collect(), sync.acknowledged(jobs.where("id <> 3"), 2).collect()
    assert a == b and a[0].n == 2
