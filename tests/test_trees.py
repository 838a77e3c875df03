"""Version trees on made trees: cycles, missing parents, several roots, ties and nulls, each against a plain loop."""

import random

import pytest

from docloom.operators import trees

SCHEMA = "doc long, id long, parent long, at long, forward long, sha string, bytes long"


def forest(seed):
    rnd, rows = random.Random(seed), []
    for doc in range(12):
        ids = list(range(doc * 3 % 14))
        for i in ids:
            parent = rnd.choice([None if i == 0 else rnd.choice(ids), rnd.choice(ids), i // 2 if i else None, 99])
            rows.append((doc, i, parent if doc > 3 or i else None, rnd.randint(0, 6), rnd.choice([None, *ids]), rnd.choice([None, "x", f"s{i}"]), 10))
    return [(d, i, p, a, f, s, 7 if s == "x" else b) for d, i, p, a, f, s, b in rows]


def path(nodes, i):
    out = []
    while i in nodes and i not in out:
        out.append(i)
        i = nodes[i][2]
    return out


def by_doc(rows):
    docs = {}
    for r in rows:
        docs.setdefault(r[0], {})[r[1]] = r
    return docs


@pytest.fixture(scope="module", params=[1, 2])
def made(spark, request):
    rows = forest(request.param)
    return rows, spark.createDataFrame(rows + [(None, 1, None, 0, None, None, 0), (1, None, None, 0, None, None, 0)], SCHEMA)


def test_paths(made):
    rows, df = made
    want = {(d, i, a, k) for d, nodes in by_doc(rows).items() for i in nodes for k, a in enumerate(path(nodes, i))}
    assert {tuple(r) for r in trees.ancestors(df.unionByName(df)).select("doc", "id", "ancestor", "depth").collect()} == want
    assert trees.ancestors(df.limit(0)).count() == 0


def plain_redo(nodes, i):
    kids = sorted((r for r in nodes.values() if r[2] == i and r[5] is not None), key=lambda r: (r[3], r[1]))
    liked = [r for r in kids if r[1] == nodes[i][4]]
    return (liked or kids or [(None, None)])[-1][1]


def test_redo_and_history(made):
    rows, df = made
    df = df.selectExpr("*", "sha IS NOT NULL AS available")
    want = {(d, i): plain_redo(nodes, i) for d, nodes in by_doc(rows).items() for i in nodes}
    assert {(r.doc, r.id): r.redo for r in trees.redo_children(df).collect()} == {k: v for k, v in want.items() if v is not None}
    undo = {(d, i): r[2] in nodes and nodes[r[2]][5] is not None for d, nodes in by_doc(rows).items() for i, r in nodes.items()}
    assert {(r.doc, r.id): (r.can_undo, r.can_redo) for r in trees.history(df).collect()} == {k: (undo[k], want[k] is not None) for k in want}


def plain_lanes(nodes):
    parent = {i: (r[2] if r[2] in nodes and r[2] != i else None) for i, r in nodes.items()}
    age = lambda i: (nodes[i][3], i)
    kids = lambda i: sorted((c for c in nodes if parent[c] == i), key=age)
    reached = set()

    def reach(i):
        if i not in reached:
            reached.add(i)
            for c in kids(i):
                reach(c)

    for i in [i for i in nodes if parent[i] is None]:
        reach(i)
    for i in sorted(nodes, key=age):
        if i not in reached:
            parent[i] = None
            reach(i)
    out = {}

    def group(starts, level, under):
        place, all_lanes = 0, []
        for s in starts:
            lane = [s]
            while kids(lane[-1]):
                lane.append(kids(lane[-1])[0])
            all_lanes.append(lane)
        size = sum(map(len, all_lanes))
        for lane in all_lanes:
            for i in lane:
                place += 1
                out[i] = (level, lane[0], under, size, place)
                group(kids(i)[1:], level + 1, i)

    group(sorted((i for i in nodes if parent[i] is None), key=age), 1, None)
    return out


def test_lanes_with_cycles(made):
    rows, df = made
    want = {(d, i): v for d, nodes in by_doc(rows).items() for i, v in plain_lanes(nodes).items()}
    assert {(r.doc, r.id): (r.level, r.lane, r.branches_from, r.set_size, r.place) for r in trees.lanes(df).collect()} == want


def plain_prune(nodes, current, snapshots, most_bytes, most):
    age = lambda i: (nodes[i][3], i)
    roots = sorted((i for i in nodes if nodes[i][2] is None), key=age)
    keep = {*roots[:1], *path(nodes, current), plain_redo(nodes, current)}
    sha = {i: r[5] for i, r in nodes.items()}
    stored = lambda: sum({s: nodes[i][6] for i, s in sha.items() if s is not None}.values())
    actions = {}
    for i in sorted((i for i in nodes if sha[i] is not None and i not in keep), key=age):
        if sum(s is not None for s in sha.values()) <= snapshots and stored() <= most_bytes:
            break
        sha[i], actions[i] = None, "stub"
    left = set(nodes)
    while len(left) > most:
        leaves = [i for i in left if sha[i] is None and i not in keep and not any(nodes[c][2] == i for c in left)]
        if not leaves:
            break
        first = min(leaves, key=age)
        left.remove(first)
        actions[first] = "remove"
    return actions


@pytest.mark.parametrize("limits", [(2, 1000, 4), (60, 30, 6), (0, 0, 0)])
def test_pruning_against_a_loop(spark, made, limits):
    rows, df = made
    docs = by_doc(rows)
    currents = {d: max(nodes) for d, nodes in docs.items()}
    got = {(r.doc, r.id): r.action for r in trees.prune_plan(df, spark.createDataFrame(list(currents.items()), "doc long, id long"), *limits).collect()}
    assert got == {(d, i): a for d, nodes in docs.items() for i, a in plain_prune(nodes, currents[d], *limits).items()}


def test_tops(made):
    rows, df = made
    want = {}
    for d, nodes in by_doc(rows).items():
        for i in nodes:
            way = path(nodes, i)
            want[d, i] = (None, None) if nodes[way[-1]][2] in nodes else (way[-1], len(way) - 1)
    assert {(r.doc, r.id): (r.root, r.n_above) for r in trees.tops(df).collect()} == want


def test_a_chain_of_many_nodes_takes_rows_in_proportion(spark):
    n = 20_000
    df = spark.range(n).selectExpr("1L AS doc", "id", "CASE WHEN id > 0 THEN id - 1 END AS parent", "id AS at")
    assert trees.tops(df).selectExpr("max(n_above)", "min(root)", "max(root)", "count(*)").first() == (n - 1, 0, 0, n)
    assert trees.lanes(df).selectExpr("max(level)", "max(place)", "count(*)").first() == (1, n, n)
