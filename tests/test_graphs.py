"""Chains, cycles, frontiers and ready sets."""

import random

from worklens.operators import graphs


def pairs(spark, rows, names):
    return spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names.split()))


def test_heads_of_conflicted_and_cyclic_edges(spark):
    chain, diamonds = [(i, i + 1) for i in range(100, 130)], [e for i in range(0, 16, 2) for e in ((i, i + 1), (i, i + 2), (i + 1, i + 2))]
    rings = [(200, 201), (201, 202), (202, 200), (203, 200), (204, 203), (300, 300), (400, 401), (401, 402), (402, 403), (403, 400), (500, 501), (501, 500)]
    edges = pairs(spark, chain + diamonds + rings + chain[:3], "run successor")
    got = {r.run: (r.head, r.steps) for r in graphs.heads(edges).collect()}
    assert graphs.heads(edges).count() == len(got) == len({a for a, _ in chain + diamonds + rings})  # a row a run, whatever the edges
    assert all(got[i] == (130, 130 - i) for i in range(100, 130)) and got[0] == (16, 16) and got[204] == got[300] == got[401] == (None, None)
    assert {(r.run, r.cycle) for r in graphs.cycles(edges).collect()} == {(i, 200) for i in (200, 201, 202)} | {(300, 300)} | {(i, 400) for i in (400, 401, 402, 403)} | {(500, 500), (501, 500)}
    problems = {(r.run, r.problem) for r in graphs.conflicts(edges).collect()}
    assert {r for r, p in problems if p == "cycle"} == {200, 201, 202, 300, 400, 401, 402, 403, 500, 501} and (300, "self-edge") in problems and (200, "second-predecessor") in problems and (0, "second-successor") in problems
    assert graphs.heads(edges.limit(0)).count() == graphs.cycles(pairs(spark, chain, "run successor")).count() == 0


def test_long_tail_before_a_small_cycle(spark):
    edges = [(i, i + 1) for i in range(70)] + [(70, 68)]
    random.Random(1).shuffle(edges)
    assert {(r.run, r.cycle) for r in graphs.cycles(pairs(spark, edges, "run successor")).collect()} == {(68, 68), (69, 68), (70, 68)}


def test_follow_is_good_only_to_a_good_end(spark):
    rows = [(1, None, True), (2, 1, True), (3, 2, True), (4, 3, True), (5, 4, False), (6, 5, True), (7, 99, True), (8, 9, True), (9, 8, True), (10, 8, True), (11, None, False), (12, 11, True)]
    got = graphs.follow(spark.createDataFrame(rows, "node long, to long, good boolean")).collect()
    assert {r.node for r in got if r.good} == {1, 2, 3, 4} and len(got) == len(rows)


def test_reach_walks_the_frontier_of_a_branching_graph(spark):
    rng = random.Random(2)
    edges = [(i, rng.randrange(10_000)) for i in range(10_000) for _ in range(2)]
    starts = [(n, n) for n in (3, 5000)]
    want = set()
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    for name, node in starts:
        todo, seen = [node], {node}
        while todo:
            for b in out.get(todo.pop(), []):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        want |= {(name, s) for s in seen}
    assert {tuple(r) for r in graphs.reach(pairs(spark, starts, "name node"), pairs(spark, edges, "node to")).collect()} == want


def closure(out, node):
    todo, seen = [node], {node}
    while todo:
        for b in out.get(todo.pop(), ()):
            if b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def test_reach_through_chains_rings_and_branches(spark, monkeypatch):
    """Against brute force; what is written along a chain doesn't grow with the square of its length."""
    monkeypatch.setattr(graphs, "PIECE", 7)
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100 + i, 100 + (i + 1) % 30) for i in range(30)] + [(200, 200), (300, 301), (301, 300), (301, 302), (302, 303), (303, 304), (304, 302), (20, 400), (400, 401), (401, 40)]
    edges += [(500 + i, 500 + rng.randrange(40)) for i in range(40)]
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    nodes = {x for e in edges for x in e}
    starts = [(x, x) for x in nodes] + [(-1, 3), (-1, 30), (-1, 115), (-2, 999)]
    got = [tuple(r) for r in graphs.reach(pairs(spark, starts, "name node"), pairs(spark, edges + edges[:9], "node to")).collect()]
    assert len(got) == len(set(got)) and set(got) == {(name, x) for name, node in starts for x in closure(out, node)}


def test_what_reach_writes_along_a_chain(spark, monkeypatch):
    written, kept = [], graphs._kept
    monkeypatch.setattr(graphs, "_kept", lambda df: written.append(kept(df)) or written[-1])
    monkeypatch.setattr(graphs, "_gone", lambda *frames: None)
    edges = spark.range(4000).selectExpr("id AS node", "id + 1 AS to")
    assert graphs.reach(spark.range(0, 4000, 20).selectExpr("id AS name", "id AS node"), edges).count() == sum(4001 - i for i in range(0, 4000, 20))
    assert max(df.count() for df in written) <= 4001


def test_deferrals_look_pairs_up(spark, monkeypatch):
    """Against brute force on chains, a ring and branches, with tasks that no dependency names."""
    written, kept = [], graphs._kept
    monkeypatch.setattr(graphs, "_kept", lambda df: written.append(kept(df)) or written[-1])
    monkeypatch.setattr(graphs, "_gone", lambda *frames: None)
    monkeypatch.setattr(graphs, "PIECE", 50)
    rng = random.Random(5)
    needs = [(2 * i + 2, 2 * i) for i in range(1000)] + [(2 * i + 3, 2 * i + 1) for i in range(1000)] + [(3001 + i % 20, 3000 + i % 20) for i in range(19)] + [(3000, 3019)] + [(4000 + rng.randrange(60), 4000 + rng.randrange(60)) for _ in range(50)]
    out, back = {}, {}
    for a, b in needs:
        out.setdefault(a, []).append(b)
        back.setdefault(b, []).append(a)
    known = sorted({x for e in needs for x in e} | {5000, 5001, 5002})
    checkpoints, open_ = [(x, x // 40) for x in known if x % 5 == 0], [(x, x // 40) for x in known if x % 3]
    got = [tuple(r) for r in graphs.deferrals(pairs(spark, needs, "task needs"), pairs(spark, checkpoints, "checkpoint campaign"), pairs(spark, open_, "task campaign")).collect()]
    near = {c: closure(out, c) | closure(back, c) for c, _ in checkpoints}
    want = [(c, t) for c, m in checkpoints for t, n in open_ if m == n and t not in near[c]]
    assert sorted(got) == sorted(want) and len(want) > 100
    assert max(df.count() for df in written) < 12_000  # the related pairs of the chains alone are 400 000


def test_ready_sets(spark):
    tasks = spark.createDataFrame([(i, i in (1, 2), i == 5) for i in range(1, 13)], "task long, done boolean, blocked boolean")
    needs = pairs(spark, [(3, 1), (4, 3), (4, 2), (6, 5), (7, 6), (7, 3), (8, 9), (9, 8), (10, 8), (11, 77), (4, 3)], "task needs")
    states = graphs.ready(tasks, needs)
    got = {r.task: (r.status, r.wave, r.blocked_by, r.open_needs) for r in states.collect()}
    assert got[1] == ("done", None, None, 0) and got[3] == ("ready", 0, None, 0) and got[12][:2] == ("ready", 0) and got[4] == ("waiting", 1, None, 1)
    assert got[5][0] == "blocked" and got[6] == ("blocked", None, [5], 1) and got[7] == ("blocked", None, [5], 2) and [got[i][0] for i in (8, 9, 10, 11)] == ["stuck"] * 4
    members = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("b", 1), ("c", 5), ("c", 6), ("d", 8), ("e", 8)], "campaign string, task long")
    out = {r.campaign: (r.complete, r.quiescent) for r in graphs.settled(states, members, pairs(spark, [(6,)], "task")).collect()}
    assert out == {"a": (True, False), "b": (False, False), "c": (False, False), "d": (False, True), "e": (False, True)}
