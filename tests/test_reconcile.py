"""Differences of views, lease outcomes and patterns as a table."""

import json
import random

from worklens.operators import paths, reconcile


def test_first_difference(spark):
    base = {"snapshot": {"createdAt": "t1", "n": 1}, "tasks": [{"id": "a", "x/y": 1}, {"id": "b"}], "z": None, "currentNodes": [{"elapsedSeconds": 5, "label": "n"}]}

    def changed(f):
        other = json.loads(json.dumps(base))
        f(other)
        return other

    cases = [
        (lambda v: None, None), (lambda v: v["snapshot"].update(createdAt="t2"), None), (lambda v: v["currentNodes"][0].update(elapsedSeconds=9), None), (lambda v: v["tasks"][0].update({"x/y": 2}), ("/tasks/0/x~1y", "1", "2")), (lambda v: v["tasks"].pop(), ("/tasks/length", None, None)),
        (lambda v: v["tasks"][0].update(id="c") or v["tasks"].pop(), ("/tasks/0/id", '"a"', '"c"')), (lambda v: v.update(aa=1), ("/aa", None, "1")), (lambda v: v.pop("z"), ("/z", "null", None)), (lambda v: v.update(tasks={"id": 1}), ("/tasks", "array", "object")), (lambda v: v.update(z=1.0, snapshot={}), ("/snapshot/n", "1", None)),
        (lambda v: v["tasks"].append([]) or v.update(z=0), ("/tasks/length", None, None)), (lambda v: v["tasks"][0].update({"x/y": 1.0}), ("/tasks/0/x~1y", "1", "1.0")),
    ]
    rebuilt = spark.createDataFrame([(i, json.dumps(base)) for i in range(len(cases))] + [(100, "{}"), (102, None)], "run long, view string")
    live = spark.createDataFrame([(i, json.dumps(changed(f))) for i, (f, _) in enumerate(cases)] + [(101, "5"), (102, None)], "run long, view string")
    out = reconcile.first_differences(rebuilt, live, "run", ("/snapshot/createdAt", "/currentNodes/*/elapsedSeconds"))
    got = {r.run: (r.path, r.rebuilt, r.live) for r in out.collect()}
    assert got == {i: w for i, (_, w) in enumerate(cases) if w} | {100: ("/", "object", None), 101: ("/", None, "5")}


def test_lease_outcomes(spark):
    head, digest, p = "a" * 40, "b" * 64, "refs/x"
    proof = lambda task, rev=head: f"{p}/checkpoint/{task}-{digest}/{rev}"
    leases = [("run", 2, head), ("open", 0, head), ("nogate", 0, head), ("nohead", 0, "main"), ("unproved", 0, "c" * 40), ("done", 0, head), ("hyphen", 0, head), ("empty", 0, head)]
    tasks = [(c, 1, "the-lease", False) for c in ("run", "open", "nogate", "nohead", "unproved", "done")] + [(c, 2, "gate", True) for c in ("run", "open", "nohead", "unproved", "done")] + [("hyphen", 1, "the", False), ("hyphen", 2, "gate", True), ("done", 3, "late", False)]
    refs = [(c, f"{p}/merge/the-lease", "x") for c in ("nogate", "nohead", "unproved", "hyphen")] + [("done", f"{p}/merge/the-lease-{'0' * 16}", "x"), ("done", f"{p}/merge/late", "x")] + [(c, proof("gate"), head) for c in ("open", "nohead", "done", "hyphen")] + [("unproved", proof("gate"), head), ("done", f"y/merge/other", "x")]
    out = reconcile.lease_outcomes(spark.createDataFrame(leases, "campaign string, live_nodes int, published_head string"), spark.createDataFrame(tasks, "campaign string, place int, task string, checkpoint boolean"), spark.createDataFrame(refs, "campaign string, reference string, target string"), p)
    got = {r.campaign: (r.outcome, r.reason, r.outstanding, r.proof) for r in out.collect()}
    assert got["done"] == ("lapse", "proved", 0, proof("gate")) and got["open"] == ("renew", "outstanding", 1, None) and got["hyphen"][1:3] == ("outstanding", 1)
    assert [got[c][1] for c in ("run", "nogate", "nohead", "unproved", "empty")] == ["running", "no-gate", "no-head", "not-proved", "no-gate"]


def test_patterns_of_a_table_match_as_columns_do(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["src", "lib", "a", "b.rs", "Test", "x1", "x[1]", "doc"])
    given = ["/".join(word() for _ in range(rng.randint(1, 5))) for _ in range(150)] + ["a", "src/a/b.rs", "SRC/A"]
    part = lambda: rng.choice(["*", "**", "x?", "*.rs", "[!x]*", "x[0-9]", "src", "Lib", "a", "t*t"])
    globs = sorted({"/".join(part() for _ in range(rng.randint(1, 4))) for _ in range(60)} | {"**", "**/a", "a/**", "src/**/b.rs", "**/**/a", "test"})
    df = spark.createDataFrame([(x,) for x in sorted(set(given))], "path string")
    want = {tuple(r) for r in paths.forbidden(df, globs).select("path", "glob").collect()}
    many = [f"none{i}/**/x{i}" for i in range(10_000)]
    got = [tuple(r) for r in paths.forbidden_by(df, spark.createDataFrame([(g,) for g in globs + many], "glob string")).collect()]
    assert set(got) == want and len(got) == len(want) > 300
    assert paths.forbidden_by(df.limit(0), spark.createDataFrame([("a",)], "glob string")).count() == 0


def test_wildcards_meet_only_parts_that_begin_as_they_do(spark, monkeypatch):
    """Against the patterns one by one; no part of a path is held against all wildcards of its folder."""
    written, kept = [], paths.kept
    monkeypatch.setattr(paths, "kept", lambda df: written.append(df) or kept(df))
    globs = [f"d/{x}" for x in ("a*", "A?c", "*", "?b", "[ab]c", "a[", "a[*", "ab.c*", "ab\\*", "abc*x", "x*")] + [f"d/{i}*" for i in range(300)]
    df = spark.createDataFrame([(f"d/{x}",) for x in ("a", "abc", "ABC", "a[", "a[z", "ab.cd", "abxcd", "ab\\z", "abczx", "", "12", "123", "299z")], "path string")
    want = {tuple(r) for r in paths.forbidden(df, globs).select("path", "glob").collect()}
    got = [tuple(r) for r in paths.forbidden_by(df, spark.createDataFrame([(g,) for g in globs], "glob string")).collect()]
    assert sorted(got) == sorted(want) and len(want) > 20
    assert any("start" in line for df in written for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line)
