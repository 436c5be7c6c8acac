"""Accounting of cumulative counters and coverage of runs, by hand."""

from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from worklens.operators import accounting

D = "decimal(20,0)"
SCHEMA = (
    f"ledger_id long, seq long, task string, attempt int, lease_epoch long, adapter string, session string, scope string, mode string, pred_task string, pred_attempt int, pred_lease long, evidence string, declared array<string>, state string, unreadable array<string>, "
    f"input_tokens {D}, input_as_reported {D}, cache_read_tokens {D}, cache_write_tokens {D}, output_tokens {D}, reasoning_tokens {D}, stated_total {D}, cost_usd decimal(38,18), currency string, record string"
)
FIVE = ["cacheReadTokens", "cacheWriteTokens", "inputTokensWithCacheRead", "outputTokens", "reasoningTokens"]
BASE = {"ledger_id": 1, "attempt": 1, "lease_epoch": 1, "adapter": "threads", "session": "s", "scope": "session-cumulative", "mode": "fresh", "evidence": "accounted", "declared": FIVE, "state": "reported", "unreadable": [], "record": "accounted", "currency": "USD"}


def said(task, seq, figures=(), **more):
    names = ["input_as_reported", "cache_read_tokens", "cache_write_tokens", "output_tokens", "reasoning_tokens"]
    return BASE | {"task": task, "seq": seq} | dict(zip(names, figures)) | more


def resumed(task, seq, before, figures, **more):
    return said(task, seq, figures, **({"mode": "resume", "pred_task": before, "pred_attempt": 1, "pred_lease": 1} | more))


def frame(spark, rows):
    schema = _parse_datatype_string(SCHEMA)
    from decimal import Decimal

    fit = lambda f, v: v if v is None or not f.dataType.typeName().startswith("decimal") else Decimal(str(v))
    return spark.createDataFrame([tuple(fit(f, r.get(f.name)) for f in schema.fields) for r in rows], schema)


def accounted(spark, rows):
    out = {}
    for r in accounting.account(frame(spark, rows)).collect():
        a = r.accounting
        out[r.task] = (a.state, a.basis, a.reason, a.unavailable, *[None if v is None else int(v) for v in (a.input_tokens, a.input_as_reported, a.cache_read_tokens, a.cache_write_tokens, a.output_tokens, a.reasoning_tokens)])
    return out


def test_deltas_of_a_resumed_session(spark):
    first, second = (16204, 11008, 0, 5, 0), (32834, 26112, 0, 11, 0)
    wrong = {"adapter": "pi"}, {"scope": "attempt"}, {"declared": FIVE[1:]}
    rows = [
        said("a", 1, first), resumed("b", 2, "a", second), resumed("same", 3, "b", second), resumed("under", 4, "b", (32833, 26112, 0, 11, 1)), resumed("unread", 5, "b", (40000, None, 0, 12, 1)), resumed("none", 6, "b", second, pred_task=None), resumed("gone", 7, "zz", second), resumed("later", 8, "z", second),
        said("z", 9, first), said("old", 10, first, evidence="legacy"), resumed("legacy", 11, "old", second), resumed("other", 12, "a", second, session="t"), resumed("nosession", 13, "a", second, session=None), resumed("absent", 14, "a", (), state="not-reported"),
        said("silent", 15, (), state="not-reported"), resumed("after", 16, "silent", second), resumed("cache", 17, "b", (32840, 26130, 0, 11, 0)), said("raw", 18, (5, None, 0, 1, 0), unreadable=["cacheReadTokens"]), said("rawnone", 19, (), unreadable=["outputTokens"]),
        *[said(f"p{i}", 20 + i, first, **w) for i, w in enumerate(wrong)], *[resumed(f"w{i}", 30 + i, f"p{i}", second) for i in range(3)], said("plain", 40, second, scope="attempt", mode="resume", pred_task="a", pred_attempt=1, pred_lease=1), said("a", 41, (16300, 11008, 0, 5, 0)), resumed("again", 42, "a", second),
    ]
    got = accounted(spark, [r for r in rows if r["seq"] != 41] + [r for r in rows if r["seq"] == 41])
    assert got["b"] == ("exact", "delta", None, [], 1526, 16630, 15104, 0, 6, 0)
    assert got["same"][4:] == (0, 0, 0, 0, 0, 0) and got["plain"] == ("exact", "fresh", None, [], None, 32834, 26112, 0, 11, 0)
    assert got["under"][:4] == ("partial", "delta", "counter-underflow", ["inputTokensWithCacheRead"]) and got["under"][4:] == (None, None, 0, 0, 0, 1)
    assert got["unread"][:4] == ("partial", "delta", "unreadable-current", ["cacheReadTokens"]) and got["unread"][4:6] == (None, 7166)
    nothing = (None,) * 6
    for task, why in (("none", "missing"), ("gone", "missing"), ("later", "missing"), ("after", "missing"), ("legacy", "legacy")):
        assert got[task] == ("unavailable", "delta", f"{why}-predecessor", FIVE, *nothing)
    assert got["other"][2] == got["nosession"][2] == "session-mismatch" and [got[f"w{i}"][2] for i in range(3)] == ["declaration-mismatch"] * 3
    assert got["absent"] == ("exact", "delta", None, [], *nothing) and got["silent"] == ("exact", "fresh", None, [], *nothing)
    assert got["cache"][:4] == ("partial", "delta", "counter-underflow", ["inputTokensWithCacheRead"]) and got["cache"][4:7] == (None, None, 18)  # more cached than read
    assert got["raw"][:4] == ("partial", "fresh", "unreadable-current", ["cacheReadTokens"]) and got["rawnone"][0] == "unavailable"
    assert got["again"][5] == 32834 - 16300  # the last scrape of that attempt before


def test_bindings_carry_along_the_chain(spark):
    row = lambda seq, kind="delta", before=None, **more: {"ledger_id": 1, "seq": seq, "hash": f"h{seq}", "task": "t", "attempt": seq, "lease_epoch": 1, "adapter": "a", "session": "s", "scope": "c", "declared": ["x"], "derivation": kind, "contributes": True, "pred_seq": before, "pred_hash": before and f"h{before}", "pred_task": before and "t", "pred_attempt": before, "pred_lease": before and 1} | more
    rows = [row(1, "fresh-zero"), row(2, before=1), row(3, before=2), row(4, before=3), row(5, before=4, pred_hash="x"), row(6, before=5), row(7, before=99), row(8, before=9), row(9, before=8), row(10, "baseline-missing", contributes=False), row(11, before=10), row(12, before=2, session="u"), row(13, before=2, pred_lease=2), row(14, "attempt")]
    schema = "ledger_id long, seq long, hash string, task string, attempt int, lease_epoch long, adapter string, session string, scope string, declared array<string>, derivation string, contributes boolean, pred_seq long, pred_hash string, pred_task string, pred_attempt int, pred_lease long"
    got = {r.seq: (r.bound, r.counted) for r in accounting.bindings(spark.createDataFrame([tuple(r.values()) for r in rows], schema)).collect()}
    assert got[1] == (None, True) and got[14] == (None, True) and got[10] == (None, False) and [got[i] for i in (2, 3, 4)] == [(True, True)] * 3
    assert got[5] == (False, False) and got[6] == (True, False)  # its own link holds, the one before does not
    assert [got[i][0] for i in (7, 8, 9, 11, 12, 13)] == [False, False, True, False, False, False] and not got[9][1]


def test_roll_up_against_the_roster(spark):
    big = 2**63
    rows = [
        said("a", 1, (10, 4, 1, 5, 2), input_tokens=6), said("a", 2, (20, 8, 1, 6, 2), input_tokens=12, lease_epoch=2), said("a", 3, (1, 0, 0, 1, 0), input_tokens=1, attempt=9), said("b", 4, (), state="not-reported"), said("b", 5, (), attempt=2, record=None, evidence=None), said("c", 6, (big, 0, 0, big, 0), input_tokens=big, attempt=1),
        said("d", 7, (3, None, 0, 1, 0), unreadable=["cacheReadTokens"]), said("stranger", 8, (1, 1, 1, 1, 1)), said("e", 9, (), record="legacy", stated_total=5), said("f", 10, (1, 0, 0, 1, 0), ledger_id=2, input_tokens=1), said("g", 11, (), declared=["totalTokens", "costUsd"], stated_total=7, cost_usd="0.25"), said("h", 12, (), declared=["costUsd"], cost_usd="0.5", currency="EUR"),
    ]
    roster = spark.createDataFrame([(1, "a", 2), (1, "b", 2), (2, "c", 1), (3, "d", None), (4, "e", 1), (5, "f", 1), (6, "g", 1), (7, "h", 1), (8, "none", 0)], "run long, task string, ceiling int")
    verified = spark.createDataFrame([(1, True), (2, False)], "ledger_id long, verified boolean")
    out = {r.run: r for r in accounting.roll_up(roster, accounting.account(frame(spark, rows)), verified).collect()}
    one = out[1]
    assert (one.tasks, one.expected, one.observed, one.attested, one.unexpected, one.duplicate_leases, one.missing_attempts, one.tasks_without_attestation) == (2, 4, 5, 3, 1, 1, 1, 0)
    assert (one.input_tokens, one.output_tokens, one.fresh_input, one.total_tokens, one.n_input_tokens, one.fresh_complete) == (12, 6, 13, 27, 1, 1)  # the last lease counts
    assert one.caveats == ["attempts-missing-attestation", "duplicate-attempt-leases", "unexpected-attestation", "attempts-without-usage", "partial-components", "unreadable-usage-record"]
    assert out[2].saturated and out[2].total_tokens == 2**64 - 1 and out[2].caveats == ["sum-saturated"] and not out[2].complete
    assert out[3].caveats == ["attempt-counter-unavailable", "partial-components", "accounting-unavailable", "unreadable-fields", "partial-fresh-input"]
    assert out[4].caveats == ["legacy-usage-contract", "declared-surface-unknown"] and out[5].caveats == ["ledger-unverified", "attempts-missing-attestation", "members-without-attestation"] and out[5].input_tokens is None
    assert out[6].complete and (out[6].total_tokens, out[6].total_source, out[6].cost_usd) == (7, "harness", 0.25) and [tuple(f) for f in out[6].fields] == [("costUsd", 1, 1, 0, 0), ("totalTokens", 1, 1, 0, 0)]
    assert out[7].caveats == ["non-usd-cost"] and out[8].caveats == ["members-without-attestation"] and set(sum((r.caveats for r in out.values()), [])) <= set(accounting.CAVEATS)
    missing = {r.run: r.missing for r in accounting.missing(roster, frame(spark, rows).filter(F.col("ledger_id") == 1)).collect()}
    assert missing == {5: ["f#1"]} | ({1: missing[1]} if 1 in missing else {})
    huge = spark.createDataFrame([(1, "x", 2_000_000_000), (1, "y", 3)], "run long, task string, ceiling int")
    first = accounting.missing(huge, spark.createDataFrame([("x", 2)], "task string, attempt int")).collect()[0].missing
    assert first[:3] == ["x#1", "x#3", "x#4"] and len(first) == 64


def test_account_of_scrapes_that_name_no_other(spark):
    """Without the columns that name a predecessor the figures are those of scrapes that name none, and nothing is shuffled."""
    rows = [said("a", 1, (10, 4, 0, 3, 1)), said("a", 2, (10, None, 0, 3, 1), mode="resume"), said("b", 1, (1, 2, 3, 4, 5), unreadable=["outputTokens"]), said("c", 1, state="not-reported")]
    df = frame(spark, rows)
    bare = accounting.account(df.drop("pred_task", "pred_attempt", "pred_lease"))
    want = {(r.task, r.seq): r.accounting for r in accounting.account(df).collect()}
    assert {(r.task, r.seq): r.accounting for r in bare.collect()} == want and len(want) == 4
    assert "Exchange" not in bare._jdf.queryExecution().executedPlan().toString()
    roster = spark.createDataFrame([("r", "a", 2), ("r", "b", None), ("r", "c", 3)], "run string, task string, ceiling int")
    verified = spark.createDataFrame([(1, True)], "ledger_id long, verified boolean")
    assert accounting.roll_up(roster, bare, verified).collect() == accounting.roll_up(roster, accounting.account(df), verified).collect()


def test_bindings_hold_records_against_each_other_once(spark, monkeypatch):
    """What is returned reads what was kept, not the records again, and only records that hold by themselves are followed."""
    kept, follow = accounting.shared.kept, accounting.graphs.follow
    held, followed = [], []
    monkeypatch.setattr(accounting.shared, "kept", lambda df: held.append(kept(df)) or held[-1])
    monkeypatch.setattr(accounting.graphs, "follow", lambda df: followed.append(df) or follow(df))
    derivations = {1: "fresh-zero", 2: "delta", 3: "baseline-missing", 4: "delta", 5: None, 6: "delta", 7: "attempt"}
    rows = [(1, n, f"h{n}", "t", 1, 1, "x", None if n == 6 else "s", "session-cumulative", ["outputTokens"], d, n != 7, n - 1 if d == "delta" else None, f"h{n - 1}", "t", 1, 1) for n, d in derivations.items()]
    schema = "ledger_id long, seq long, hash string, task string, attempt int, lease_epoch long, adapter string, session string, scope string, declared array<string>, derivation string, contributes boolean, pred_seq long, pred_hash string, pred_task string, pred_attempt int, pred_lease long"
    out = accounting.bindings(spark.createDataFrame(rows, schema))
    assert {r.seq: (r.bound, r.counted) for r in out.collect()} == {1: (None, True), 2: (True, True), 3: (None, False), 4: (False, False), 5: (None, False), 6: (False, False), 7: (None, False)}
    assert len(held) == 1 and "pred_hash" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.node.seq for r in followed[0].collect()) == [1, 2]
