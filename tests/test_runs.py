"""Lanes, run views and stand-up buckets by hand, after the rules' own cases."""

import pytest
from pyspark.sql import functions as F

from worklens.operators import runs

ROWS = "task long, attempt int, lease_epoch long, labor_class string, run long, priority int, pool string, state string"
LIVE = "task long, attempt int, lease_epoch long, labor_class string"
EVENTS = "task long, attempt int, lease_epoch long, sequence long, event string, labor_class string, pool string, ts timestamp_ntz"
WITNESS = "task long, attempt int, lease_epoch long, seq long, ledger_id long, verdict string, labor_class string, ts timestamp_ntz"


def frame(spark, rows, schema):
    return spark.createDataFrame([tuple(r.get(c.split()[0]) for c in schema.split(", ")) for r in rows], schema)


def summary(spark, rows=(), live=(), events=(), witness=()):
    r, f = frame(spark, [{"task": 1} | x for x in rows], ROWS), lambda given, schema: frame(spark, [{"task": 1} | x for x in given], schema)
    lanes = runs.lanes(r, f(live, LIVE), f(events, EVENTS), f(witness, WITNESS))
    parents = spark.createDataFrame([], "task long, parent long")
    return lanes, runs.job_summaries(lanes, r, parents).collect()[0]


def test_current_lane_is_the_greatest_attempt_and_then_its_greatest_lease(spark):
    lanes, job = summary(spark, rows=[{"attempt": 3, "lease_epoch": 2, "labor_class": "row"}], live=[{"attempt": 2, "lease_epoch": 9, "labor_class": "live"}], events=[{"attempt": 2, "lease_epoch": 9, "sequence": 7, "event": "started"}], witness=[{"attempt": 1, "lease_epoch": 50, "seq": 3, "verdict": "failed", "labor_class": "old"}])
    assert lanes.count() == 3 and (job.current_attempt, job.current_lease) == (3, 2)
    # nothing happened on the row's lane: the newest event of all is shown, the row tells the labor
    assert (job.event, job.verdict, job.labor_class, job.evidence) == ("started", "failed", "row", None)


def test_evidence_is_that_of_the_current_lane_and_one_failure_sticks(spark):
    said = [{"attempt": 1, "lease_epoch": 1, "sequence": 1, "event": "evidence_fail"}, {"attempt": 2, "lease_epoch": 1, "sequence": 2, "event": "evidence_fail"}, {"attempt": 2, "lease_epoch": 4, "sequence": 3, "event": "evidence_pass"}]
    assert summary(spark, events=said)[1].evidence == "pass"
    assert summary(spark, events=[*said, {"attempt": 2, "lease_epoch": 4, "sequence": 2, "event": "evidence_fail"}])[1].evidence == "fail"
    lanes, job = summary(spark, events=[{"attempt": 1, "lease_epoch": 1, "sequence": 1, "event": "completed"}], witness=[{"attempt": 1, "lease_epoch": 1, "seq": 1, "verdict": "pass"}])
    assert job.evidence is None and [r.evidence for r in lanes.collect()] == [None]  # a verdict is no evidence


def test_lanes_without_lease_or_attempt(spark):
    events = [{"sequence": 1, "event": "enqueued"}, {"attempt": 1, "sequence": 2, "event": "started", "labor_class": "event"}, {"attempt": 1, "sequence": 3, "event": "heartbeat"}]
    lanes, job = summary(spark, events=events, live=[{"attempt": 0, "lease_epoch": 1, "labor_class": "live"}])
    assert sorted((r.attempt is not None, r.n_events) for r in lanes.collect()) == [(False, 1), (True, 0), (True, 2)]
    assert (job.current_attempt, job.current_lease, job.event, job.labor_class) == (1, None, "heartbeat", "live")
    assert summary(spark, events=events[:1])[1].current_attempt is None


@pytest.mark.parametrize("verdict, failed, gate, state, pending, want", [
    ("cancelled", True, False, None, None, "cancelled"), ("clean-exit-no-artifact", False, False, None, None, "gate_fails"), ("pass", True, False, None, None, "gate_fails"), ("pass", None, True, None, None, "gate_fails"), ("reused", None, None, "started", None, "completed"),
    ("failed", None, None, None, None, "completed"), (None, True, None, "completed", None, "gate_fails"), (None, None, None, "failed", None, "completed"), (None, None, None, "started", None, "in_flight"), (None, None, None, None, True, "in_flight"), (None, None, None, None, None, None),
])
def test_standup_buckets(spark, verdict, failed, gate, state, pending, want):
    row = spark.createDataFrame([(verdict, failed, gate, state, pending)], "v string, f boolean, g boolean, s string, p boolean")
    assert row.select(runs.standup_bucket(*[F.col(c) for c in "vfgsp"])).first()[0] == want


def test_run_view(spark):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    tasks = t([(1, x) for x in "abcdefgh"] + [(2, "a"), (3, "a"), (4, "z")], "run long, task string")
    done = t([(1, "a", False), (2, "a", True), (4, "z", True)], "run long, task string, advanced boolean")
    failures, current = t([(1, "b", "gate")], "run long, task string, stage string"), t([(1, "c", "running"), (1, "d", "queued")], "run long, task string, state string")
    frontier, needs = t([(1, "e"), (3, "a")], "run long, task string"), t([(1, "g", "a"), (1, "h", "a"), (1, "h", "b")], "run long, task string, needs string")
    known = t([(1, True, False, False, False), (2, False, False, False, False), (3, False, False, False, False), (4, False, True, False, False), (5, False, False, False, True), (6, False, False, True, False)], "run long, active boolean, superseded boolean, failed boolean, nodes_passed boolean")
    states = runs.task_states(tasks, done, failures, current, frontier, needs, known)
    got = {(r.run, r.task): (r.status, r.blocked_by) for r in states.collect()}
    assert [got[1, x][0] for x in "abcdefgh"] == ["done", "blocked", "running", "pending", "pending", "pending", "pending", "blocked"] and got[1, "h"][1] == ["b"] and got[3, "a"][0] == "blocked"
    anomalies = t([(2, "a"), (3, "a")], "run long, task string")  # the first is done meanwhile
    assert {r.run: r.state for r in runs.run_states(states, known, anomalies).collect()} == {1: "running", 2: "complete", 3: "needs-attention", 4: "superseded", 5: "complete", 6: "needs-attention"}
    assert {r.run: r.state for r in runs.run_states(states, known, anomalies.limit(0)).collect()}[3] == "idle"
