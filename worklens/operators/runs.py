"""Lanes of a job, job summaries over them, and the view of a run from its reconciled tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklens.functions import predicates as P

_SAID = "struct<n:bigint,said:string,labor_class:string,pool:string,ts:timestamp_ntz>"


def _facts(df: DataFrame, kind: str, n: str | None, said: str | None) -> DataFrame:
    """One shape for all that is known of a lane: what an event or a witness said, or the labor of a row or a live job."""
    has = lambda c: F.col(c) if c and c in df.columns else F.lit(None)
    of = F.struct(has(n).alias("n"), has(said).alias("said"), has("labor_class").alias("labor_class"), has("pool").alias("pool"), has("ts").alias("ts")).cast(_SAID)
    none = F.lit(None).cast(_SAID)
    columns = {k: (of if k == kind else none).alias(k) for k in ("event", "witness", "live", "row")}
    return df.select("task", F.col("attempt").cast("int").alias("attempt"), F.col("lease_epoch").cast("long").alias("lease_epoch"), *columns.values())


def evidence_result(event: Column) -> Column:
    """An aggregate over a lane's events: one failed piece of evidence makes the lane fail, no evidence is null."""
    return F.when(F.max(event == "evidence_fail"), "fail").when(F.max(event == "evidence_pass"), "pass")


def lanes(rows: DataFrame, live: DataFrame, events: DataFrame, witness: DataFrame) -> DataFrame:
    """One row for each (task, attempt, lease_epoch) that anything names, null-safe.

    rows, live (task, attempt, lease_epoch, labor_class), events (.., sequence,
    event, ts, pool) and witness (.., seq, verdict, ts, pool) meet in one
    aggregate, so no list of a lane's records is held: event and witness are the
    last ones by number, row and live what these say, with counts, the evidence
    and the times of a lane. A witness ends a lane before a terminal event does.
    """
    facts = _facts(rows, "row", None, None).union(_facts(live, "live", None, None)).union(_facts(events, "event", "sequence", "event")).union(_facts(witness, "witness", "seq", "verdict"))
    said, at, n = F.col("event.said"), F.col("event.ts"), F.col("event.n")
    first = lambda kind: F.min_by(at, F.when(said == kind, n)).alias(f"{kind}_at")
    ended = F.max_by(at, F.when(P.terminal(said), n))
    # equal numbers don't occur within a ledger; the structs then decide by what they say
    return facts.groupBy("task", "attempt", "lease_epoch").agg(
        F.max("event").alias("event"), F.max("witness").alias("witness"), F.max("live").alias("live"), F.max("row").alias("row"), F.count("event").alias("n_events"), F.count("witness").alias("n_witnesses"),
        evidence_result(said).alias("evidence"), first("enqueued"), first("dispatched"), first("started"), F.max_by(at, n).alias("last_event_at"), ended.alias("ended"),
    ).withColumn("terminal_at", F.coalesce("witness.ts", "ended")).drop("ended")


def job_summaries(lanes: DataFrame, rows: DataFrame, parents: DataFrame) -> DataFrame:
    """One summary for each task that has a row or a lane.

    The current lane is the one of the greatest attempt over live job, row,
    events and witnesses, then of the greatest lease within it. Its newest event
    counts, or the newest of all; its newest witness says the labor, then its
    live job, the event, its row, any live job, and the latest witness, which is
    greatest in attempt, lease and seq. Evidence is that of the current lane.
    """
    here = F.struct("event", "witness", "live", "row", "evidence", "attempt", "lease_epoch")
    jobs = lanes.groupBy("task").agg(
        F.max_by(here, F.when(F.col("attempt").isNotNull(), F.struct("attempt", "lease_epoch"))).alias("now"), F.max("event").alias("last_event"),
        F.max_by("witness", F.when(F.col("witness").isNotNull(), F.struct("attempt", "lease_epoch", "witness.n"))).alias("last_witness"), F.max("live").alias("any_live"), F.max("row").alias("any_row"),
    )
    event = F.coalesce("now.event", "last_event")
    labor = F.coalesce("now.witness.labor_class", "now.live.labor_class", event["labor_class"], "now.row.labor_class", "any_live.labor_class", "last_witness.labor_class")
    children = parents.groupBy(F.col("parent").alias("task")).agg(F.count("*").alias("n_children"))
    known = jobs.join(rows.select("task", "run", "priority"), "task", "full_outer").join(children, "task", "left")
    return known.select(
        "task", "run", "priority", F.col("now.attempt").alias("current_attempt"), F.col("now.lease_epoch").alias("current_lease"), event["said"].alias("event"), F.col("now.evidence").alias("evidence"),
        F.col("last_witness.said").alias("verdict"), labor.alias("labor_class"), F.coalesce("any_row.pool", event["pool"], "last_witness.pool").alias("pool"), F.coalesce("n_children", F.lit(0)).alias("n_children"),
    )


def _flag(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.select("run", "task", F.lit(name).alias("kind"), value.cast("string").alias("value"))


def task_states(tasks: DataFrame, done: DataFrame, failures: DataFrame, current: DataFrame, frontier: DataFrame, needs: DataFrame, runs: DataFrame) -> DataFrame:
    """(run, task, status, advanced, blocked_by, stage) for the reconciled tasks of each run.

    In this order: done (merged, a checkpoint, or a node that proves it; done
    (run, task, advanced)); blocked by a failure (run, task, stage); running;
    pending with a current node (run, task, state) that isn't running, or on the
    frontier of an active run (runs (run, active)); blocked on the frontier of
    one that isn't; pending without open dependencies (needs (run, task,
    needs)), else blocked by them. Facts of a task meet in one aggregate.
    """
    facts = _flag(tasks, "known", F.lit("")).union(_flag(done, "done", F.col("advanced"))).union(_flag(failures, "failed", F.col("stage"))).union(_flag(current, "current", F.col("state"))).union(_flag(frontier, "frontier", F.lit("")))
    has = lambda kind: F.max(F.col("kind") == kind).alias(kind)
    said = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("value")))
    found = facts.groupBy("run", "task").agg(*map(has, ("known", "done", "failed", "current", "frontier")), (said("done") == "true").alias("advanced"), said("failed").alias("stage"), said("current").alias("state")).filter("known")
    met = done.select("run", F.col("task").alias("needs")).distinct().withColumn("met", F.lit(True))
    waits = needs.join(met, ["run", "needs"], "left").filter("met IS NULL").groupBy("run", "task").agg(F.sort_array(F.collect_set("needs")).alias("blocked_by"))
    rows = found.join(waits, ["run", "task"], "left").join(runs.select("run", "active"), "run", "left")
    free, active = F.col("blocked_by").isNull(), F.coalesce("active", F.lit(False))
    status = F.when(F.col("done"), "done").when(F.col("failed"), "blocked").when(F.col("state") == "running", "running").when(F.col("current") | (F.col("frontier") & active), "pending")
    status = status.when(F.col("frontier"), "blocked").otherwise(F.when(free, "pending").otherwise("blocked"))
    return rows.select("run", "task", status.alias("status"), F.coalesce("advanced", F.lit(False)).alias("advanced"), "blocked_by", "stage")


def run_states(states: DataFrame, runs: DataFrame, anomalies: DataFrame) -> DataFrame:
    """(run, done, running, blocked, pending, state) from task_states().

    runs (run, active, superseded, failed, nodes_passed): failed tells of a node
    or the parent that failed, nodes_passed that all nodes ended well on their
    current attempt, which counts as complete where no tasks are reconciled.
    anomalies (run, task) of tasks that are done meanwhile are none. A successor
    makes a run superseded whatever else holds.
    """
    kinds = ("done", "running", "blocked", "pending")
    counts = states.groupBy("run").agg(*[F.count_if(F.col("status") == k).alias(k) for k in kinds], F.max("advanced").alias("any_advanced"))
    odd = anomalies.join(states.filter("status = 'done'").select("run", "task"), ["run", "task"], "left_anti").groupBy("run").agg(F.lit(True).alias("odd"))
    rows = runs.join(counts, "run", "left").join(odd, "run", "left")
    n = sum(F.coalesce(k, F.lit(0)) for k in kinds)
    complete = F.when(n == 0, F.coalesce("nodes_passed", F.lit(False))).otherwise(F.col("done") == n)
    is_true = lambda c: F.coalesce(c, F.lit(False))
    state = F.when(is_true("superseded"), "superseded").when(is_true("active"), "running").when(is_true("failed") | is_true("odd"), "needs-attention").when(complete, "complete").when(is_true("any_advanced"), "advanced").otherwise("idle")
    return rows.select("run", *[F.coalesce(k, F.lit(0)).alias(k) for k in kinds], state.alias("state"))


def standup_bucket(verdict: Column, evidence_failed: Column, gate_failed: Column, state: Column, pending: Column) -> Column:
    """Where a job belongs in a stand-up digest; null for one that nothing is known of.

    evidence_failed is about the attempt of the witness, else the journal's last.
    state is the journal's, null if it never spoke; pending is a row that waits
    or recurs. A verdict goes before the journal.
    """
    bad = F.coalesce(evidence_failed, F.lit(False))
    judged = F.when(verdict == "cancelled", "cancelled").when((verdict == "clean-exit-no-artifact") | bad | F.coalesce(gate_failed, F.lit(False)), "gate_fails").otherwise("completed")
    ended = F.coalesce(P.journal_terminal(state), F.lit(False))
    return F.when(verdict.isNotNull(), judged).when(ended, F.when(bad, "gate_fails").otherwise("completed")).when(state.isNotNull() | F.coalesce(pending, F.lit(False)), "in_flight")


def standup_jobs(rows: DataFrame, events: DataFrame, witness: DataFrame) -> DataFrame:
    """(task, verdict, labor_class, bucket) of every job that rows (task, state), events or witness name.

    Attempts with failed evidence are found by (task, attempt) before jobs are
    put together, so no list of attempts is held for a job.
    """
    journal = events.groupBy("task").agg(F.max_by("event", F.struct(F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(-1)), "sequence")).alias("journal"), F.max("attempt").alias("last_attempt"))
    seen = witness.groupBy("task").agg(F.max(F.struct("seq", "ledger_id", "attempt", "verdict", "labor_class")).alias("w"))
    jobs = rows.select("task", "state").join(journal, "task", "full_outer").join(seen, "task", "full_outer").withColumn("attempt", F.coalesce("w.attempt", "last_attempt"))
    failed = events.filter("event = 'evidence_fail'").select("task", "attempt", F.lit(True).alias("failed")).distinct()
    jobs = jobs.join(failed, ["task", "attempt"], "left")
    bucket = standup_bucket(F.col("w.verdict"), F.col("failed"), F.lit(False), F.col("journal"), F.col("state").isin("pending", "recurring"))
    return jobs.select("task", F.col("w.verdict").alias("verdict"), F.col("w.labor_class").alias("labor_class"), bucket.alias("bucket"))


def failures(members: DataFrame, lanes: DataFrame, events: DataFrame, witness: DataFrame) -> DataFrame:
    """(run, task, verdict, attempt, lease_epoch, failed_at, stderr_tail, stderr_truncated, error) of members (run, task) whose current attempt ended without passing.

    The latest witness must be of the current attempt. The tail is that of the
    newest failed event of the current lane, events (.., stderr_tail,
    stderr_truncated), the error that of its newest witness, witness (.., error);
    a lane without a lease takes those of all leases of its attempt.
    """
    jobs = lanes.groupBy("task").agg(
        F.max_by(F.struct("attempt", "lease_epoch"), F.when(F.col("attempt").isNotNull(), F.struct("attempt", "lease_epoch"))).alias("now"),
        F.max_by(F.struct("attempt", "witness", "terminal_at"), F.when(F.col("witness").isNotNull(), F.struct("attempt", "lease_epoch", "witness.n"))).alias("last"),
    )
    bad = jobs.filter((F.col("last.attempt") == F.col("now.attempt")) & ~P.passing(F.col("last.witness.said")))
    bad = bad.select("task", F.col("last.witness.said").alias("verdict"), F.col("now.attempt").alias("attempt"), F.col("now.lease_epoch").alias("lease_epoch"), F.col("last.terminal_at").alias("failed_at"))
    lane = bad.select("task", "attempt", F.col("lease_epoch").alias("__lease"))
    here = F.col("__lease").isNull() | (F.col("lease_epoch") == F.col("__lease"))
    tails = events.filter("event = 'failed'").join(lane, ["task", "attempt"]).filter(here).groupBy("task").agg(F.max_by(F.struct("stderr_tail", "stderr_truncated"), "sequence").alias("tail"))
    errors = witness.join(lane, ["task", "attempt"]).filter(here).groupBy("task").agg(F.max_by("error", "seq").alias("error"))
    out = members.select("run", "task").distinct().join(bad, "task").join(tails, "task", "left").join(errors, "task", "left")
    return out.select("run", "task", "verdict", "attempt", "lease_epoch", "failed_at", "tail.stderr_tail", "tail.stderr_truncated", "error")
