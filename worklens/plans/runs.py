"""Queries for lanes, job summaries, run views and stand-up digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worklens.functions import predicates as P
from worklens.operators import ledger, runs
from worklens.plans import register
from worklens.plans.sql import EVENTS, GRADED, JUDGED, LIVE, MEMBERS, PARENTS, TASKS, WITNESS, with_
from worklens.sources import bridge

#: Rows and live jobs with an attempt, a lease and a labor of their own.
_HELD = """held AS (SELECT *, priority AS attempt, run % 7 AS lease_epoch, CASE WHEN task % 2 = 0 THEN 'fresh' END AS labor_class, CASE WHEN task % 5 = 0 THEN 'row-pool' END AS pool FROM task_rows)"""
_ALIVE = """alive AS (SELECT task, attempt, task % 4 AS lease_epoch, 'replay' AS labor_class FROM live)"""
_FACTS = """facts AS (
  SELECT task, attempt, lease_epoch FROM held UNION ALL SELECT task, attempt, lease_epoch FROM alive UNION ALL SELECT task, attempt, lease_epoch FROM graded UNION ALL SELECT task, attempt, lease_epoch FROM witness)"""


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    labor, pool = F.when(F.col("task") % 2 == 0, "fresh"), F.when(F.col("task") % 5 == 0, "row-pool")
    return bridge.task_rows(spark, sf_dir).withColumns({"attempt": F.col("priority"), "lease_epoch": F.col("run") % 7, "labor_class": labor, "pool": pool})


def _alive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.live(spark, sf_dir).withColumns({"lease_epoch": F.col("task") % 4, "labor_class": F.lit("replay")})


def _lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.lanes(_held(spark, sf_dir), _alive(spark, sf_dir), bridge.graded(spark, sf_dir), bridge.witness(spark, sf_dir))


@register("current_lane", with_(WITNESS, TASKS, EVENTS, LIVE, GRADED, _HELD, _ALIVE, _FACTS) + """
SELECT task, attempt AS current_attempt, max(lease_epoch) AS current_lease FROM facts
WHERE (task, attempt) IN (SELECT (task, max(attempt)) FROM facts GROUP BY task) GROUP BY task, attempt""")
def current_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over rows, live jobs, events and witnesses, each with its own lease."""
    facts = None
    for df in (_held(spark, sf_dir), _alive(spark, sf_dir), bridge.graded(spark, sf_dir), bridge.witness(spark, sf_dir)):
        one = df.select("task", F.col("attempt").cast("int").alias("attempt"), F.col("lease_epoch").cast("long").alias("lease_epoch"))
        facts = one if facts is None else facts.union(one)
    return ledger.current_lane(facts)


@register("lane_evidence", with_(WITNESS, TASKS, EVENTS, LIVE, GRADED, _HELD, _ALIVE, _FACTS) + """,
e AS (SELECT task, attempt, lease_epoch, count(*) AS n_events, CASE WHEN bool_or(event = 'evidence_fail') THEN 'fail' WHEN bool_or(event = 'evidence_pass') THEN 'pass' END AS evidence, arg_max(event, sequence) AS event,
        min(sequence) FILTER (WHERE event = 'started') AS s, arg_max(ts, sequence) AS last_event_at, arg_max(ts, sequence) FILTER (WHERE event IN ('completed', 'failed', 'preempted', 'witness_emitted')) AS ended FROM graded GROUP BY ALL),
w AS (SELECT task, attempt, lease_epoch, count(*) AS n_witnesses, arg_max(verdict, seq) AS verdict, arg_max(ts, seq) AS witnessed FROM witness GROUP BY ALL),
l AS (SELECT DISTINCT task, attempt, lease_epoch FROM facts)
SELECT l.task, l.attempt, l.lease_epoch, coalesce(n_events, 0) AS n_events, coalesce(n_witnesses, 0) AS n_witnesses, evidence, e.event, verdict, g.ts AS started_at, last_event_at, coalesce(witnessed, ended) AS terminal_at
FROM l LEFT JOIN e ON e.task = l.task AND e.attempt = l.attempt AND e.lease_epoch IS NOT DISTINCT FROM l.lease_epoch LEFT JOIN w ON w.task = l.task AND w.attempt = l.attempt AND w.lease_epoch = l.lease_epoch LEFT JOIN graded g ON g.sequence = e.s""")
def lane_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lane with its evidence, counts, last event and witness, and times."""
    out = _lanes(spark, sf_dir)
    return out.select("task", "attempt", "lease_epoch", "n_events", "n_witnesses", "evidence", F.col("event.said").alias("event"), F.col("witness.said").alias("verdict"), "started_at", "last_event_at", "terminal_at")


@register("jobs_v2", with_(WITNESS, TASKS, EVENTS, LIVE, PARENTS, GRADED, _HELD, _ALIVE, _FACTS) + """,
lane AS (SELECT task, attempt AS a, max(lease_epoch) AS l FROM facts WHERE (task, attempt) IN (SELECT (task, max(attempt)) FROM facts GROUP BY task) GROUP BY task, attempt),
here AS (SELECT g.*, attempt = a AND (l IS NULL OR lease_epoch = l) AS now FROM graded g JOIN lane USING (task)),
e AS (SELECT task, coalesce(arg_max(event, sequence) FILTER (WHERE now), arg_max(event, sequence)) AS event, coalesce(max(sequence) FILTER (WHERE now), max(sequence)) AS sequence,
        CASE WHEN bool_or(event = 'evidence_fail') FILTER (WHERE now) THEN 'fail' WHEN bool_or(event = 'evidence_pass') FILTER (WHERE now) THEN 'pass' END AS evidence FROM here GROUP BY task),
w AS (SELECT task, arg_max(verdict, (attempt, lease_epoch, seq)) AS verdict, arg_max(labor_class, (attempt, lease_epoch, seq)) AS latest, arg_max(labor_class, seq) FILTER (WHERE attempt = a AND (l IS NULL OR lease_epoch = l)) AS labor FROM witness JOIN lane USING (task) GROUP BY task),
kids AS (SELECT parent AS task, count(*) AS n FROM parents GROUP BY parent),
every AS (SELECT DISTINCT task FROM facts)
SELECT every.task, h.run, h.priority, a AS current_attempt, l AS current_lease, e.event, evidence, verdict,
       coalesce(w.labor, CASE WHEN v.attempt = a AND v.lease_epoch IS NOT DISTINCT FROM l THEN v.labor_class END, g.labor_class, CASE WHEN h.attempt = a AND h.lease_epoch IS NOT DISTINCT FROM l THEN h.labor_class END, v.labor_class, latest) AS labor_class,
       coalesce(h.pool, g.pool) AS pool, coalesce(kids.n, 0) AS n_children
FROM every LEFT JOIN lane USING (task) LEFT JOIN held h USING (task) LEFT JOIN alive v USING (task) LEFT JOIN e USING (task) LEFT JOIN graded g ON g.sequence = e.sequence LEFT JOIN w USING (task) LEFT JOIN kids USING (task)""")
def jobs_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2, J14, W4 to W6, W8, A21."""
    return runs.job_summaries(_lanes(spark, sf_dir), bridge.task_rows(spark, sf_dir), bridge.parents(spark, sf_dir))


_VERDICT = """v AS (SELECT task, arg_max(verdict, (seq, ledger_id)) AS verdict FROM judged GROUP BY task)"""
_STATES = """,
r AS (SELECT t.*, verdict, coalesce(verdict IN ('pass', 'reused', 'substituted'), false) AS done, coalesce(verdict IN ('failed', 'clean-exit-no-artifact'), false) AS failed, state = 'recurring' AS current, task % 3 = 0 AS frontier, bool_or(state = 'recurring') OVER (PARTITION BY run) AS active FROM task_rows t LEFT JOIN v USING (task)),
b AS (SELECT p.task, string_agg(p.parent::VARCHAR, ',' ORDER BY p.parent) AS blocked_by FROM parents p JOIN r ON r.task = p.parent WHERE NOT done GROUP BY p.task),
s AS (SELECT run, r.task, CASE WHEN done THEN 'done' WHEN failed THEN 'blocked' WHEN current AND priority < 3 THEN 'running' WHEN current OR frontier AND active THEN 'pending' WHEN frontier THEN 'blocked' WHEN blocked_by IS NULL THEN 'pending' ELSE 'blocked' END AS status,
             done AND r.task % 2 = 0 AS advanced, blocked_by, CASE WHEN failed THEN 'gate' END AS stage FROM r LEFT JOIN b USING (task))
"""


def _view(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Task states, runs and anomalies: a run is a customer's orders, each of which needs the one before it."""
    verdicts = bridge.judged(spark, sf_dir).groupBy("task").agg(F.max_by("verdict", F.struct("seq", "ledger_id")).alias("verdict"))
    rows = bridge.task_rows(spark, sf_dir).join(verdicts, "task", "left")
    passed, failed, current = P.passing(F.col("verdict")), F.col("verdict").isin("failed", "clean-exit-no-artifact"), F.col("state") == "recurring"
    done = rows.filter(passed).withColumn("advanced", F.col("task") % 2 == 0)
    needs = bridge.parents(spark, sf_dir).join(rows.select("task", "run"), "task").select("run", "task", F.col("parent").alias("needs"))
    known = rows.groupBy("run").agg(F.max(current).alias("active"), F.max(failed).alias("failed"), F.min(F.coalesce(passed, F.lit(False))).alias("nodes_passed")).withColumn("superseded", F.col("run") % 29 == 0)
    states = runs.task_states(
        rows, done, rows.filter(failed).withColumn("stage", F.lit("gate")), rows.filter(current).withColumn("state", F.when(F.col("priority") < 3, "running").otherwise("queued")), rows.filter("task % 3 = 0"), needs, known
    )
    return states, known.withColumn("failed", F.col("failed") & (F.col("run") % 2 == 0)), rows.filter("task % 13 = 0").select("run", "task")


@register("run_tasks", with_(WITNESS, TASKS, PARENTS, JUDGED, _VERDICT) + _STATES + "SELECT run, task, status, advanced, blocked_by, stage FROM s")
def run_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order needs the one before it; what was reused or substituted is done as well."""
    return _view(spark, sf_dir)[0].withColumn("blocked_by", F.array_join("blocked_by", ","))


@register("run_state", with_(WITNESS, TASKS, PARENTS, JUDGED, _VERDICT) + _STATES + """,
c AS (SELECT run, count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'running') AS running, count(*) FILTER (WHERE status = 'blocked') AS blocked, count(*) FILTER (WHERE status = 'pending') AS pending,
             bool_or(advanced) AS advanced, bool_or(task % 13 = 0 AND status <> 'done') AS odd FROM s GROUP BY run),
k AS (SELECT run, any_value(active) AS active, bool_or(failed) AND run % 2 = 0 AS failed FROM r GROUP BY run)
SELECT run, done, running, blocked, pending, CASE WHEN run % 29 = 0 THEN 'superseded' WHEN active THEN 'running' WHEN failed OR odd THEN 'needs-attention' WHEN running + blocked + pending = 0 THEN 'complete' WHEN advanced THEN 'advanced' ELSE 'idle' END AS state FROM c JOIN k USING (run)""")
def run_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of the cases is the rule; failures of runs of odd number are forgiven here."""
    return runs.run_states(*_view(spark, sf_dir))


@register("standup_digest", with_(WITNESS, TASKS, EVENTS, GRADED, JUDGED) + """,
w AS (SELECT task, arg_max(verdict, (seq, ledger_id)) AS verdict, arg_max(attempt, (seq, ledger_id)) AS attempt, arg_max(labor_class, (seq, ledger_id)) AS labor FROM judged GROUP BY task),
g AS (SELECT task, arg_max(event, (epoch_us(ts), sequence)) AS journal, max(attempt) AS last_attempt FROM graded GROUP BY task),
j AS (SELECT task, state, journal, verdict, labor, coalesce(attempt, last_attempt) AS attempt FROM task_rows FULL JOIN g USING (task) FULL JOIN w USING (task)),
b AS (SELECT *, (task, attempt) IN (SELECT (task, attempt) FROM graded WHERE event = 'evidence_fail') AS bad FROM j),
spent AS (SELECT task, sum(gpu_seconds) AS gpu FROM judged WHERE labor_class = 'fresh' AND verdict NOT IN ('preempted', 'cancelled', 'clean-exit-no-artifact', 'substituted') GROUP BY task)
SELECT task % 10 AS digest, CASE WHEN verdict IS NOT NULL THEN CASE WHEN verdict = 'cancelled' THEN 'cancelled' WHEN verdict = 'clean-exit-no-artifact' OR bad THEN 'gate_fails' ELSE 'completed' END
  WHEN journal IN ('completed', 'failed', 'evidence_pass', 'evidence_fail', 'witness_emitted') THEN CASE WHEN bad THEN 'gate_fails' ELSE 'completed' END WHEN journal IS NOT NULL OR state IN ('pending', 'recurring') THEN 'in_flight' END AS bucket,
  count(*) AS entries, count(*) FILTER (WHERE labor = 'reused') AS reused, round(coalesce(sum(gpu), 0), 2) AS gpu_seconds
FROM b LEFT JOIN spent USING (task) GROUP BY ALL""")
def standup_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four buckets, by verdict, evidence and journal."""
    witness = bridge.judged(spark, sf_dir)
    jobs = runs.standup_jobs(bridge.task_rows(spark, sf_dir), bridge.graded(spark, sf_dir), witness)
    spent = witness.filter(P.canonical_gpu(F.col("verdict"), F.col("labor_class"))).groupBy("task").agg(F.sum("gpu_seconds").alias("gpu"))
    rows = jobs.join(spent, "task", "left").groupBy((F.col("task") % 10).alias("digest"), "bucket")
    return rows.agg(F.count("*").alias("entries"), F.count_if(F.col("labor_class") == "reused").alias("reused"), F.round(F.coalesce(F.sum("gpu"), F.lit(0.0)), 2).alias("gpu_seconds"))


@register("run_failures", with_(WITNESS, TASKS, EVENTS, LIVE, MEMBERS, GRADED, JUDGED) + """,
live_ AS (SELECT task, attempt, task % 4 AS lease_epoch FROM live),
f AS (SELECT task, attempt, lease_epoch FROM live_ UNION ALL SELECT task, attempt, lease_epoch FROM graded UNION ALL SELECT task, attempt, lease_epoch FROM judged),
now AS (SELECT task, attempt, max(lease_epoch) AS lease FROM f WHERE (task, attempt) IN (SELECT (task, max(attempt)) FROM f GROUP BY task) GROUP BY task, attempt),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY attempt DESC, lease_epoch DESC, seq DESC) AS k FROM judged) WHERE k = 1),
bad AS (SELECT w.task, verdict, w.attempt, lease, ts FROM w JOIN now USING (task) WHERE w.attempt = now.attempt AND verdict NOT IN ('pass', 'reused', 'substituted')),
t AS (SELECT b.task, max(sequence) AS s FROM graded g JOIN bad b ON b.task = g.task AND b.attempt = g.attempt AND (lease IS NULL OR lease = g.lease_epoch) WHERE event = 'failed' GROUP BY b.task),
e AS (SELECT b.task, max(seq) AS s FROM judged j JOIN bad b ON b.task = j.task AND b.attempt = j.attempt AND (lease IS NULL OR lease = j.lease_epoch) GROUP BY b.task)
SELECT run, task, verdict, attempt, lease AS lease_epoch, ts AS failed_at, 'oh ' || t.s AS stderr_tail, t.s % 2 = 0 AS stderr_truncated, CASE WHEN e.s % 3 = 0 THEN 'lost ' || e.s END AS error
FROM (SELECT DISTINCT run, task FROM membership) JOIN bad USING (task) LEFT JOIN t USING (task) LEFT JOIN e USING (task)""")
def run_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current attempt's failures, with the tail of its messages and its error."""
    events = bridge.graded(spark, sf_dir).withColumns({"stderr_tail": F.concat(F.lit("oh "), "sequence"), "stderr_truncated": F.col("sequence") % 2 == 0})
    witness = bridge.judged(spark, sf_dir).withColumn("error", F.when(F.col("seq") % 3 == 0, F.concat(F.lit("lost "), "seq")))
    lanes = runs.lanes(_held(spark, sf_dir).limit(0), _alive(spark, sf_dir), events, witness)
    return runs.failures(bridge.membership(spark, sf_dir), lanes, events, witness)
