"""Queries for job summaries, logs and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from worklens.functions import predicates as P
from worklens.operators import ledger, summary, usage
from worklens.plans import longs, register
from worklens.plans.sql import EVENTS, LIVE, MEMBERS, PARENTS, POOLS, TASKS, USAGE, WITNESS, with_
from worklens.sources import bridge


@register("anchors", with_(WITNESS, TASKS, EVENTS, LIVE) + """
SELECT task, bool_or(s = 'rows') AS in_rows, bool_or(s = 'live') AS in_live, bool_or(s = 'lifecycle') AS in_lifecycle, bool_or(s = 'witness') AS in_witness FROM (
  SELECT task, 'rows' AS s FROM task_rows UNION ALL SELECT task, 'live' FROM live UNION ALL SELECT task, 'lifecycle' FROM lifecycle UNION ALL SELECT task, 'witness' FROM witness) GROUP BY task""")
def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U1."""
    return summary.anchors({"rows": bridge.task_rows(spark, sf_dir), "live": bridge.live(spark, sf_dir), "lifecycle": bridge.lifecycle(spark, sf_dir), "witness": bridge.witness(spark, sf_dir)})


@register("child_lists", with_(TASKS, PARENTS) + "SELECT parent, string_agg(task::VARCHAR, ',' ORDER BY task) AS children FROM parents GROUP BY parent")
def child_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J14."""
    return summary.children(bridge.parents(spark, sf_dir)).withColumn("children", F.array_join("children", ","))


_CONTINUED = """,
by_row AS (SELECT task, parent FROM parents WHERE task % 3 = 0),
by_event AS (SELECT task, min(sequence) AS parent FROM lifecycle WHERE event = 'enqueued' GROUP BY task),
by_key AS (SELECT task, min(before) AS parent FROM (SELECT task, lag(task) OVER (PARTITION BY dedup_key ORDER BY ts, task, seq) AS before FROM witness) WHERE before <> task GROUP BY task)
"""


@register("durable_parents", with_(WITNESS, TASKS, EVENTS, PARENTS) + _CONTINUED + """
SELECT task, coalesce(r.parent, e.parent, k.parent) AS parent, CASE WHEN r.parent IS NOT NULL THEN 'row' WHEN e.parent IS NOT NULL THEN 'lifecycle' ELSE 'continuation' END AS source
FROM by_row r FULL JOIN by_event e USING (task) FULL JOIN by_key k USING (task)""")
def durable_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J13."""
    enqueued = bridge.lifecycle(spark, sf_dir).filter("event = 'enqueued'").groupBy("task").agg(F.min("sequence").alias("parent"))
    before = F.lag("task").over(Window.partitionBy("dedup_key").orderBy("ts", "task", "seq"))
    continued = bridge.witness(spark, sf_dir).select("task", before.alias("before")).filter("before <> task").groupBy("task").agg(F.min("before").alias("parent"))
    return summary.durable_parents(bridge.parents(spark, sf_dir).filter("task % 3 = 0"), enqueued, continued)


@register("enriched_log", with_(TASKS, EVENTS) + """
SELECT sequence, task, run, coalesce(event, state) AS event, coalesce(CASE WHEN context_tokens > 10 THEN pool END, 'run-' || run) AS pool FROM lifecycle LEFT JOIN task_rows USING (task)""")
def enriched_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3."""
    events = bridge.lifecycle(spark, sf_dir).withColumn("pool", F.when(F.col("context_tokens") > 10, F.col("pool")))
    return summary.enriched_log(events, bridge.task_rows(spark, sf_dir))


@register("run_scope_events", with_(TASKS, EVENTS, MEMBERS) + "SELECT sequence, task, event FROM lifecycle WHERE task IN (SELECT task FROM membership WHERE run % 5 = 0)")
def run_scope_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5."""
    return summary.run_scope(bridge.lifecycle(spark, sf_dir), bridge.membership(spark, sf_dir).filter("run % 5 = 0")).select("sequence", "task", "event")


@register("labelled_events", with_(TASKS, EVENTS, MEMBERS) + """
SELECT sequence, task, label FROM lifecycle LEFT JOIN (SELECT task, arg_min('node-' || run, (line, 'node-' || run)) AS label FROM membership GROUP BY task) USING (task)""")
def labelled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4."""
    labels = bridge.membership(spark, sf_dir).select("task", "line", F.concat(F.lit("node-"), F.col("run")).alias("label"))
    return summary.labelled(bridge.lifecycle(spark, sf_dir), labels).select("sequence", "task", "label")


@register("pool_signals", with_(TASKS, POOLS) + """,
wanted AS (SELECT DISTINCT task, unnest(['pool-' || (task % 9), 'pool-' || (run % 9)]) AS pool FROM task_rows)
SELECT task, string_agg(pool || '=' || CASE WHEN capacity IS NULL THEN 'unknown' WHEN capacity >= 3000 THEN 'GO' ELSE 'SLOW' END, ',' ORDER BY pool) AS signals FROM wanted LEFT JOIN pools USING (pool) GROUP BY task""")
def pool_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J23."""
    jobs = bridge.task_rows(spark, sf_dir).select("task", F.array(*[F.concat(F.lit("pool-"), F.col(c) % 9) for c in ("task", "run")]).alias("pools"))
    pools = bridge.pools(spark, sf_dir).withColumn("allows", F.when(F.col("capacity") >= 3000, "GO").otherwise("SLOW"))
    return summary.pool_signals(jobs, pools).withColumn("signals", F.array_join("signals", ","))


@register("live_jobs", with_(TASKS, EVENTS, LIVE) + "SELECT task, coalesce(l.state, r.state) AS state FROM task_rows r LEFT JOIN live l USING (task)")
def live_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J26."""
    return summary.live_overlay(bridge.task_rows(spark, sf_dir).select("task", "state"), bridge.live(spark, sf_dir))


@register("expected_attempts", with_(WITNESS, TASKS) + """
SELECT task, coalesce(CASE WHEN task % 4 = 0 THEN priority END, witnessed) AS expected, CASE WHEN task % 4 = 0 THEN 'row' WHEN witnessed IS NOT NULL THEN 'witness' ELSE 'unknown' END AS source
FROM task_rows LEFT JOIN (SELECT task, max(attempt) AS witnessed FROM witness GROUP BY task) USING (task)""")
def expected_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11, R6."""
    rows = bridge.task_rows(spark, sf_dir).select("task", F.when(F.col("task") % 4 == 0, F.col("priority")).alias("attempt"))
    return summary.expected_attempts(rows, bridge.witness(spark, sf_dir))


@register("touched_run_usage", with_(WITNESS, USAGE, TASKS, MEMBERS) + """,
t AS (SELECT DISTINCT task FROM witness WHERE ts >= TIMESTAMP '2000-01-01'),
touched AS (SELECT run FROM task_rows JOIN t USING (task) UNION SELECT run FROM membership JOIN t USING (task)),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task, attempt ORDER BY seq DESC, ledger_id DESC) AS n FROM attestations) WHERE n = 1),
sums AS (SELECT run, count(*) AS attempts, sum(output_tokens)::BIGINT AS output_tokens FROM last JOIN task_rows USING (task) GROUP BY run)
SELECT run, coalesce(attempts, 0) AS attempts, output_tokens FROM touched LEFT JOIN sums USING (run)""")
def touched_run_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window picks the runs and never narrows what a run sums."""
    rows = bridge.task_rows(spark, sf_dir)
    recent = bridge.witness(spark, sf_dir).filter(P.within(F.col("ts"), F.to_timestamp(F.lit("2000-01-01")), None))
    runs = summary.touched_runs(rows, bridge.membership(spark, sf_dir), recent)
    sums = longs(usage.roll_up(usage.last_attestation(bridge.attestations(spark, sf_dir)).join(rows.select("task", "run"), "task"), "run"))
    return runs.join(sums.select("run", "attempts", "output_tokens"), "run", "left").withColumn("attempts", F.coalesce("attempts", F.lit(0)))


@register("remaining_budgets", with_(TASKS, EVENTS) + """,
s AS (SELECT task, arg_max(ts, sequence) FILTER (WHERE event = 'started') AS started_at, arg_max(event, sequence) AS event FROM lifecycle GROUP BY task),
e AS (SELECT task, ((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(started_at)) // 1000000)::BIGINT AS elapsed FROM s WHERE started_at IS NOT NULL AND event NOT IN ('completed', 'failed'))
SELECT task, elapsed, floor(budget - elapsed)::BIGINT AS remaining FROM e LEFT JOIN task_rows USING (task)""")
def remaining_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A18."""
    return summary.remaining_budgets(bridge.lifecycle(spark, sf_dir), bridge.task_rows(spark, sf_dir), F.to_timestamp(F.lit("2024-02-01")))


@register("sessions_seen", with_(WITNESS, USAGE, TASKS) + "SELECT run, count(DISTINCT session) AS sessions FROM attestations JOIN task_rows USING (task) GROUP BY run")
def sessions_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pairs first, so that a hot run is spread by its sessions."""
    pairs = bridge.attestations(spark, sf_dir).select("task", "session").join(bridge.task_rows(spark, sf_dir).select("task", "run"), "task").select("run", "session").distinct()
    return pairs.groupBy("run").agg(F.count("session").alias("sessions"))


@register("pool_members", with_(TASKS) + "SELECT task, run FROM task_rows WHERE 'pool-3' IN ('pool-' || (task % 9), 'pool-' || (run % 9))")
def pool_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """any of a job's pools."""
    pools = F.array(*[F.concat(F.lit("pool-"), F.col(c) % 9) for c in ("task", "run")])
    return bridge.task_rows(spark, sf_dir).filter(P.in_pool(pools, "pool-3")).select("task", "run")


@register("current_heads", with_(TASKS) + "SELECT run, max(created) AS latest, arg_max(task, (created, task)) AS task FROM task_rows GROUP BY run")
def current_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest task of each run."""
    return ledger.argmax(bridge.task_rows(spark, sf_dir).select("run", "created", "task"), ["run"], "created", "task").select("run", F.col("created").alias("latest"), "task")
