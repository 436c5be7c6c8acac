"""Campaign and stand-up queries, each with the SQL that gives the same rows.

Customers stand for campaign runs, ten for an issue; a run's parent is the last
task of the run before it in the issue, and a run's first task hangs on that too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worklens.operators import campaigns, graphs, usage
from worklens.plans import longs, register, table
from worklens.plans.sql import LINEAGE, MEMBERS, PARENTS, TASKS, USAGE, WITNESS, with_
from worklens.sources import bridge

FACTS = """last_task AS (SELECT run, max(task) AS task, arg_min(task, (created, task)) AS first FROM task_rows GROUP BY run),
facts AS (
  SELECT c_custkey AS run, 'issue-' || (c_custkey // 10) AS issue, 'pass-' || c_custkey AS observation,
         CASE WHEN c_acctbal >= 0 AND c_custkey % 3 <> 0 THEN 'reg-' || (c_custkey % 20 // 10) END AS registration,
         CASE WHEN c_acctbal >= 0 AND c_custkey % 10 <> 0 THEN l.task END AS parent
  FROM customer LEFT JOIN last_task l ON l.run = c_custkey - 1)"""
EDGES = """edges AS (
  SELECT task, parent FROM parents UNION SELECT l.first, f.parent FROM facts f JOIN last_task l USING (run) WHERE f.parent IS NOT NULL)"""
BEFORE = """up AS (SELECT run, parent AS task FROM facts WHERE parent IS NOT NULL UNION SELECT u.run, e.parent FROM up u JOIN edges e USING (task)),
holders AS (SELECT m.run, m.task FROM membership m JOIN facts USING (run) UNION SELECT run, run FROM facts),
before AS (SELECT DISTINCT h.run AS ancestor, u.run AS successor FROM up u JOIN holders h USING (task) WHERE h.run <> u.run),
deep AS (SELECT f.*, (SELECT count(*) FROM before b WHERE b.successor = f.run) AS depth FROM facts f)"""
STATES = """states AS (SELECT run, CASE WHEN bool_or(state = 'recurring') THEN 'running' ELSE 'idle' END AS state FROM task_rows GROUP BY run)"""
CHAIN = """latest AS (SELECT issue, arg_max(run, (depth, run)) AS latest FROM deep GROUP BY issue),
chain AS (SELECT d.issue, latest, run, depth FROM deep d JOIN latest l ON d.issue = l.issue
          WHERE run = latest OR EXISTS (SELECT 1 FROM before b WHERE b.ancestor = run AND b.successor = latest)),
chain_members AS (SELECT DISTINCT issue, latest, task FROM chain JOIN membership USING (run))"""
ALL = (TASKS, MEMBERS, PARENTS, FACTS, EDGES, BEFORE)


def _facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Facts, parents and members."""
    customers, tasks = table(spark, sf_dir, "customer"), bridge.task_rows(spark, sf_dir)
    ends = tasks.groupBy("run").agg(F.max("task").alias("last"), F.min_by("task", F.struct("created", "task")).alias("first"))
    named = customers.select(
        F.col("c_custkey").alias("run"), F.concat(F.lit("issue-"), F.floor(F.col("c_custkey") / 10)).alias("issue"), F.concat(F.lit("pass-"), F.col("c_custkey")).alias("observation"),
        F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("reg-"), F.floor(F.col("c_custkey") % 20 / 10))).alias("registration"), (F.col("c_acctbal") >= 0).alias("has_row"),
    )
    before = ends.select((F.col("run") + 1).alias("run"), F.col("last").alias("parent"))
    rows = named.filter("has_row").join(before, "run", "left").withColumn("parent", F.when(F.col("run") % 10 != 0, F.col("parent")))
    late = named.filter("NOT has_row").withColumn("registration", F.lit(None).cast("string"))
    parents = bridge.parents(spark, sf_dir)
    facts = campaigns.run_facts(rows, late, parents.limit(0).select("task", "parent"))
    first = facts.filter("parent IS NOT NULL").join(ends, "run").select(F.col("first").alias("task"), "parent")
    return facts, parents.union(first), bridge.membership(spark, sf_dir)


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.task_rows(spark, sf_dir).groupBy("run").agg(F.when(F.max(F.col("state") == "recurring"), "running").otherwise("idle").alias("state"))


@register("campaign_runs", with_(TASKS, FACTS) + "SELECT run, issue, observation, registration, parent FROM facts")
def campaign_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row's evidence, else a witness's, which knows neither registration nor parent here."""
    return _facts(spark, sf_dir)[0]


@register("campaign_ancestry", with_(*ALL, recursive=True) + "SELECT ancestor, successor FROM before")
def campaign_ancestry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J17."""
    return campaigns.precedes(*_facts(spark, sf_dir))


@register("campaign_supersession", with_(*ALL, STATES, recursive=True) + """
SELECT n.run, arg_max(l.run, (l.depth, l.run)) AS latest, arg_max(l.observation, (l.depth, l.run)) AS observation
FROM before b JOIN deep n ON n.run = b.ancestor JOIN deep l ON l.run = b.successor JOIN states s ON s.run = n.run
WHERE s.state <> 'running' AND n.issue = l.issue AND (n.registration IS NULL OR l.registration IS NULL OR n.registration = l.registration) GROUP BY n.run""")
def campaign_supersession(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J18, and A16's `superseded`."""
    facts, parents, members = _facts(spark, sf_dir)
    return campaigns.supersessions(facts, campaigns.precedes(facts, parents, members), _states(spark, sf_dir))


@register("campaign_status", with_(WITNESS, USAGE, *ALL, CHAIN, recursive=True) + """,
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task, attempt ORDER BY seq DESC, ledger_id DESC) AS n FROM attestations) WHERE n = 1),
used AS (SELECT issue, count(*) AS attempts, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens FROM chain_members JOIN last USING (task) GROUP BY issue),
runs AS (SELECT issue, latest, string_agg(run::VARCHAR, ',' ORDER BY depth, run) AS flow_runs FROM chain GROUP BY issue, latest),
tasks AS (SELECT issue, count(*) AS tasks FROM chain_members GROUP BY issue)
SELECT issue, latest, flow_runs, coalesce(tasks, 0) AS tasks, coalesce(attempts, 0) AS attempts, input_tokens, output_tokens FROM runs LEFT JOIN tasks USING (issue) LEFT JOIN used USING (issue)""")
def campaign_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usage of the chain's distinct tasks, each counted once."""
    facts, parents, members = _facts(spark, sf_dir)
    chain = campaigns.chains(facts, campaigns.precedes(facts, parents, members))
    tasks = campaigns.chain_members(chain, members)
    last = usage.last_attestation(bridge.attestations(spark, sf_dir))
    used = longs(usage.roll_up(tasks.join(last, "task"), "issue")).select("issue", "attempts", "input_tokens", "output_tokens")
    order = F.sort_array(F.collect_list(F.struct("depth", "run")))
    runs = chain.groupBy("issue", "latest").agg(F.array_join(F.transform(order, lambda x: x["run"].cast("string")), ",").alias("flow_runs"))
    out = runs.join(tasks.groupBy("issue").agg(F.count("*").alias("tasks")), "issue", "left").join(used, "issue", "left")
    return out.withColumns({"tasks": F.coalesce("tasks", F.lit(0)), "attempts": F.coalesce("attempts", F.lit(0))})


@register("campaign_digest", with_(WITNESS, *ALL, CHAIN, recursive=True) + """,
lanes AS (SELECT task, attempt, arg_max(verdict, (seq, ledger_id)) AS verdict FROM witness GROUP BY task, attempt),
last AS (SELECT task, arg_max(verdict, attempt) AS verdict, max(attempt) AS attempt FROM lanes GROUP BY task),
n AS (SELECT issue, count(*) AS passes FROM chain GROUP BY issue)
SELECT m.issue, m.latest, count(*) AS tasks, count(*) FILTER (WHERE verdict IN ('pass', 'reused', 'substituted')) AS passed, count(*) FILTER (WHERE verdict = 'failed') AS failed,
       count(*) FILTER (WHERE verdict IS NULL) AS unknown, count(*) FILTER (WHERE attempt > 1) AS retried, any_value(passes) AS passes, any_value(f.observation) AS observation
FROM chain_members m LEFT JOIN last USING (task) JOIN n ON n.issue = m.issue JOIN facts f ON f.run = m.latest GROUP BY m.issue, m.latest""")
def campaign_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A20."""
    facts, parents, members = _facts(spark, sf_dir)
    chain = campaigns.chains(facts, campaigns.precedes(facts, parents, members))
    lanes = bridge.witness(spark, sf_dir).groupBy("task", "attempt").agg(F.max_by("verdict", F.struct("seq", "ledger_id")).alias("verdict"))
    return campaigns.digest(facts, chain, members, lanes)


@register("eligible_passes", with_(TASKS, FACTS) + """,
asked AS (SELECT issue, arg_min(observation, run) AS observation FROM facts WHERE run // 10 % 2 = 0 GROUP BY issue)
SELECT f.issue, f.observation, f.run FROM facts f LEFT JOIN asked a USING (issue) WHERE a.issue IS NULL OR a.observation = f.observation""")
def eligible_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the issues ask for their first observation."""
    facts = _facts(spark, sf_dir)[0].select("issue", "observation", "run")
    asked = facts.filter(F.floor(F.col("run") / 10) % 2 == 0).groupBy("issue").agg(F.min_by("observation", "run").alias("observation"))
    return campaigns.eligible(asked, facts)


_VERDICTS = """said AS (SELECT *, CASE WHEN verdict = 'pass' AND discount = 0.05 THEN 'reused' ELSE verdict END AS v, CASE WHEN verdict = 'pass' AND discount = 0.05 THEN 'reused' ELSE labor_class END AS l FROM witness),
entry AS (SELECT task, arg_max(v, (seq, ledger_id)) AS verdict FROM said GROUP BY task)"""


@register("visible_standup", with_(WITNESS, TASKS, _VERDICTS) + """,
seen AS (SELECT task, v AS verdict, arg_max(l, seq) AS labor FROM said GROUP BY task, v),
spent AS (SELECT task, sum(gpu_seconds) AS spent FROM said WHERE l = 'fresh' AND v NOT IN ('preempted') GROUP BY task),
e AS (SELECT r.priority AS digest, r.task, run % 5 = 0 AS hidden, verdict, CASE WHEN verdict IN ('pass', 'reused') THEN 'completed' WHEN verdict = 'failed' THEN 'gate_fails' WHEN verdict = 'preempted' THEN 'cancelled' ELSE 'in_flight' END AS bucket
      FROM task_rows r LEFT JOIN entry USING (task))
SELECT digest, bucket, count(*) FILTER (WHERE NOT hidden) AS entries, count(*) FILTER (WHERE hidden) AS archived_hidden,
       count(*) FILTER (WHERE NOT hidden AND verdict = 'reused' AND labor = 'reused') AS reused, round(coalesce(sum(spent) FILTER (WHERE NOT hidden), 0), 2) AS gpu_seconds
FROM e LEFT JOIN seen USING (task, verdict) LEFT JOIN spent USING (task) GROUP BY digest, bucket""")
def visible_standup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A twentieth of what passed was reused here; each fifth run is archived."""
    reused = (F.col("verdict") == "pass") & (F.col("discount") == 0.05)
    said = bridge.witness(spark, sf_dir).withColumns({"labor_class": F.when(reused, "reused").otherwise(F.col("labor_class")), "verdict": F.when(reused, "reused").otherwise(F.col("verdict"))})
    entry = said.groupBy("task").agg(F.max_by("verdict", F.struct("seq", "ledger_id")).alias("verdict"))
    v = F.col("verdict")
    bucket = F.when(v.isin("pass", "reused"), "completed").when(v == "failed", "gate_fails").when(v == "preempted", "cancelled").otherwise("in_flight")
    tasks = bridge.task_rows(spark, sf_dir)
    entries = tasks.join(entry, "task", "left").select(F.col("priority").alias("digest"), "task", "run", bucket.alias("bucket"), "verdict")
    archived = tasks.filter("run % 5 = 0").select("run").distinct()
    return campaigns.visible_standup(entries, archived, said)


@register("checkpoint_deferrals", with_(LINEAGE, "needs AS (SELECT successor AS task, run AS needs FROM lineage)", """
down AS (SELECT run AS checkpoint, run AS task FROM lineage WHERE run % 20 = 3 UNION SELECT d.checkpoint, n.task FROM down d JOIN needs n ON n.needs = d.task)""", """
up AS (SELECT run AS checkpoint, run AS task FROM lineage WHERE run % 20 = 3 UNION SELECT u.checkpoint, n.needs FROM up u JOIN needs n ON n.task = u.task)""", recursive=True) + """
SELECT c.run AS checkpoint, o.run AS task FROM lineage c JOIN lineage o ON c.run // 50 = o.run // 50 AND o.run % 2 = 0
WHERE c.run % 20 = 3 AND NOT EXISTS (SELECT 1 FROM down d WHERE d.checkpoint = c.run AND d.task = o.run) AND NOT EXISTS (SELECT 1 FROM up u WHERE u.checkpoint = c.run AND u.task = o.run)""")
def checkpoint_deferrals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty tasks are a campaign here, those of even number are open."""
    lineage = bridge.lineage(spark, sf_dir)
    campaign = F.floor(F.col("run") / 50).alias("campaign")
    edges = lineage.select(F.col("successor").alias("task"), F.col("run").alias("needs"))
    return graphs.deferrals(edges, lineage.filter("run % 20 = 3").select(F.col("run").alias("checkpoint"), campaign), lineage.filter("run % 2 = 0").select(F.col("run").alias("task"), campaign))
