"""Queries for rebuilt views, finished leases and patterns as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worklens.operators import paths, reconcile
from worklens.plans import register, table
from worklens.plans.sql import PATHS, TASKS, with_
from worklens.sources import bridge


@register("view_differences", with_(TASKS) + """,
r AS (SELECT run, count(*) AS n, arg_min(state, task) AS state FROM task_rows GROUP BY run)
SELECT run, CASE run % 5 WHEN 1 THEN '/tasks/0/state' WHEN 2 THEN '/tasks/length' WHEN 3 THEN '/budget' WHEN 4 THEN '/snapshot/rows' END AS path,
       CASE run % 5 WHEN 1 THEN '"' || state || '"' WHEN 3 THEN '5' WHEN 4 THEN n::VARCHAR END AS rebuilt, CASE run % 5 WHEN 1 THEN '"lost"' WHEN 4 THEN (n + 1)::VARCHAR END AS live
FROM r WHERE run % 5 <> 0""")
def view_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views of runs rebuilt and live; a fifth differs in what is volatile only."""
    tasks = bridge.task_rows(spark, sf_dir).groupBy("run").agg(F.sort_array(F.collect_list(F.struct("task", "state"))).alias("tasks"))
    kind, n = F.col("run") % 5, F.size("tasks")
    first = F.when(kind == 1, F.concat(F.array(F.struct(F.get("tasks", F.lit(0))["task"].alias("task"), F.lit("lost").alias("state"))), F.slice("tasks", F.lit(2), n))).when(kind == 2, F.slice("tasks", F.lit(1), n - 1)).otherwise(F.col("tasks"))
    view = lambda at, rows, budget, tasks: F.to_json(F.struct("run", budget.alias("budget"), F.struct(F.lit(at).alias("createdAt"), rows.alias("rows")).alias("snapshot"), tasks.alias("tasks"), F.array(F.struct((F.col("run") % 7 + F.lit(len(at))).alias("elapsedSeconds"))).alias("currentNodes")))
    rebuilt = tasks.select("run", view("now", n, F.lit(5), F.col("tasks")).alias("view"))
    live = tasks.select("run", view("then", F.when(kind == 4, n + 1).otherwise(n), F.when(kind != 3, 5), first).alias("view"))
    return reconcile.first_differences(rebuilt, live, "run", ("/snapshot/createdAt", "/currentNodes/*/elapsedSeconds"))


@register("lease_outcomes", with_(TASKS) + """,
t AS (SELECT run AS campaign, task, task % 4 = 0 AS checkpoint, CASE WHEN task % 4 = 0 THEN task % 23 <> 0 ELSE task % 53 <> 0 END AS done FROM task_rows),
b AS (SELECT campaign, count(*) FILTER (WHERE NOT done) AS outstanding, max(task) FILTER (WHERE checkpoint) AS gate FROM t GROUP BY campaign),
r AS (SELECT *, CASE WHEN campaign % 11 = 0 THEN 'running' WHEN outstanding > 0 THEN 'outstanding' WHEN gate IS NULL THEN 'no-gate' WHEN campaign % 13 = 0 THEN 'no-head' WHEN gate % 3 = 0 THEN 'not-proved' ELSE 'proved' END AS reason FROM b)
SELECT campaign, CASE WHEN reason = 'proved' THEN 'lapse' ELSE 'renew' END AS outcome, reason, outstanding, CASE WHEN reason = 'proved' THEN 'refs/state/checkpoint/t' || gate || '-' || repeat('0', 64) || '/' || left(sha256(campaign::VARCHAR), 40) END AS proof FROM r""")
def lease_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer is a campaign, each fourth order a checkpoint; some tasks have no completion, some checkpoints proved another head."""
    rows = bridge.task_rows(spark, sf_dir).select(F.col("run").alias("campaign"), F.col("task").alias("place"), F.concat(F.lit("t"), "task").alias("task"), (F.col("task") % 4 == 0).alias("checkpoint"))
    head = F.left(F.sha2(F.col("campaign").cast("string"), 256), F.lit(40))
    leases = rows.select("campaign").distinct().select("campaign", F.when(F.col("campaign") % 11 == 0, 2).otherwise(0).alias("live_nodes"), F.when(F.col("campaign") % 13 == 0, "main").otherwise(head).alias("published_head"))
    proved = F.when(F.col("place") % 3 == 0, F.lit("f" * 40)).otherwise(head)
    reference = F.when(F.col("checkpoint"), F.concat(F.lit("refs/state/checkpoint/"), "task", F.lit("-" + "0" * 64 + "/"), proved)).otherwise(F.concat(F.lit("refs/state/merge/"), "task", F.when(F.col("place") % 2 == 0, "-" + "1" * 16).otherwise("")))
    done = F.when(F.col("checkpoint"), F.col("place") % 23 != 0).otherwise(F.col("place") % 53 != 0)
    return reconcile.lease_outcomes(leases, rows, rows.filter(done).select("campaign", reference.alias("reference"), proved.alias("target")), "refs/state")


@register("forbidden_by_table", with_(PATHS) + """,
g AS (SELECT s_suppkey AS s, CASE s_suppkey % 3 WHEN 0 THEN 'en/' || s_suppkey || '*' WHEN 1 THEN '**/' || s_suppkey ELSE s_suppkey::VARCHAR END AS "glob" FROM supplier),
p AS (SELECT DISTINCT path FROM paths)
SELECT path, "glob" FROM p JOIN g ON CASE s % 3 WHEN 0 THEN regexp_matches(path, '^en/' || s || '[^/]*$') WHEN 1 THEN path = s::VARCHAR OR ends_with(path, '/' || s) ELSE list_contains(string_split(path, '/'), s::VARCHAR) END""")
def forbidden_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern for each supplier, as a table."""
    s = F.col("s_suppkey")
    glob = F.when(s % 3 == 0, F.concat(F.lit("en/"), s, F.lit("*"))).when(s % 3 == 1, F.concat(F.lit("**/"), s)).otherwise(s.cast("string"))
    return paths.forbidden_by(bridge.paths(spark, sf_dir), table(spark, sf_dir, "supplier").select(glob.alias("glob")))
