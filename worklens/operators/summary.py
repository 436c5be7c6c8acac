"""Job summaries: every anchor with its row, live state, current event, witness and children."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklens.functions import predicates as P


def anchors(sources: dict[str, DataFrame]) -> DataFrame:
    """Every task that any source names, with a flag in_<name> for each; one shuffle for all of them."""
    marked = None
    for name, df in sources.items():
        rows = df.select("task", *[F.lit(name == other).alias(f"in_{other}") for other in sources])
        marked = rows if marked is None else marked.unionByName(rows)
    return marked.groupBy("task").agg(*[F.max(f"in_{name}").alias(f"in_{name}") for name in sources])


def children(parents: DataFrame) -> DataFrame:
    """(parent, children) with distinct children in order."""
    return parents.groupBy("parent").agg(F.sort_array(F.collect_set("task")).alias("children"))


def durable_parents(rows: DataFrame, lifecycle: DataFrame, continued: DataFrame) -> DataFrame:
    """(task, parent, source): the row's parent, else the lifecycle's, else the task that a dedup key continues."""
    named = [df.select("task", F.col("parent").alias(f"p{i}")) for i, df in enumerate((rows, lifecycle, continued))]
    out = named[0].join(named[1], "task", "full_outer").join(named[2], "task", "full_outer")
    source = F.when(F.col("p0").isNotNull(), "row").when(F.col("p1").isNotNull(), "lifecycle").otherwise("continuation")
    return out.select("task", F.coalesce("p0", "p1", "p2").alias("parent"), source.alias("source")).filter("parent IS NOT NULL")


def enriched_log(events: DataFrame, rows: DataFrame) -> DataFrame:
    """Journal records with their row's run and state where the journal itself is silent."""
    known = rows.select("task", "run", F.col("state").alias("row_state"))
    return events.join(known, "task", "left").select("sequence", "task", "run", F.coalesce("event", "row_state").alias("event"), F.coalesce("pool", F.concat(F.lit("run-"), F.col("run"))).alias("pool"))


def run_scope(events: DataFrame, members: DataFrame) -> DataFrame:
    """Events whose task belongs to one of the runs."""
    return events.join(members.select("task").distinct(), "task", "left_semi")


def labelled(events: DataFrame, labels: DataFrame) -> DataFrame:
    """The first label of each task on its events; (task, line, label) may name a task several times."""
    first = labels.groupBy("task").agg(F.min_by("label", F.struct("line", "label")).alias("label"))
    return events.join(first, "task", "left")


def pool_signals(jobs: DataFrame, pools: DataFrame) -> DataFrame:
    """(task, signals): what each of a job's pools allows, by pool; pools nobody configured say `unknown`."""
    wanted = jobs.select("task", F.explode(F.array_distinct("pools")).alias("pool"))
    signal = F.concat_ws("=", F.col("pool"), F.coalesce("allows", F.lit("unknown")))
    return wanted.join(pools.select("pool", "allows"), "pool", "left").groupBy("task").agg(F.sort_array(F.collect_list(signal)).alias("signals"))


def live_overlay(jobs: DataFrame, live: DataFrame) -> DataFrame:
    """A live job's state over the projected one."""
    now = live.select("task", F.col("state").alias("live_state"))
    return jobs.join(now, "task", "left").withColumn("state", F.coalesce("live_state", "state")).drop("live_state")


def expected_attempts(rows: DataFrame, witness: DataFrame) -> DataFrame:
    """(task, expected, source): the row's attempt, else the latest witness's, else unknown; the advisory ledger never counts."""
    latest = witness.groupBy("task").agg(F.max("attempt").alias("witnessed"))
    source = F.when(F.col("attempt").isNotNull(), "row").when(F.col("witnessed").isNotNull(), "witness").otherwise("unknown")
    return rows.select("task", "attempt").join(latest, "task", "left").select("task", F.coalesce("attempt", "witnessed").alias("expected"), source.alias("source"))


def touched_runs(rows: DataFrame, members: DataFrame, tasks: DataFrame) -> DataFrame:
    """U4: runs that hold one of the tasks, by row or by membership."""
    both = rows.select("run", "task").union(members.select("run", "task"))
    return both.join(tasks.select("task").distinct(), "task", "left_semi").select("run").distinct()


def remaining_budgets(events: DataFrame, budgets: DataFrame, now) -> DataFrame:
    """Seconds since each running task started, and what its budget leaves, which may be negative."""
    began = F.max_by("ts", F.when(F.col("event") == "started", F.col("sequence")))
    last = events.groupBy("task").agg(began.alias("started_at"), F.max_by("event", "sequence").alias("event"), F.count_if(F.col("event") == "started").alias("n"))
    running = last.filter((F.col("n") > 0) & ~P.terminal(F.col("event")))
    elapsed = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1000000)
    out = running.join(budgets.select("task", "budget"), "task", "left").withColumn("elapsed", elapsed)
    return out.select("task", "elapsed", F.floor(F.col("budget") - F.col("elapsed")).alias("remaining"))
