"""Campaigns: the passes of one issue, which of them came after which, and what they come to together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklens.functions import predicates as P
from worklens.operators import graphs

FACTS = ["run", "issue", "observation", "registration", "parent"]


def run_facts(rows: DataFrame, witness: DataFrame, parents: DataFrame) -> DataFrame:
    """FACTS of each campaign run, from its row's evidence, else from that of a witness, which knows no parent of its own.

    rows (run, issue, observation, registration, parent) and witness (the same
    without parent); blank issues and observations are no evidence. A parent that
    the row lacks comes from parents (task, parent).
    """
    clean = lambda c: F.when(F.trim(c) != "", F.trim(c))
    texts = {c: clean(c) for c in ("issue", "observation", "registration")}
    mine = rows.withColumns(texts).select(*FACTS, F.lit(0).alias("source"))
    theirs = witness.withColumns(texts).withColumn("parent", F.lit(None).cast(rows.schema["parent"].dataType)).select(*FACTS, F.lit(1).alias("source"))
    both = mine.union(theirs).filter("issue IS NOT NULL AND observation IS NOT NULL")
    first = both.groupBy("run").agg(F.min_by(F.struct(*FACTS[1:]), F.struct("source", "issue", "observation")).alias("x")).select("run", "x.*")
    known = parents.select(F.col("task").alias("run"), F.col("parent").alias("__parent"))
    return first.join(known, "run", "left").withColumn("parent", F.coalesce("parent", "__parent")).drop("__parent")


def precedes(facts: DataFrame, parents: DataFrame, members: DataFrame) -> DataFrame:
    """(ancestor, successor): going up from the successor's parent one meets the ancestor's root or a member of it.

    parents (task, parent) are followed however far; members (run, task).
    """
    starts = facts.filter("parent IS NOT NULL").select(F.col("run").alias("name"), F.col("parent").alias("node"))
    above = graphs.reach(starts, parents.select(F.col("task").alias("node"), F.col("parent").alias("to")))
    holders = members.join(facts.select("run"), "run").select("run", F.col("task").alias("node")).union(facts.select("run", F.col("run").alias("node"))).distinct()
    met = above.join(holders, "node").select(F.col("run").alias("ancestor"), F.col("name").alias("successor"))
    return met.filter("ancestor <> successor").distinct()


def depths(facts: DataFrame, before: DataFrame) -> DataFrame:
    """facts with depth: how many campaign runs precede each."""
    number = before.groupBy(F.col("successor").alias("run")).agg(F.count("*").alias("depth"))
    return facts.join(number, "run", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))


def supersessions(facts: DataFrame, before: DataFrame, states: DataFrame) -> DataFrame:
    """(run, latest, observation) for runs that don't run any more and have a later pass of the same issue and a compatible registration."""
    deep = depths(facts, before)
    now = deep.join(states.filter("state <> 'running'").select("run"), "run").select("run", "issue", "registration")
    later = deep.select(F.col("run").alias("latest"), F.col("issue").alias("__issue"), F.col("registration").alias("__registration"), "observation", "depth")
    pairs = before.join(now, before["ancestor"] == now["run"]).join(later, before["successor"] == later["latest"])
    pairs = pairs.filter((F.col("issue") == F.col("__issue")) & (F.col("registration").isNull() | P.compatible(F.col("__registration"), F.col("registration"))))
    return pairs.groupBy("run").agg(F.max_by(F.struct("latest", "observation"), F.struct("depth", "latest")).alias("x")).select("run", "x.latest", "x.observation")


def chains(facts: DataFrame, before: DataFrame) -> DataFrame:
    """(issue, latest, run, depth): the latest pass of each issue, of greatest depth, then id, and the passes that precede it."""
    deep = depths(facts, before)
    last = deep.groupBy("issue").agg(F.max(F.struct("depth", "run"))["run"].alias("latest"))
    mine = deep.join(last, "issue")
    ahead = before.select(F.col("ancestor").alias("run"), F.col("successor").alias("latest"), F.lit(True).alias("__before"))
    return mine.join(ahead, ["run", "latest"], "left").filter((F.col("run") == F.col("latest")) | F.col("__before")).select("issue", "latest", "run", "depth")


def chain_members(chain: DataFrame, members: DataFrame) -> DataFrame:
    """(issue, latest, task): every task of a chain once, whichever passes hold it."""
    return chain.join(members.select("run", "task"), "run").select("issue", "latest", "task").distinct()


def digest(facts: DataFrame, chain: DataFrame, members: DataFrame, attempts: DataFrame) -> DataFrame:
    """One row an issue: passes, tasks, the last attempts' verdicts and how many tasks were tried again.

    attempts (task, attempt, verdict); a task's greatest attempt counts.
    """
    last = attempts.groupBy("task").agg(F.max_by("verdict", "attempt").alias("verdict"), F.max("attempt").alias("attempt"))
    tasks = chain_members(chain, members).join(last, "task", "left").groupBy("issue", "latest").agg(
        F.count("*").alias("tasks"), F.count_if(P.passing(F.col("verdict"))).alias("passed"), F.count_if(F.col("verdict") == "failed").alias("failed"),
        F.count_if(F.col("verdict").isNull()).alias("unknown"), F.count_if(F.col("attempt") > 1).alias("retried"),
    )
    passes = chain.groupBy("issue").agg(F.count("*").alias("passes"))
    said = facts.select(F.col("run").alias("latest"), "observation")
    return tasks.join(passes, "issue").join(said, "latest")


def visible_standup(entries: DataFrame, archived: DataFrame, witness: DataFrame, include_archived: bool = False) -> DataFrame:
    """Entries (digest, task, run, bucket, verdict) by digest and bucket, those of archived creating runs hidden and counted.

    What is reused and spent is summed again over what shows: an entry is reused
    if the witness of greatest seq with the entry's verdict says `reused`; its
    seconds are those of canonical records.
    """
    shown = entries.join(archived.select("run", F.lit(True).alias("__archived")), "run", "left")
    hidden = F.lit(False) if include_archived else F.coalesce("__archived", F.lit(False))
    seen = witness.groupBy("task", "verdict").agg(F.max_by("labor_class", "seq").alias("__labor"))
    spent = witness.filter(P.canonical_gpu(F.col("verdict"), F.col("labor_class"))).groupBy("task").agg(F.sum("gpu_seconds").alias("__spent"))
    rows = shown.withColumn("__hidden", hidden).join(seen, ["task", "verdict"], "left").join(spent, "task", "left")
    open_ = ~F.col("__hidden")
    return rows.groupBy("digest", "bucket").agg(
        F.count_if(open_).alias("entries"), F.count_if("__hidden").alias("archived_hidden"), F.count_if(open_ & (F.col("verdict") == "reused") & (F.col("__labor") == "reused")).alias("reused"),
        F.round(F.coalesce(F.sum(F.when(open_, F.col("__spent"))), F.lit(0.0)), 2).alias("gpu_seconds"),
    )


def eligible(observations: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates (issue, observation, ...) that an observation asked for names; an issue without one keeps all."""
    asked = observations.filter("observation IS NOT NULL")
    named = candidates.join(asked.select("issue", "observation"), ["issue", "observation"], "left_semi")
    return named.union(candidates.join(asked.select("issue"), "issue", "left_anti").select(*named.columns))


