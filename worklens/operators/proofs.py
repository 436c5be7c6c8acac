"""Proofs, claims and comparisons: which facts back a recorded outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worklens.functions import predicates as P


def attested(witness: DataFrame, attestations: DataFrame) -> DataFrame:
    """(task, attempt, n_attested): attestations of each witnessed lane; a null lease matches every lease of the attempt."""
    lanes = witness.select("task", "attempt", "lease_epoch").distinct()
    exact = attestations.filter("lease_epoch IS NOT NULL").join(lanes, ["task", "attempt", "lease_epoch"]).select("task", "attempt")
    loose = attestations.filter("lease_epoch IS NULL").join(lanes.select("task", "attempt").distinct(), ["task", "attempt"]).select("task", "attempt")
    return exact.union(loose).groupBy("task", "attempt").agg(F.count("*").alias("n_attested"))


def proofs(witness: DataFrame, attestations: DataFrame) -> DataFrame:
    """Each attempt's governing witness, its attestations and what they prove."""
    last = witness.groupBy("task", "attempt").agg(F.max_by(F.struct("verdict", "lease_epoch", "seq"), F.struct("lease_epoch", "seq")).alias("x"))
    last = last.select("task", "attempt", "x.*")
    out = last.join(attested(witness, attestations), ["task", "attempt"], "left").withColumn("n_attested", F.coalesce("n_attested", F.lit(0)))
    status = F.when(~P.passing(F.col("verdict")), "not-passing").when(F.col("n_attested") > 0, "attested").otherwise("witness-only")
    return out.select("task", "attempt", "verdict", "seq", "n_attested", status.alias("status"))


def run_proofs(members: DataFrame, proofs_: DataFrame) -> DataFrame:
    """The proofs of every member of a run under the run's own ordinal; members without any keep a row."""
    ordinal = members.groupBy("run", "task").agg(F.min("line").alias("ordinal"))
    return ordinal.join(proofs_, "task", "left").select("run", "task", "ordinal", "attempt", F.coalesce("status", F.lit("no-witness")).alias("status"))


def dedup_verdict(key: Column, found: Column, evidence: Column, current: Column, declared: Column, witnessed: Column, paths: Column, witnessed_paths: Column) -> Column:
    """Why a dedup key misses, in the ledger's order of questions; null for a hit.

    key is the job's, blank or null for none; evidence tells whether it declares
    any artifact or store path. No current artifact leaves nothing to compare but
    the declared paths.
    """
    return (
        F.when(F.coalesce(F.trim(key), F.lit("")) == "", "no-key")
        .when(~found, "no-prior-pass")
        .when(~evidence, "no-artifact-evidence")
        .when(declared.isNotNull() & ~declared.eqNullSafe(current), "declared-hash-mismatch")
        .when(current.isNotNull() & ~witnessed.eqNullSafe(current), "witness-hash-mismatch")
        .when((F.size(F.coalesce(paths, F.array().cast("array<string>"))) > 0) & ~F.array_sort(F.array_distinct(paths)).eqNullSafe(witnessed_paths), "store-paths-mismatch")
    )


def caveats(rolled: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The names of the rules that hold for each row, and whether none does."""
    named = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    return rolled.withColumn("caveats", named).withColumn("complete", F.size("caveats") == 0)


def compare_summary(compared: DataFrame) -> DataFrame:
    """One row with the number of each status; strict only if everything agrees and something does."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    out = compared.agg(n("agrees"), n("differs"), n("missing"), n("orphan"))
    return out.withColumn("strict", (F.col("agrees") > 0) & (F.col("differs") + F.col("missing") + F.col("orphan") == 0))


def coverage(claims: DataFrame, traces: DataFrame) -> DataFrame:
    """Every claim with the tasks that carry it and the kinds of evidence, untraced ones too."""
    carried = traces.groupBy("claim").agg(F.count("*").alias("n_rows"), F.sort_array(F.collect_set("task")).alias("tasks"), F.sort_array(F.collect_set("evidence")).alias("evidence"))
    return claims.select("claim").join(carried, "claim", "left").withColumn("traced", F.col("n_rows").isNotNull()).withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))


def census(claims: DataFrame, bindings: DataFrame, gates: DataFrame) -> DataFrame:
    """(claim, bound, oracle, fault): what binds each claim, which must be exactly one of bindings (claim, kind, value).

    A check's oracle is its value, a gate's its id and the command of gates
    (gate, command), a human has none. Several are listed in order. Faults: no
    oracle, several, a gate that isn't declared.
    """
    resolved = bindings.join(gates.select(F.col("gate").alias("value"), "command", F.lit(True).alias("declared")), "value", "left")
    is_gate = F.col("kind") == "gate"
    says = F.when(is_gate, F.concat("value", F.lit(": "), F.when(F.col("declared"), F.col("command")).otherwise("unresolved"))).when(F.col("kind") == "check", F.col("value"))
    listed = F.when(F.col("kind") == "human", "HUMAN-ATTENDED").otherwise(F.concat_ws(": ", "kind", "value"))
    n = resolved.withColumns({"says": says, "listed": listed}).groupBy("claim").agg(
        F.count("*").alias("n"), F.min("kind").alias("kind"), F.max("says").alias("says"), F.array_join(F.sort_array(F.collect_list("listed")), "; ").alias("list"), F.coalesce(F.max(is_gate & F.col("declared").isNull()), F.lit(False)).alias("lost")
    )
    none, one = F.col("n").isNull(), F.col("n") == 1
    bound = F.when(none, "none").when(one, F.col("kind")).otherwise(F.concat(F.col("n"), F.lit(" bindings")))
    fault = F.when(none, "no-oracle").when(~one, "several-oracles").when(F.col("lost"), "unknown-gate")
    return claims.select("claim").join(n, "claim", "left").select("claim", bound.alias("bound"), F.when(none, None).when(one, F.col("says")).otherwise(F.col("list")).alias("oracle"), fault.alias("fault"))


def trace_faults(claims: DataFrame, tasks: DataFrame, traces: DataFrame, criteria: DataFrame, files: DataFrame, unauthored: DataFrame) -> DataFrame:
    """(rule, seq, claim, cited) for the faults of traces (seq, claim, task, kind, acceptance, evidence).

    Rows that name a claim of claims (claim, stage) or a task that isn't there;
    acceptance ids that their task, if it is there, doesn't declare in criteria
    (task, acceptance); evidence `path` or `path#anchor` without such a file of
    files (path, body), or with a file that doesn't hold the anchor; releases
    without an earlier sitting of their claim and task; claims that are never
    traced, unless their stage is one of unauthored (stage).
    """
    fault = lambda df, rule, cited=None: df.select(F.lit(rule).alias("rule"), "seq", "claim", (F.lit(None).cast("string") if cited is None else F.col(cited)).alias("cited"))
    known = tasks.select("task").distinct()
    unknown_claim = fault(traces.join(claims.select("claim").distinct(), "claim", "left_anti"), "unknown-claim")
    unknown_task = fault(traces.join(known, "task", "left_anti"), "unknown-task")
    cites = traces.join(known, "task", "left_semi").select("seq", "claim", "task", F.explode("acceptance").alias("acceptance"))
    unmet = fault(cites.join(criteria.select("task", "acceptance").distinct(), ["task", "acceptance"], "left_anti"), "unknown-acceptance", "acceptance")
    path, anchor = F.substring_index("cited", "#", 1), F.when(F.col("cited").contains("#"), F.expr("substring(cited, instr(cited, '#') + 1)"))
    proof = traces.select("seq", "claim", F.explode("evidence").alias("cited")).withColumns({"path": path, "anchor": anchor}).join(files.select("path", "body"), "path", "left")
    lost = fault(proof.filter("body IS NULL"), "missing-evidence", "cited").union(fault(proof.filter(F.col("body").isNotNull() & F.col("anchor").isNotNull() & ~F.col("body").contains(F.col("anchor"))), "missing-anchor", "cited"))
    sat = F.min(F.when(F.col("kind") == "sitting", F.col("seq"))).over(Window.partitionBy("claim", "task"))
    early = traces.withColumn("sat", sat).filter((F.col("kind") == "release") & ~F.coalesce(F.col("sat") < F.col("seq"), F.lit(False)))
    owned = claims.join(unauthored.select("stage").distinct(), "stage", "left_anti").filter("stage IS NOT NULL")
    untraced = owned.join(traces.select("claim").distinct(), "claim", "left_anti").select("claim", F.lit(None).cast("long").alias("seq"))
    return unknown_claim.union(unknown_task).union(unmet).union(lost).union(fault(early, "release-without-sitting")).union(fault(untraced, "never-traced"))


def paired(briefs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Briefs and recorded verdicts by key, and why a pair can't be recovered."""
    a = briefs.groupBy("key").agg(F.count("*").alias("n_briefs"), F.count_distinct("digest").alias("n_digests"))
    b = verdicts.groupBy("key").agg(F.count("*").alias("n_verdicts"), F.count_distinct("verdict").alias("n_kinds"))
    reason = (
        F.when(F.col("n_briefs").isNull(), "brief-missing").when(F.col("n_verdicts").isNull(), "verdict-missing")
        .when(F.col("n_digests") > 1, "briefs-differ").when(F.col("n_kinds") > 1, "verdicts-differ").otherwise("paired")
    )
    return a.join(b, "key", "full_outer").select("key", reason.alias("outcome"))


def percent_text(part: Column, whole: Column) -> Column:
    """A share in hundredths of a percent, rounded half up in whole numbers."""
    of = F.nullif(whole, F.lit(0))
    n = F.floor((part * 10000 + F.floor(of / 2)) / of).cast("long")
    text = F.concat(F.floor(n / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"), F.lit("%"))
    return F.coalesce(text, F.lit("n/a"))


def last_known(rows: DataFrame, keys: list[str], order: str, fields: list[str]) -> DataFrame:
    """For each key every field's last value that is not null."""
    last = lambda c: F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
    return rows.groupBy(*keys).agg(*[last(c) for c in fields])


def availability(lanes: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """Whether each lane's capture can be read, and why not; (keys, n_bytes) of files."""
    reason = F.when(F.col("n_bytes").isNull(), "no-capture").when(F.col("n_bytes") == 0, "empty").otherwise("available")
    return lanes.select(*keys).distinct().join(files, keys, "left").withColumn("availability", reason)


def rebuilt_rows(witness: DataFrame, events: DataFrame, live: DataFrame, rows: DataFrame) -> DataFrame:
    """Admission rows for tasks that have none left, from their last durable facts and live units."""
    seen = witness.groupBy("task").agg(F.max_by(F.struct("attempt", "verdict"), F.struct("attempt", "lease_epoch", "seq")).alias("w"))
    told = events.groupBy("task").agg(F.max_by(F.struct("attempt", "event"), F.struct("attempt", "sequence")).alias("e"))
    lost = seen.join(told, "task", "full_outer").join(rows, "task", "left_anti").join(live.select("task", F.col("state").alias("live")), "task", "left")
    source = F.when(F.col("live").isNotNull(), "live").when(F.col("w").isNotNull(), "witness").otherwise("lifecycle")
    return lost.select("task", F.greatest("w.attempt", "e.attempt").alias("attempt"), F.coalesce("live", "w.verdict", "e.event").alias("state"), source.alias("source"))
