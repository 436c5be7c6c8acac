"""Operators over witness, lifecycle and membership tables. DataFrames in, DataFrames out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worklens.functions import predicates as P
from worklens.operators import segments

LANE = ["task", "attempt", "lease_epoch"]


def argmax(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """The row of each key that is greatest in `order`; the order should be total."""
    rest = [c for c in df.columns if c not in keys]
    top = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(top.alias("top")).select(*keys, "top.*")


def governing_witness(rows: DataFrame, witness: DataFrame) -> DataFrame:
    """Per task the witness with the greatest seq whose attempt is not older than the last one seen in rows."""
    known = witness.join(rows.select("task", "last_attempt"), "task", "left")
    return argmax(known.filter(F.coalesce(F.col("attempt") >= F.col("last_attempt"), F.lit(True))).drop("last_attempt"), ["task"], "seq")


def current_lane(facts: DataFrame) -> DataFrame:
    """The greatest attempt of each task, then the greatest lease within it; facts without attempt name none."""
    return facts.filter("attempt IS NOT NULL").groupBy("task").agg(F.max(F.struct("attempt", "lease_epoch")).alias("lane")).select("task", F.col("lane.attempt").alias("current_attempt"), F.col("lane.lease_epoch").alias("current_lease"))


def journal_state(events: DataFrame) -> DataFrame:
    """The state of each task; equal times take the later row and a null time sorts first."""
    order = F.struct(F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(-1)), "sequence")
    return events.groupBy("task").agg(F.max_by("event", order).alias("state"), F.max("attempt").alias("max_attempt"), F.sort_array(F.collect_set(F.when(F.col("event") == "failed", F.col("attempt")))).alias("failed_attempts"))


def milestones(events: DataFrame) -> DataFrame:
    """First times by event, the last event and the time of the last terminal one."""
    first = lambda e: F.min(F.when(F.col("event") == e, F.col("ts"))).alias(f"{e}_at")
    return events.groupBy("task").agg(
        first("enqueued"), first("started"), F.max("ts").alias("last_event_at"),
        F.max_by(F.when(P.terminal(F.col("event")), F.col("ts")), F.when(P.terminal(F.col("event")), F.col("sequence"))).alias("terminal_at"), F.count("*").alias("n_events"),
    )


def jobs_v1(rows: DataFrame, journal: DataFrame, witness: DataFrame) -> DataFrame:
    """Rows, journal and witnesses of each job, whichever exist, put together by what goes before what.

    rows (task, attempt, state, executor, source, session, model, pool), journal
    (task, line, us, attempt, event, executor, source, session, pool), witness
    (ledger_id, task, seq, attempt, verdict, labor_class, gpu_seconds, at,
    executor, session, model, brief_hash, pool).

    A journal record counts if no record before it in the file is of a later
    time (null times only before any other); the last of them says the state,
    and each field is that of the last that has it. Then come the witnesses whose
    attempt is not older than the last one that row or journal know: that of the
    greatest seq governs, and fields that it lacks are those of the last that has
    them. A witness without a task is a job of its own, `witness:` and its seq.
    All are dealt by anchor once.
    """
    anchor = F.col("task").cast("string").alias("anchor")
    in_file = Window.partitionBy("anchor").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    said = journal.select(anchor, *[c for c in journal.columns if c != "task"]).withColumn("__latest", F.max("us").over(in_file))
    counts = F.col("__latest").isNull() | F.coalesce(F.col("us") >= F.col("__latest"), F.lit(False))
    last = lambda c: F.max_by(c, F.when(counts & F.col(c).isNotNull(), F.col("line")))
    told = said.groupBy("anchor").agg(
        F.max("attempt").alias("j_attempt"), F.max_by("event", F.when(counts, F.col("line"))).alias("j_state"), F.max_by("us", F.when(counts, F.col("line"))).alias("j_us"), F.min_by("source", F.when(counts & F.col("source").isNotNull(), F.col("line"))).alias("j_source"),
        *[last(c).alias(f"j_{c}") for c in ("executor", "session", "pool")],
    )
    own = rows.select(anchor, *[F.col(c).alias(f"r_{c}") for c in ("attempt", "state", "executor", "source", "session", "model", "pool")], F.lit(True).alias("has_row"))
    known = own.join(told, "anchor", "full_outer").withColumn("last_attempt", F.greatest("r_attempt", "j_attempt"))
    key = F.coalesce(F.col("task").cast("string"), F.concat(F.lit("witness:"), F.col("seq"))).alias("anchor")
    seen = witness.select(key, F.col("attempt").alias("w_attempt"), *[c for c in witness.columns if c not in ("task", "attempt")]).join(known.select("anchor", "last_attempt"), "anchor", "left")
    seen = seen.filter(F.col("last_attempt").isNull() | (F.col("w_attempt") >= F.col("last_attempt")))
    order = F.struct("seq", "ledger_id")
    kept = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(f"w_{c}")
    governs = seen.groupBy("anchor").agg(F.max_by(F.struct("seq", "w_attempt", "verdict", "labor_class", "gpu_seconds", "at", "pool"), order).alias("w"), *map(kept, ("executor", "session", "model", "brief_hash")))
    out = known.join(governs, "anchor", "full_outer")
    judged = F.col("w").isNotNull()
    counted = F.when(P.canonical_gpu(F.col("w.verdict"), F.col("w.labor_class")), F.col("w.gpu_seconds"))
    return out.select(
        "anchor", F.when(judged, "terminal").otherwise(F.coalesce("j_state", "r_state")).alias("state"), F.col("w.verdict").alias("verdict"), "last_attempt", F.col("w.w_attempt").alias("witness_attempt"), F.col("w.seq").alias("witness_seq"), F.col("w.labor_class").alias("labor_class"),
        F.coalesce("w_executor", "j_executor", "r_executor").alias("executor"), F.coalesce("r_source", "j_source").alias("source"), F.coalesce("w_session", "j_session", "r_session").alias("session"), F.coalesce("w_model", "r_model").alias("model"), F.col("w_brief_hash").alias("brief_hash"),
        F.when(judged, F.col("w.pool")).otherwise(F.coalesce("j_pool", "r_pool")).alias("pool"), F.col("w.gpu_seconds").alias("gpu_seconds"), counted.alias("canonical_gpu_seconds"), F.when(judged, F.col("w.at")).otherwise(F.timestamp_micros("j_us").cast("timestamp_ntz")).alias("last_event_at"),
        F.when(judged, "witness").otherwise("queue").alias("scope"),
    )


def in_scope(jobs: DataFrame, scope: str) -> DataFrame:
    """jobs of the queue (no witness governs), of the witness, or all."""
    if scope not in ("queue", "witness", "all"):
        raise ValueError(f"no such scope: {scope}")
    return jobs if scope == "all" else jobs.filter(F.col("witness_seq").isNull() if scope == "queue" else F.col("witness_seq").isNotNull())


def echo_collapse(events: DataFrame, witness: DataFrame) -> DataFrame:
    """The newest journal terminal of a lane absorbs the lane's first witness, which then shows no row of its own.

    Lanes are (task, attempt, lease_epoch), of which the last two may be null.
    The row that absorbs keeps its own number and time; what the witness says of
    outcome, labor and seconds goes before what the journal says. One shuffle by
    lane serves both sides.
    """
    mine = ["origin", *LANE, "ledger_id", "number", "ts", "terminal", "verdict", "labor_class", "gpu_seconds"]
    journal = events.withColumns({"origin": F.lit("journal"), "number": F.col("sequence"), "terminal": P.terminal(F.col("event")), "verdict": F.lit(None).cast("string"), "labor_class": F.lit(None).cast("string")})
    both = journal.select(*mine).union(witness.withColumns({"origin": F.lit("witness"), "number": F.col("seq"), "terminal": F.lit(False)}).select(*mine))
    lane = Window.partitionBy(*LANE)
    is_witness = F.col("origin") == "witness"
    last = F.max(F.when(F.col("terminal"), F.col("number"))).over(lane)
    first = F.min(F.when(is_witness, F.struct("ledger_id", "number"))).over(lane)
    said = F.min_by(F.struct("number", "verdict", "labor_class", "gpu_seconds"), F.when(is_witness, F.struct("ledger_id", "number"))).over(lane)
    out = both.withColumns({"last": last, "first": first, "said": said})
    out = out.filter(~(is_witness & F.col("last").isNotNull() & (F.struct("ledger_id", "number") == F.col("first"))))
    merged = F.col("terminal") & (F.col("number") == F.col("last")) & F.col("first").isNotNull()
    pick = lambda c: F.when(merged, F.coalesce(F.col(f"said.{c}"), F.col(c))).otherwise(F.col(c)).alias(c)
    return out.select(F.when(merged, "journal+witness").otherwise(F.col("origin")).alias("origin"), *LANE, "number", "ts", pick("verdict"), pick("labor_class"), pick("gpu_seconds"), F.when(merged, F.col("said.number")).when(is_witness, F.col("number")).alias("witness_seq"))


def dedup_probe(keys: DataFrame, witness: DataFrame) -> DataFrame:
    """Of each dedup key the witness of greatest seq that passed, with content of its own: a hash or store paths (has_content)."""
    best = witness.filter((F.col("verdict") == "pass") & F.col("has_content")).groupBy("dedup_key").agg(F.max_by(F.struct("task", "attempt", "seq"), F.struct("seq", "ledger_id")).alias("hit"))
    return keys.join(best, "dedup_key", "left").select("dedup_key", F.col("hit.task").alias("task"), F.col("hit.attempt").alias("attempt"), F.col("hit.seq").alias("seq"), F.col("hit").isNotNull().alias("found"))


def run_members(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """Tasks of a run from rows and membership, each once."""
    return rows.select("run", "task").union(ledger.select("run", "task")).distinct()


def first_membership(ledger: DataFrame) -> DataFrame:
    """The first run that claimed a task."""
    return ledger.groupBy("task").agg(F.min_by("run", F.struct("line", "run")).alias("run"))


def sequence_gaps(records: DataFrame) -> DataFrame:
    """Per ledger its count, ends, out-of-order and repeated numbers, and the first gap.

    line counts the records of a ledger. What came before a record, by line and
    by number, is found piece by piece, so no task gets a whole ledger; all the
    rest are sums.
    """
    seen = segments.with_before(records.select("ledger_id", "line", "seq"), ["ledger_id"], "line", F.col("seq"))
    order = seen.groupBy("ledger_id").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count_if(F.col("seq") < F.col("before")).alias("out_of_order"))
    numbers = records.groupBy("ledger_id", "seq").agg(F.count("*").alias("copies")).filter("seq IS NOT NULL")
    after = segments.with_before(numbers, ["ledger_id"], "seq", F.col("seq"))
    gaps = after.groupBy("ledger_id").agg(F.sum(F.when(F.col("copies") > 1, F.col("copies")).otherwise(0)).alias("repeated"), F.min(F.when(F.col("seq") > F.col("before") + 1, F.col("before") + 1)).alias("first_gap"))
    out = order.join(gaps, "ledger_id", "left").withColumn("repeated", F.coalesce("repeated", F.lit(0)))
    return out.withColumn("ok", (F.col("out_of_order") == 0) & (F.col("repeated") == 0) & F.col("first_gap").isNull())


GENESIS = "sha256:" + "0" * 64
#: What stands at the end of a sealed line around its 64 digits, and before that around those of the hash before.
_HASH, _PREVIOUS, _DIGITS = b'"hash":"sha256:', (b'"prevHash":"sha256:', b'"prev_hash":"sha256:'), 64


def _sealed(raw: Column) -> tuple[Column, Column, Column]:
    """Of a line the hash it says, the hash before, and its own: bytes are cut where the writer puts them; JSON is read only where they aren't there."""
    b, n, tail = raw.cast("binary"), F.octet_length(raw), len(_HASH) + _DIGITS + 2
    at = lambda start, length: F.substring(b, start, length)
    usual = (n > tail) & (at(n - tail + 1, F.lit(len(_HASH))) == F.lit(_HASH)) & (at(n - 1, F.lit(2)) == F.lit(b'"}'))
    digits = lambda start: F.concat(F.lit("sha256:"), at(start, F.lit(_DIGITS)).cast("string"))
    said = F.when(usual, digits(n - 1 - _DIGITS)).otherwise(F.get_json_object(raw, "$.hash"))
    before = F.coalesce(F.get_json_object(raw, "$.prevHash"), F.get_json_object(raw, "$.prev_hash"))
    for name in _PREVIOUS:
        back = tail + 2 + _DIGITS + len(name)
        before = F.when(usual & (n > back) & (at(n - back + 1, F.lit(len(name))) == F.lit(name)) & (at(n - tail - 1, F.lit(2)) == F.lit(b'",')), digits(n - tail - 1 - _DIGITS)).otherwise(before)
    own = F.when(usual, F.concat(F.lit("sha256:"), F.sha2(F.concat(at(F.lit(1), n - _DIGITS - 9), F.lit(b'"}')), 256)))
    return said, before, own


def verify_chain(lines: DataFrame) -> DataFrame:
    """(ledger_id, line, problem) for each record of (ledger_id, line, raw) that fails.

    A record's hash is that of its line with the closing hash blanked; its
    prevHash is the hash of the valid record before it. Hashes are computed where
    lines are read; only they go on, 32 bytes each, and the valid one before is
    found piece by piece, so no task gets a whole ledger.
    """
    said, before, own = _sealed(F.col("raw"))
    bits = lambda h: F.unhex(F.substring(h, 8, _DIGITS))
    read = lines.select("ledger_id", F.col("line").cast("long").alias("line"), said.alias("said"), before.alias("prev"), own.alias("own"))
    short = read.select("ledger_id", "line", F.col("said").isNull().alias("none"), (~F.coalesce(F.col("said") == F.col("own"), F.lit(False))).alias("bad"), F.when(F.col("said") == F.col("own"), bits(F.col("said"))).alias("hash"), bits(F.when(F.col("prev").rlike("^sha256:[0-9a-f]{64}$"), F.col("prev"))).alias("prev"))
    linked = segments.with_before(short, ["ledger_id"], "line", F.col("hash"), F.lit(bytes(32)))
    problem = F.when(F.col("none"), "not-a-record").when(F.col("bad"), "hash-mismatch").when(~F.col("prev").eqNullSafe(F.col("before")), "prev-hash-mismatch")
    return linked.select("ledger_id", "line", problem.alias("problem")).filter("problem IS NOT NULL")


def compare_ledgers(ours: DataFrame, theirs: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Each execution with the fields that differ; missing and orphan ones by name."""
    a, b = ours.alias("a"), theirs.alias("b")
    joined = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys], "full_outer")
    differ = F.array_compact(F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields]))
    there = F.col(f"a.{keys[0]}").isNotNull(), F.col(f"b.{keys[0]}").isNotNull()
    status = F.when(~there[1], "missing").when(~there[0], "orphan").when(F.size(differ) > 0, "differs").otherwise("agrees")
    return joined.select(*[F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in keys], status.alias("status"), F.when(there[0] & there[1], F.array_join(differ, ",")).alias("fields"))


#: O1: where records of equal time stand.
ORIGINS = ["journal", "witness"]


def log_key(log: DataFrame) -> DataFrame:
    """O1: log (origin, ts, number, event_id) with place: records come by time, null first, then journal before witness, by number and event id."""
    rank = F.array_position(F.array(*map(F.lit, ORIGINS)), F.col("origin")).cast("int")
    return log.withColumn("place", F.struct(F.col("ts"), rank.alias("origin"), F.col("number"), F.col("event_id")))


def page(df: DataFrame, after: Column | None, order: list[Column], size: int = 100) -> DataFrame:
    """O3: a page by key: rows past the cursor, in order."""
    return (df if after is None else df.filter(after)).orderBy(*order).limit(min(size, 1000))
