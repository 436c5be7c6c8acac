"""Record rules and log views: what is well formed, fresh, new or overdue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worklens.functions import facts
from worklens.operators import segments


def log_filter(log: DataFrame, since: Column) -> DataFrame:
    """records since a time given as text; a record whose own time can't be read goes."""
    return log.filter(F.coalesce(F.try_to_timestamp("at") >= since, F.lit(False)))


def known_pools(pools: DataFrame, wanted: DataFrame) -> DataFrame:
    """F8: (pool, known) for the pools asked for, each once, so that unknown ones show instead of vanishing."""
    names = wanted.select("pool").distinct()
    there = pools.select("pool", F.lit(True).alias("known")).distinct()
    return names.join(there, "pool", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def fresh_meters(meters: DataFrame, now: Column, seconds: int) -> DataFrame:
    """Each pool's latest reading (pool, observed_at, n, budget_class, percent, weekly, resets_at) and whether it may be used.

    It must be of the programmatic class, not of the future nor older than
    `seconds`, reset after now and not before it was observed, and both shares
    must be 0 to 100; the weekly one may be missing.
    """
    last = meters.groupBy("pool").agg(F.max_by(F.struct("observed_at", "budget_class", "percent", "weekly", "resets_at"), F.struct("observed_at", "n")).alias("x")).select("pool", "x.*")
    share = lambda c: F.col(c).between(0, 100) & ~F.isnan(c)
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("observed_at").cast("timestamp"))
    good = (age >= 0) & (age <= seconds * 1_000_000) & (F.col("resets_at") > now) & (F.col("resets_at") >= F.col("observed_at")) & share("percent")
    good = good & (F.col("budget_class") == "programmatic") & (F.col("weekly").isNull() | share("weekly"))
    return last.select("pool", "observed_at", "percent", F.coalesce(good, F.lit(False)).alias("fresh"))


def broken_rules(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The names of the rules a record breaks; a rule that is null counts as broken."""
    return rows.withColumn("broken", F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])))


def missing_fields(rows: DataFrame, kind: str, required: dict[str, list[str]]) -> DataFrame:
    """the fields that a record's kind requires and it lacks; unknown kinds require nothing."""
    need = {f: F.col(kind).isin([k for k, fields in required.items() if f in fields]) for f in sorted({f for v in required.values() for f in v})}
    return rows.withColumn("missing", F.array_compact(F.array(*[F.when(wanted & F.col(f).isNull(), F.lit(f)) for f, wanted in need.items()])))


def sequence_checks(records: DataFrame) -> DataFrame:
    """S3: (ledger_id, line, sequence, expected, ok): each record should follow the one before it by one.

    With columns cursor and ts, ok also asks that the cursor is that of the
    sequence and that time doesn't run back.
    """
    rows = segments.with_before(records, ["ledger_id"], "line", F.struct("sequence", *(["ts"] if "ts" in records.columns else [])))
    expected = F.coalesce(F.col("before.sequence") + 1, F.col("sequence"))
    ok = F.col("sequence") == expected
    if "cursor" in records.columns:
        ok = ok & F.coalesce(F.col("cursor") == F.concat(F.lit("lifecycle:"), F.col("sequence")), F.lit(False))
    if "ts" in records.columns:
        ok = ok & F.coalesce(F.col("ts") >= F.col("before.ts"), F.lit(True))
    return rows.select("ledger_id", "line", "sequence", expected.alias("expected"), ok.alias("ok"))


def split_records(captures: DataFrame) -> DataFrame:
    """(capture, index, raw, status): the lines of each capture in order; what isn't JSON stays as it is, marked."""
    lines = captures.select("capture", F.posexplode(F.split("body", "\n")).alias("index", "raw")).filter("trim(raw) <> ''")
    return lines.withColumn("status", F.when(F.try_parse_json("raw").isNull(), "malformed").otherwise("json"))


def after_position(log: DataFrame, lifecycle_seq: int, witness_seq: int) -> DataFrame:
    """Records past a position with one coordinate for each origin."""
    return log.filter(((F.col("origin") == "journal") & (F.col("number") > lifecycle_seq)) | ((F.col("origin") == "witness") & (F.col("number") > witness_seq)))


def log_ends(log: DataFrame) -> DataFrame:
    """Floor and head of each origin."""
    return log.groupBy("origin").agg(F.min("number").alias("floor"), F.max("number").alias("head"))


def status_changes(rows: DataFrame, key: str, order: str, status: str) -> DataFrame:
    """(key, order, before, status) where the status differs from the last one of its key."""
    before = F.lag(status).over(Window.partitionBy(key).orderBy(order))
    return rows.select(key, order, before.alias("before"), F.col(status).alias("status")).filter(~F.col("before").eqNullSafe(F.col("status")))


def stalls(events: DataFrame, limit_seconds: int) -> DataFrame:
    """Silences of a task longer than the limit: when they ended, and how many notices they were worth."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    quiet = at - F.lag(at).over(Window.partitionBy("task").orderBy("ts", "sequence"))
    notices = F.floor(quiet / (limit_seconds * 1_000_000))
    return events.select("task", "sequence", "ts", notices.alias("notices")).filter("notices > 0")


def retries_left(events: DataFrame, most: int) -> DataFrame:
    """For each failure, how a retry stands: the n-th failure of a task may be retried `most` times, then it is exhausted."""
    nth = F.row_number().over(Window.partitionBy("task").orderBy("sequence"))
    return events.filter("event = 'failed'").select("task", "sequence", nth.alias("nth")).withColumn("retry", F.when(F.col("nth") <= most, "automatic").otherwise("exhausted"))


def retry_plan(terminals: DataFrame, triggers: DataFrame, automatic: dict[str, bool], most: int) -> DataFrame:
    """Terminals (task, attempt, seq, verdict, pools) with retry: none, exhausted, manual, waiting or automatic, and its trigger.

    triggers (kind, name): pools that came back (pool-return, resource-return)
    and tasks that may be put back (bounded-requeue). automatic says which
    triggers need nobody; without the event it waits for, a retry waits. Each
    pool of a terminal meets the triggers by an equi join; works batch by batch.
    """
    kind = facts.lookup(F.col("verdict"), facts.RETRY_ON)
    rows = terminals.withColumn("trigger", kind)
    asks = rows.filter("trigger IS NOT NULL").select("task", "seq", F.col("trigger").alias("kind"), F.explode(F.when(F.col("trigger") == "bounded-requeue", F.array(F.col("task").cast("string"))).otherwise(F.col("pools"))).alias("name"))
    seen = asks.join(triggers.select("kind", "name").distinct(), ["kind", "name"], "left_semi").select("task", "seq").distinct().withColumn("seen", F.lit(True))
    free = F.col("trigger").isin([t for t, yes in automatic.items() if yes])
    retry = F.when(F.col("trigger").isNull(), "none").when(F.col("attempt") + 1 > most, "exhausted").when(~free, "manual").when(F.col("seen").isNull(), "waiting").otherwise("automatic")
    return rows.join(seen, ["task", "seq"], "left").select(*terminals.columns, retry.alias("retry"), "trigger")


def digest_mismatches(prepared: DataFrame, admitted: DataFrame) -> DataFrame:
    """Campaigns whose admitted graph is not the one prepared."""
    return prepared.select("campaign", F.col("digest").alias("prepared")).join(admitted.select("campaign", F.col("digest").alias("admitted")), "campaign").filter("prepared <> admitted")


def rule_counts(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """How many rows break each rule; rows are counted in one pass, in a column a rule."""
    broken = rows.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()])
    return broken.unpivot([], list(rules), "rule", "violations")


def producer_status(records: DataFrame, period_seconds: int) -> DataFrame:
    """(producer, status, last_trigger, last_emission, next_due) from (producer, n, kind, ts); only a last error says `failed`."""
    last = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("ts")))
    out = records.groupBy("producer").agg(F.max_by("kind", "n").alias("kind"), last("trigger").alias("last_trigger"), last("emission").alias("last_emission"))
    due = F.col("last_trigger") + F.make_dt_interval(secs=F.lit(period_seconds))
    return out.select("producer", F.when(F.col("kind") == "error", "failed").otherwise("unknown").alias("status"), "last_trigger", "last_emission", due.alias("next_due"))
