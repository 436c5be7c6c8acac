"""Queries for maintenance plans, receipts and rules on single facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from worklens.functions import facts
from worklens.operators import maintenance, receipts
from worklens.plans import register, table
from worklens.plans.sql import EVENTS, LINEAGE, LIVE, MEMBERS, TASKS, USAGE, WITNESS, with_
from worklens.sources import bridge


@register("membership_evictions", with_(TASKS, EVENTS, LIVE, MEMBERS) + """,
runs AS (SELECT run, max(created) AS touched, count(*) AS held FROM membership JOIN task_rows USING (task) GROUP BY 1),
safe AS (SELECT run FROM membership SEMI JOIN live USING (task) UNION SELECT run FROM task_rows WHERE priority = 1 AND task % 50 = 0),
b AS (SELECT *, coalesce(sum(held) OVER (ORDER BY touched, run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM runs ANTI JOIN safe USING (run))
SELECT run, touched, held, (SELECT sum(held) FROM runs) - before > floor((SELECT sum(held) FROM runs) * 0.9) AS evict FROM b""".replace("SELECT run, max(created)", "SELECT membership.run AS run, max(created)"))
def membership_evictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2, W24, U8."""
    rows, members = bridge.task_rows(spark, sf_dir), bridge.membership(spark, sf_dir)
    protected = maintenance.protected_runs(members, bridge.live(spark, sf_dir), rows.filter("priority = 1 AND task % 50 = 0"))
    recorded = members.join(rows.select("task", F.col("created").alias("recorded_at")), "task")
    return maintenance.eviction_plan(recorded, protected, 0.9)


@register("reader_states", with_(TASKS) + "SELECT run, max(task) AS line, arg_max(state, task) AS state, count(*) AS records FROM task_rows GROUP BY run")
def reader_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3, W16."""
    return maintenance.latest_only(bridge.task_rows(spark, sf_dir).select("run", F.col("task").alias("line"), "state"), "run", "line")


@register("bounded_lineage", with_(LINEAGE) + "SELECT run, successor FROM lineage ORDER BY successor DESC, run DESC LIMIT 100000")
def bounded_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: the limit is the ledger's bound."""
    return maintenance.newest(bridge.lineage(spark, sf_dir), 100_000, "successor", "run")


@register("live_references", with_(WITNESS) + """
SELECT ref, bool_or(ts >= TIMESTAMP '2000-06-01') AS keep FROM (SELECT ts, unnest(['key/' || dedup_key, 'lease/' || lease_epoch]) AS ref FROM witness) GROUP BY ref""")
def live_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U7, M5."""
    refs = F.array(F.concat(F.lit("key/"), F.col("dedup_key")), F.concat(F.lit("lease/"), F.col("lease_epoch")))
    return maintenance.live_references(bridge.witness(spark, sf_dir).withColumn("refs", refs), "refs", "ts", F.to_timestamp(F.lit("2000-06-01")))


@register("prune_plan", with_(EVENTS) + """,
r AS (SELECT pool AS store, sequence AS file, ts < TIMESTAMP '2024-01-10' AS expired, ts FROM lifecycle),
k AS (SELECT store, file, row_number() OVER (PARTITION BY store ORDER BY ts DESC, file DESC) AS n FROM r WHERE NOT expired)
SELECT store, file, 'age' AS reason FROM r WHERE expired UNION ALL SELECT store, file, CASE WHEN n > 50 THEN 'count' END FROM k""")
def prune_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6."""
    files = bridge.lifecycle(spark, sf_dir).select(F.col("pool").alias("store"), F.col("sequence").alias("file"), F.col("ts").alias("modified"))
    return maintenance.prune_plan(files, F.to_timestamp(F.lit("2024-01-10")), 50)


@register("storage_growth", with_(EVENTS) + """,
s AS (SELECT ledger_id AS store, sequence, sum(CASE WHEN event = 'completed' THEN 1 ELSE 0 END) OVER (PARTITION BY ledger_id ORDER BY sequence) AS completions, (gpu_seconds * 100)::BIGINT AS used FROM lifecycle),
p AS (SELECT store, completions, arg_max(used, sequence) AS used FROM s GROUP BY ALL),
d AS (SELECT *, completions - lag(completions) OVER w AS delta, used - lag(used) OVER w AS more FROM p WINDOW w AS (PARTITION BY store ORDER BY completions))
SELECT store, completions::BIGINT AS completions, used, delta::BIGINT AS delta, trunc(more / delta)::BIGINT AS growth FROM d""")
def storage_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A30."""
    done = F.sum(F.when(F.col("event") == "completed", 1).otherwise(0)).over(Window.partitionBy("ledger_id").orderBy("sequence"))
    rows = bridge.lifecycle(spark, sf_dir).select(F.col("ledger_id").alias("store"), F.col("sequence").alias("n"), done.alias("completions"), F.round(F.col("gpu_seconds") * 100).cast("long").alias("used"))
    return maintenance.growth(rows)


def _receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event") == "failed", "diagnosis").when(F.col("event") == "started", "retry").when(F.col("event") == "enqueued", "pardon")
    rows = bridge.lifecycle(spark, sf_dir).withColumn("kind", kind).filter("kind IS NOT NULL")
    task = F.when((F.col("kind") != "pardon") | (F.col("sequence") % 4 != 0), F.col("task"))
    return rows.select(F.col("ledger_id").alias("campaign"), "sequence", task.alias("task"), "kind", (F.col("context_tokens") % 3 + 1).cast("long").alias("attempt"))


@register("kept_receipts")
def kept_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W18."""
    return receipts.contiguous(_receipts(spark, sf_dir))


@register("lifetime_attempts", with_(EVENTS) + """
SELECT ledger_id AS campaign, task, count(*) AS attempts, count(*) >= 10 AS exhausted FROM lifecycle WHERE event IN ('failed', 'started') GROUP BY ALL""")
def lifetime_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A31."""
    return receipts.lifetime(_receipts(spark, sf_dir))


@register("first_tasks", with_(TASKS) + """
SELECT run, array_to_string(list_sort(list(task))[1:3], ',') AS "first", greatest(count(*) - 3, 0) AS more FROM task_rows GROUP BY run""")
def first_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three first are what the report shows; the rest is counted."""
    return receipts.shown(bridge.task_rows(spark, sf_dir), "run", "task", 3).withColumn("first", F.array_join("first", ","))


@register("time_texts", with_(EVENTS) + """
SELECT sequence, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS shown, make_timestamp(epoch_us(ts)) AS again, 'change:' || lpad(sequence::VARCHAR, 20, '0') AS cursor, sequence AS parsed,
       ts >= TIMESTAMP '2024-02-01' - INTERVAL 14 DAY AS recent, CASE WHEN sequence % 2 = 0 THEN date_trunc('second', ts) ELSE TIMESTAMP '2024-01-01' END AS observed FROM lifecycle""")
def time_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1, H2, H4, H5, H28."""
    cursor, at = facts.cursor("change", F.col("sequence")), F.col("ts").cast("timestamp")
    said = F.when(F.col("sequence") % 2 == 0, F.date_format(at, "yyyy-MM-dd HH:mm:ss")).otherwise("soon")
    return bridge.lifecycle(spark, sf_dir).select(
        "sequence", facts.millis_text(at).alias("shown"), facts.from_micros(F.unix_micros(at)).cast("timestamp_ntz").alias("again"), cursor.alias("cursor"), facts.cursor_sequence(cursor, "change").alias("parsed"),
        (at >= facts.cutoff(F.to_timestamp(F.lit("2024-02-01")), 14)).alias("recent"), facts.first_time(F.lit(None).cast("string"), said, F.lit("2024-01-01 00:00:00")).cast("timestamp_ntz").alias("observed"),
    )


@register("usage_facts", with_(WITNESS, USAGE) + """,
u AS (SELECT *, CASE WHEN coalesce(input_tokens, cache_read_tokens, cache_write_tokens, output_tokens) IS NOT NULL THEN coalesce(input_tokens, 0) + coalesce(cache_read_tokens, 0) + coalesce(cache_write_tokens, 0) + coalesce(output_tokens, 0) END AS computed,
      coalesce(declared_total, coalesce(input_tokens, 0) + coalesce(output_tokens, 0)) AS amount FROM attestations)
SELECT ledger_id, seq, computed, CASE WHEN computed IS NULL THEN 'no-components' WHEN declared_total <> computed THEN 'mismatch' ELSE 'reconciled' END AS reconciled,
       CASE WHEN amount > 0 AND seq % 17 <> 0 THEN amount END AS metered, CASE WHEN seq % 17 <> 0 THEN 'exact' WHEN computed IS NOT NULL THEN 'partial' ELSE 'unavailable' END AS accounting,
       CASE WHEN seq % 19 = 0 THEN 'not-declared' WHEN computed IS NOT NULL THEN 'components' WHEN declared_total IS NOT NULL THEN 'lump' ELSE 'not-reported' END AS shape,
       round(least(100.0, amount * 100.0 / 400), 4) AS percent, CASE WHEN cache_read_tokens IS NOT NULL THEN 'provider-capture' ELSE 'adapter-config' END AS window_source FROM u""")
def usage_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H18 to H20, H23, H24, H26."""
    rows = bridge.attestations(spark, sf_dir)
    parts = [F.col(c) for c in ("input_tokens", "cache_read_tokens", "cache_write_tokens", "output_tokens")]
    hurt = F.col("seq") % 17 == 0
    rows = rows.withColumn("computed", facts.component_sum(*parts))
    amount = facts.meter_amount(F.col("declared_total"), parts[0], parts[3], hurt)
    every = F.coalesce(facts.meter_amount(F.col("declared_total"), parts[0], parts[3], F.lit(False)), F.lit(0))
    declared, unreadable = F.array(F.lit("total")), F.when(hurt, F.array(F.lit("total"))).otherwise(F.array().cast("array<string>"))
    return rows.select(
        "ledger_id", "seq", "computed", facts.reconciled(F.col("declared_total"), F.col("computed")).alias("reconciled"), amount.alias("metered"),
        facts.accounting_state(declared, unreadable, F.col("computed").isNotNull()).alias("accounting"), facts.observation_shape(F.col("seq") % 19 != 0, F.col("declared_total"), F.col("computed")).alias("shape"),
        F.round(facts.meter_percent(every, F.lit(400)), 4).alias("percent"), facts.window_source(parts[1], F.lit(200_000)).alias("window_source"),
    )


@register("outcome_facts", with_(WITNESS) + """
SELECT ledger_id, seq, CASE WHEN verdict = 'preempted' THEN 'automatic:resource-return' ELSE 'ineligible' END AS retry,
       CASE WHEN attempt = 1 THEN 'pending' WHEN verdict = 'failed' OR lease_epoch % 3 = 0 THEN 'rejected' WHEN lease_epoch % 3 = 1 THEN 'pending' ELSE 'accepted' END AS acceptance,
       CASE WHEN labor_class = 'fresh' THEN 'created' END AS disposition, CASE WHEN verdict <> 'failed' AND seq % 2 = 0 THEN CASE WHEN seq % 4 = 0 THEN 'pass' ELSE 'clean-exit-no-artifact' END ELSE 'failed' END AS gate,
       CASE WHEN seq % 5 = 0 THEN NULL ELSE 'build' END AS role, CASE WHEN seq % 5 <> 0 AND seq % 2 = 1 THEN 't' || task END AS subject,
       least(3, lease_epoch % 4 + CASE WHEN gpu_seconds > 25 THEN 1 ELSE 0 END) AS rank, floor(dedup_key * 85 / 100)::BIGINT AS lower, dedup_key + greatest(ceil(dedup_key / 10), 7)::BIGINT AS upper FROM witness""")
def outcome_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H29 to H31, H33, H34, H36, W21."""
    lease, seq = F.col("lease_epoch"), F.col("seq")
    gates = F.when(lease % 3 == 0, "fail").when(lease % 3 == 1, "not-run").otherwise("pass")
    execution = F.when(F.col("verdict") == "failed", "failure").otherwise("success")
    subject = F.when(seq % 2 == 1, F.concat(F.lit("t"), F.col("task"))).otherwise("")
    node = facts.node_key(F.concat(F.lit("flow:v"), F.when(seq % 5 == 0, "2").otherwise("1"), F.lit(":build:"), subject, F.lit(":key")))
    priority = F.get(F.array(*[F.lit(p) for p in facts.PRIORITIES]), lease % 4)
    return bridge.witness(spark, sf_dir).select(
        "ledger_id", "seq", facts.retry(F.col("verdict"), {"resource-return": True}).alias("retry"), facts.acceptance(execution, gates, F.col("attempt") == 1).alias("acceptance"),
        facts.lookup(F.col("labor_class"), facts.DISPOSITION).alias("disposition"), facts.gate_verdict(F.col("verdict") != "failed", seq % 2 == 0, seq % 4 == 0).alias("gate"),
        node["role"].alias("role"), node["subject"].alias("subject"), facts.aged_rank(priority, F.col("gpu_seconds"), 25.0).alias("rank"),
        facts.lower_recovery(F.col("dedup_key"), 85).alias("lower"), facts.free_recovery(F.col("dedup_key"), 7).alias("upper"),
    )


#: Words that hedge; the query's lexicon.
HEDGES = ["the", "of", "and", "in"]


@register("lexicon_hits", """
SELECT conv_id, turn, array_to_string(list_filter(['the', 'of', 'and', 'in'], lambda w: regexp_matches(lower(text), '(^|[^a-z0-9_])' || w || '($|[^a-z0-9_])')), ',') AS hits,
       len(regexp_extract_all(regexp_replace(text, '`[^`]*`', ' ', 'g'), '[0-9]+')) AS numerals FROM conversations WHERE text IS NOT NULL""")
def lexicon_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H15, H16."""
    rows = table(spark, sf_dir, "conversations").filter("text IS NOT NULL")
    return rows.select("conv_id", "turn", F.array_join(facts.lexicon_hits(F.col("text"), HEDGES), ",").alias("hits"), F.size(facts.bare_numerals(F.col("text"))).cast("long").alias("numerals"))


@register("hash_shapes", """
WITH h AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'sha256:' || sha256(url) WHEN page_id % 3 = 1 THEN sha256(url) ELSE url END AS h FROM pages)
SELECT page_id, regexp_full_match(h, 'sha256:[0-9a-f]{64}') AS is_hash, regexp_full_match(h, '[0-9a-f]{40}|[0-9a-f]{64}') AS is_object FROM h""")
def hash_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H6."""
    digest = F.sha2("url", 256)
    h = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("sha256:"), digest)).when(F.col("page_id") % 3 == 1, digest).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", facts.is_content_hash(h).alias("is_hash"), facts.is_object_id(h).alias("is_object"))


@register("event_counts_read", """
SELECT event_id, (props->>'$.k')::BIGINT AS k, coalesce(props->>'$.missing', props->>'$.k') AS found FROM events""")
def event_counts_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H21, H22."""
    found = facts.first_path(F.col("props"), "$.missing", "$.k")
    return table(spark, sf_dir, "events").select("event_id", facts.as_count(found).alias("k"), found.alias("found"))
