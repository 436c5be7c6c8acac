"""Queries for record rules, log positions and overdue work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worklens.functions import facts, rules, texts
from worklens.functions import predicates as P
from worklens.operators import records
from worklens.plans import register, table
from worklens.plans.sql import EVENTS, POOLS, TASKS, WITNESS, with_
from worklens.sources import bridge


@register("readable_log", with_(EVENTS) + "SELECT sequence, task FROM lifecycle WHERE sequence % 7 <> 0 AND date_trunc('second', ts) >= TIMESTAMP '2024-01-20'")
def readable_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5."""
    said = F.when(F.col("sequence") % 7 == 0, "yesterday").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return records.log_filter(bridge.lifecycle(spark, sf_dir).withColumn("at", said), F.to_timestamp(F.lit("2024-01-20"))).select("sequence", "task")


@register("journal_filter", with_(EVENTS) + """
SELECT sequence, task FROM lifecycle WHERE event = 'started' AND ledger_id % 2 = 1 AND (sequence % 9 = 0 OR ts >= TIMESTAMP '2024-01-20') UNION ALL SELECT sequence, task FROM lifecycle WHERE task = 7 AND pool = 'pool-8'""")
def journal_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """each ninth record has no time and is never too early."""
    us = F.when(F.col("sequence") % 9 != 0, F.unix_micros(F.col("ts").cast("timestamp")))
    rows = bridge.lifecycle(spark, sf_dir).withColumns({"us": us, "journal_scope": F.when(F.col("ledger_id") % 2 == 1, "odd"), "session": F.col("pool")})
    kept = rows.filter(P.journal_filter(event="started", journal_scope="odd", since_us=1_705_708_800_000_000)).union(rows.filter(P.journal_filter(task=7, session="pool-8")))
    return kept.select("sequence", "task")


@register("origin_events", with_(EVENTS) + "SELECT sequence, task FROM lifecycle WHERE event = 'started' OR pool = 'pool-2'")
def origin_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the record's kind as its source, its pool as the producer."""
    rows = bridge.lifecycle(spark, sf_dir)
    return rows.filter(P.from_origin(F.col("event"), F.col("pool"), "started") | P.from_origin(F.col("event"), F.col("pool"), "pool-2")).select("sequence", "task")


@register("known_pools", with_(POOLS) + "SELECT w.pool, p.pool IS NOT NULL AS known FROM (SELECT DISTINCT 'pool-' || l_suppkey * 2 AS pool FROM lineitem) w LEFT JOIN pools p ON w.pool = p.pool")
def known_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: twice the number of each supplier that line items name; half of them aren't there."""
    wanted = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("pool-"), F.col("l_suppkey") * 2).alias("pool"))
    return records.known_pools(bridge.pools(spark, sf_dir), wanted)


@register("fresh_meters", with_(EVENTS) + """,
m AS (SELECT pool, arg_max(ts, (ts, sequence)) AS observed_at, arg_max(gpu_seconds, (ts, sequence)) AS percent, arg_max(CASE WHEN sequence % 5 = 0 THEN TIMESTAMP '2024-01-29 18:00:00' ELSE ts + INTERVAL 12 HOUR END, (ts, sequence)) AS resets_at,
      arg_max(sequence, (ts, sequence)) AS sequence FROM lifecycle WHERE event = 'completed' GROUP BY pool)
SELECT pool, observed_at, percent, sequence % 7 <> 0 AND (sequence % 3 <> 0 OR sequence % 120 BETWEEN 0 AND 100) AND resets_at >= observed_at AND observed_at <= TIMESTAMP '2024-01-30' AND observed_at >= TIMESTAMP '2024-01-30' - INTERVAL 1 DAY AND resets_at > TIMESTAMP '2024-01-30' AND percent BETWEEN 0 AND 100 AS fresh FROM m""")
def fresh_meters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16, T10."""
    n = F.col("sequence")
    resets = F.when(n % 5 == 0, F.to_timestamp(F.lit("2024-01-29 18:00:00")).cast("timestamp_ntz")).otherwise(F.col("ts") + F.make_dt_interval(hours=F.lit(12)))
    kind, weekly = F.when(n % 7 == 0, "interactive").otherwise("programmatic"), F.when(n % 3 == 0, (n % 120).cast("double"))
    meters = bridge.lifecycle(spark, sf_dir).filter("event = 'completed'").select("pool", n.alias("n"), F.col("ts").alias("observed_at"), kind.alias("budget_class"), F.col("gpu_seconds").alias("percent"), weekly.alias("weekly"), resets.alias("resets_at"))
    return records.fresh_meters(meters, F.to_timestamp(F.lit("2024-01-30")).cast("timestamp_ntz"), 86_400)


@register("broken_records", with_(WITNESS) + """,
r AS (SELECT *, CASE WHEN seq % 29 = 0 THEN 'reused' ELSE verdict END AS v, CASE WHEN seq % 31 = 0 THEN 'reused' ELSE labor_class END AS labor FROM witness)
SELECT ledger_id, seq, concat_ws(',', CASE WHEN seq % 19 = 0 THEN 'schema-version' END, CASE WHEN seq % 23 = 0 AND v <> 'failed' THEN 'error-verdict' END, CASE WHEN seq % 46 = 0 THEN 'error-code' END, CASE WHEN seq % 17 = 0 THEN 'timestamp' END,
       CASE WHEN seq % 41 = 0 THEN 'drv-path' END, CASE WHEN seq % 43 = 0 THEN 'executor' END, CASE WHEN seq % 53 = 0 THEN 'origin-producer' END,
       CASE WHEN (v = 'reused') <> (labor = 'reused') THEN 'reused-labor' END, CASE WHEN v = 'reused' AND seq % 2 = 0 THEN 'exit-code' END, CASE WHEN seq % 13 = 0 THEN 'prev-hash' END,
       CASE WHEN seq % 37 = 0 OR lease_epoch = 0 THEN 'lease-epoch' END, CASE WHEN seq % 11 = 0 THEN 'pools' END,
       CASE WHEN seq % 47 = 0 THEN 'forbidden-field' END, CASE WHEN seq % 59 = 0 THEN 'null-field' END, CASE WHEN seq % 61 = 0 THEN 'field-order' END) AS broken FROM r""")
def broken_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as lines of JSON, held against all rules of the witness, text and columns; some are broken by the sequence number."""
    seq, nth = F.col("seq"), lambda n: F.col("seq") % n == 0
    digest, plain = F.concat(F.lit("sha256:"), F.sha2(seq.cast("string"), 256)), F.sha2(seq.cast("string"), 256)
    store = F.lit("/nix/store/" + "0" * 32 + "-x")
    drv = F.struct(F.when(nth(41), store).otherwise(F.concat(store, F.lit(".drv"))).alias("drvPath"), F.array(F.struct(F.lit("out").alias("name"), store.alias("path"))).alias("outputs"))
    kind = F.when(nth(53), "gh").otherwise("calendar")
    record = F.struct(
        F.when(nth(19), 1).otherwise(2).alias("schemaVersion"), F.lit("verdict").alias("recordType"), F.when(nth(17), F.date_format("ts", "yyyy-MM-dd")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).alias("transitionTimestamp"),
        F.lit("00000000-0000-4000-8000-000000000000").alias("taskUuid"), F.when(nth(29), "reused").otherwise(F.col("verdict")).alias("verdict"), (seq % 2 == 0).cast("int").alias("exitCode"), digest.alias("artifactContentHash"), drv.alias("drv"),
        F.col("gpu_seconds").cast("double").alias("gpuSeconds"), F.lit(1.5).alias("wallClock"), F.col("attempt"), F.when(nth(37), 0).otherwise(F.col("lease_epoch")).alias("leaseEpoch"), F.col("dedup_key").cast("string").alias("dedupKey"),
        F.struct(F.lit(1).alias("schemaVersion"), F.lit("calendar").alias("source"), F.struct(F.lit("daily").alias("name"), kind.alias("kind")).alias("producer")).alias("origin"),
        F.when(nth(31), "reused").otherwise(F.col("labor_class")).alias("laborClass"), F.when(nth(11), F.array(F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("pools"), F.when(nth(43), "a@b").otherwise("local").alias("executor"),
        F.struct(F.lit("gpu-seconds").alias("unit"), F.col("gpu_seconds").cast("double").alias("amount"), F.lit("verifiable").alias("class")).alias("charge"), F.when(nth(23), F.struct(F.when(nth(46), "A B").otherwise("lost").alias("code"), F.lit("gone").alias("message"))).alias("error"),
        F.when(nth(47), "x").alias("kind"), seq.alias("seq"), F.when(nth(13), plain).otherwise(digest).alias("prevHash"), digest.alias("hash"), F.when(nth(61), "m").alias("model"),
    )
    raw = F.to_json(record)
    raw = F.when(nth(59), F.concat(F.lit('{"more":null,'), F.substring(raw, 2, 1 << 20))).otherwise(raw)
    rows = bridge.witness(spark, sf_dir).select("ledger_id", raw.alias("raw"))
    rows = rows.select("ledger_id", "raw", F.from_json("raw", rules.WITNESS).alias("r")).select("ledger_id", "raw", "r.*")
    return records.broken_rules(rows, rules.witness_rules() | rules.witness_text_rules()).select("ledger_id", "seq", F.array_join("broken", ",").alias("broken"))


@register("broken_events", with_(EVENTS) + """
SELECT sequence, concat_ws(',', CASE WHEN sequence % 5 = 0 THEN 'pools' END, CASE WHEN sequence % 11 = 0 THEN 'journal-scope' END, CASE WHEN sequence % 21 = 0 AND sequence % 11 <> 0 AND (sequence % 4 = 0 OR sequence % 13 <> 0) THEN 'projection-needs-scope' END,
       CASE WHEN sequence % 4 = 1 AND sequence % 2 = 0 THEN 'attempt-scope' END, CASE WHEN sequence % 4 = 0 AND sequence % 3 = 0 AND sequence % 13 <> 0 THEN 'wide-scope' END, CASE WHEN sequence % 17 = 0 THEN 'control' END,
       CASE WHEN sequence % 19 = 0 THEN 'exit-code' END, CASE WHEN sequence % 23 = 0 AND event <> 'failed' THEN 'tail-pair' END, CASE WHEN sequence % 23 = 0 AND event <> 'failed' THEN 'tail-event' END,
       CASE WHEN attempt = 0 THEN 'attempt' END) AS broken FROM lifecycle""")
def broken_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """what holds for an event's fields besides the matrix; some are broken by the sequence number."""
    n, nth = F.col("sequence"), lambda k: F.col("sequence") % k == 0
    there = F.lit("x")
    have = {
        "identifier": there, "task_uuid": there, "task_ref": F.when(~nth(13), "c/t"), "journal_scope": F.when(nth(11), "run").otherwise(F.when(~nth(7) | ~nth(3), "00000000-0000-4000-8000-000000000000")),
        "projection_scope": F.when(nth(3), F.when(n % 4 == 0, "pass").when(~nth(13), "task")), "class": there, "source": there, "message": F.lit("two\nlines"), "agent": F.when(nth(17), "a\tb").otherwise("a"), "unit": there, "session_ref": F.lit(None).cast("string"),
        "evidence": there, "executor": there, "pools": F.when(nth(5), F.array(F.lit("b"), F.lit("a"))).otherwise(F.array("pool")), "lease_epoch": F.lit(1), "exit_code": F.when(nth(19), -1).otherwise(0),
        "stderr_tail": F.when(nth(23), "oh"), "stderr_truncated": F.when(nth(23) & (F.col("event") == "failed"), F.lit(False)),
    }
    return records.broken_rules(bridge.lifecycle(spark, sf_dir).withColumns(have), rules.journal_rules()).select("sequence", F.array_join("broken", ",").alias("broken"))


@register("broken_receipts", with_(EVENTS) + """
SELECT sequence, concat_ws(',', CASE WHEN sequence % 7 = 0 THEN 'schema-version' END, CASE WHEN sequence % 11 = 0 THEN 'fields' END, CASE WHEN sequence % 13 = 0 THEN 'identity' END, CASE WHEN sequence % 17 = 0 THEN 'task-id' END, CASE WHEN sequence % 3 < 2 AND attempt NOT IN (1, 2) THEN 'attempt' END,
       CASE WHEN sequence % 3 < 2 AND sequence % 5 = 0 THEN 'redaction' END, CASE WHEN sequence % 3 = 0 AND sequence % 19 = 0 THEN 'diagnosis' END, CASE WHEN sequence % 3 = 0 AND sequence % 23 = 0 THEN 'verdict' END, CASE WHEN sequence % 3 = 1 AND sequence % 19 = 0 THEN 'retry-reason' END,
       CASE WHEN sequence % 3 = 2 AND sequence % 29 = 0 THEN 'authority' END) AS broken FROM lifecycle""")
def broken_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third each are diagnoses, retries and worker outcomes; some are broken by the sequence number."""
    n, nth, kind = F.col("sequence"), lambda k: F.col("sequence") % k == 0, F.col("sequence") % 3
    said = F.when(nth(19), " ").otherwise("it broke")
    common = [F.when(nth(7), 3).otherwise(1).alias("schemaVersion"), F.when(nth(13), n + 1).otherwise(n).alias("sequence"), F.lit("c").alias("campaign"), F.lit("12").alias("issueNumber"), F.when(nth(17), "Task").otherwise("t-1").alias("taskId"), F.when(nth(11), "x").alias("more")]
    tried = [F.col("attempt"), F.when(nth(5), "none").otherwise("conservative-v1").alias("redaction")]
    diagnosis = F.to_json(F.struct(F.lit("diagnosis").alias("kind"), *common, *tried, said.alias("diagnosis"), F.when(nth(23), "maybe").otherwise("blocked").alias("verdict")))
    retry = F.to_json(F.struct(F.lit("retry").alias("kind"), *common, *tried, said.alias("reason")))
    worker = F.to_json(F.struct(F.lit("worker-outcome").alias("kind"), *common, F.lit("sha256:" + "0" * 64).alias("taskRevision"), F.lit("00000000-0000-4000-8000-000000000000").alias("taskUuid"), F.lit("needs-authority").alias("outcome"), F.when(nth(29), F.array().cast("array<string>")).otherwise(F.array(F.lit("a/b"))).alias("paths")))
    worker = F.concat(F.lit('{"reason":null,'), F.substring(worker, 2, 1 << 20))
    rows = bridge.lifecycle(spark, sf_dir).select("sequence", F.when(kind == 0, diagnosis).when(kind == 1, retry).otherwise(worker).alias("raw"), n.alias("expected_sequence"), F.lit("c").alias("expected_campaign"), F.lit("12").alias("expected_issue"))
    return records.broken_rules(rows, rules.receipt_rules()).select("sequence", F.array_join("broken", ",").alias("broken"))


@register("evidence_specs", with_(EVENTS) + """
SELECT sequence, CASE WHEN sequence % 5 = 0 THEN 'artifact-path' WHEN sequence % 7 = 0 THEN 'exit-code' WHEN sequence % 11 = 0 THEN 'exit-twice' END AS fault,
       CASE WHEN sequence % 5 <> 0 AND sequence % 7 <> 0 AND sequence % 11 <> 0 THEN CASE WHEN sequence % 2 = 0 THEN 'any' ELSE 'sha256:' || sha256(sequence::VARCHAR) END END AS hash, CASE WHEN sequence % 5 <> 0 AND sequence % 7 <> 0 AND sequence % 11 <> 0 THEN (sequence % 256)::INT END AS exit FROM lifecycle""")
def evidence_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specs of each record; some are broken by the sequence number."""
    n = F.col("sequence")
    code = F.concat(F.lit("exit:"), F.when(n % 7 == 0, 256).otherwise(n % 256))
    specs = F.array(F.concat(F.when(n % 5 == 0, "artifact:out/").otherwise("artifact:/out/"), n), F.when(n % 2 == 0, "hash:sha256").otherwise(F.concat(F.lit("hash:sha256:"), F.upper(F.sha2(n.cast("string"), 256)))), code)
    specs = F.when(n % 11 == 0, F.concat(specs, F.array(code))).otherwise(specs)
    return bridge.lifecycle(spark, sf_dir).select("sequence", facts.evidence_spec(specs).alias("x")).select("sequence", "x.fault", "x.hash", "x.exit")


@register("broken_pools", with_(POOLS) + """
SELECT pool, concat_ws(',', CASE WHEN slots = 0 THEN 'capacity' END, CASE WHEN coalesce(weekly, 0) * 2 > 100 THEN 'weekly' END, CASE WHEN capacity % 300 = 0 AND (meter IS NOT NULL OR weekly IS NOT NULL) THEN 'meter-needs-window' END) AS broken FROM pools""")
def broken_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """some pools have no slots, others a share beyond all, or a meter without a window."""
    rows = bridge.pools(spark, sf_dir).withColumns({"weekly": F.col("weekly") * 2, "window_cap": F.when(F.col("capacity") % 300 != 0, F.col("capacity"))})
    return records.broken_rules(rows, rules.pool_rules()).select("pool", F.array_join("broken", ",").alias("broken"))


@register("missing_fields", with_(EVENTS) + """
SELECT sequence, event, concat_ws(',', CASE WHEN event <> 'enqueued' AND sequence % 4 = 0 THEN 'agent' END, CASE WHEN event = 'completed' AND NOT gpu_seconds > 20 THEN 'artifact_hash' END,
       CASE WHEN event IN ('completed', 'failed') AND sequence % 3 = 0 THEN 'exit_code' END, CASE WHEN sequence % 50 = 0 THEN 'message' END, CASE WHEN event <> 'enqueued' AND NOT coalesce(context_tokens > 30, FALSE) THEN 'unit' END) AS missing FROM lifecycle""")
def missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the whole matrix."""
    n, there = F.col("sequence"), F.lit("x")
    have = {
        "identifier": there, "task_uuid": there, "class": there, "source": there, "message": F.when(n % 50 != 0, "x"), "agent": F.when(n % 4 != 0, "x"), "lease_epoch": F.lit(1), "unit": F.when(F.col("context_tokens") > 30, "x"),
        "artifact_hash": F.when(F.col("gpu_seconds") > 20, "x"), "exit_code": F.when(n % 3 != 0, 0), "labor_class": there, "evidence": there,
    }
    return records.missing_fields(bridge.lifecycle(spark, sf_dir).withColumns(have), "event", rules.required_fields()).select("sequence", "event", F.array_join("missing", ",").alias("missing"))


@register("broken_capsules", with_(EVENTS) + """
SELECT sequence, concat_ws(',', CASE WHEN sequence % 7 = 0 THEN 'iteration-path' END, CASE WHEN sequence % 5 = 0 THEN 'flow-run-id' END, CASE WHEN coalesce(context_tokens, 0) = 0 THEN 'max-nodes' END, CASE WHEN sequence % 11 = 0 THEN 'node-role' END,
       CASE WHEN sequence % 2 = 0 AND sequence % 11 <> 0 THEN 'subject-needs-role' END, CASE WHEN sequence % 2 = 0 AND sequence % 3 <> 0 THEN 'subject-needs-ref' END, CASE WHEN sequence % 33 = 0 AND sequence % 2 = 1 THEN 'role-needs-subject' END, CASE WHEN sequence % 6 = 0 AND task % 2 = 1 THEN 'subject-matches-ref' END) AS broken FROM lifecycle""")
def broken_capsules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F19."""
    n = F.col("sequence")
    run = F.concat(F.lit("00000000-0000-4000-8000-"), F.when(n % 5 == 0, "x").otherwise(F.lpad(n.cast("string"), 12, "0")))
    capsule = F.to_json(F.struct(
        run.alias("flowRunId"), F.when(n % 7 == 0, "a/b").alias("iterationPath"), F.coalesce("context_tokens", F.lit(0)).alias("maxNodes"),
        F.when(n % 3 == 0, F.concat(F.lit("spec/T"), (F.col("task") % 2).cast("string"))).alias("taskRef"), F.when(n % 2 == 0, "T0").alias("subjectTaskId"), F.when(n % 11 == 0, "painter").alias("nodeRole"),
    ))
    return records.broken_rules(bridge.lifecycle(spark, sf_dir).withColumn("raw", capsule), rules.orchestration_rules()).select("sequence", F.array_join("broken", ",").alias("broken"))


@register("sequence_checks", with_(EVENTS) + """,
r AS (SELECT ledger_id, sequence AS line, sequence // 16 AS sequence FROM lifecycle),
e AS (SELECT *, coalesce(lag(sequence) OVER (PARTITION BY ledger_id ORDER BY line) + 1, sequence) AS expected FROM r)
SELECT ledger_id, line, sequence, expected, sequence = expected AS ok FROM e""")
def sequence_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3."""
    return records.sequence_checks(bridge.lifecycle(spark, sf_dir).select("ledger_id", F.col("sequence").alias("line"), F.floor(F.col("sequence") / 16).alias("sequence")))


@register("capture_records", """
WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM conversations)
SELECT conv_id, turn, i::INT AS "index", CASE WHEN json_valid(raw) THEN 'json' ELSE 'malformed' END AS status FROM l WHERE trim(raw) <> ''""")
def capture_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S10, W25."""
    rows = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("capture"), F.col("text").alias("body"))
    return records.split_records(rows).select("capture.conv_id", "capture.turn", "index", "status")


_LOG = """,
log AS (SELECT 'journal' AS origin, sequence AS number, task FROM lifecycle UNION ALL SELECT 'witness', seq, task FROM witness)
"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    journal = bridge.lifecycle(spark, sf_dir).select(F.lit("journal").alias("origin"), F.col("sequence").alias("number"), "task")
    return journal.unionByName(bridge.witness(spark, sf_dir).select(F.lit("witness").alias("origin"), F.col("seq").alias("number"), "task"))


@register("log_after", with_(WITNESS, EVENTS) + _LOG + "SELECT * FROM log WHERE (origin = 'journal' AND number > 500) OR (origin = 'witness' AND number > 200)")
def log_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3."""
    return records.after_position(_log(spark, sf_dir), 500, 200)


@register("log_ends", with_(WITNESS, EVENTS) + _LOG + 'SELECT origin, min(number) AS "floor", max(number) AS head FROM log GROUP BY origin')
def log_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3."""
    return records.log_ends(_log(spark, sf_dir))


@register("status_changes", with_(EVENTS) + """
SELECT task, sequence, before, event AS status FROM (SELECT *, lag(event) OVER (PARTITION BY task ORDER BY sequence) AS before FROM lifecycle) WHERE before IS DISTINCT FROM event""")
def status_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T14."""
    return records.status_changes(bridge.lifecycle(spark, sf_dir), "task", "sequence", "event")


@register("stalls", with_(EVENTS) + """
SELECT task, sequence, ts, notices FROM (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY task ORDER BY ts, sequence)) // 36000000000 AS notices FROM lifecycle) WHERE notices > 0""")
def stalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T8, as a batch."""
    return records.stalls(bridge.lifecycle(spark, sf_dir), 36_000)


@register("retries_left", with_(EVENTS) + """
SELECT task, sequence, nth, CASE WHEN nth <= 3 THEN 'automatic' ELSE 'exhausted' END AS retry FROM (SELECT task, sequence, row_number() OVER (PARTITION BY task ORDER BY sequence) AS nth FROM lifecycle WHERE event = 'failed')""")
def retries_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T12, as a batch."""
    return records.retries_left(bridge.lifecycle(spark, sf_dir), 3)


@register("digest_mismatches", with_(TASKS) + """,
d AS (SELECT run AS campaign, sha256(string_agg(task::VARCHAR, ',' ORDER BY task)) AS prepared, sha256(string_agg(task::VARCHAR, ',' ORDER BY task) FILTER (WHERE task % 20 <> 3)) AS admitted FROM task_rows GROUP BY run)
SELECT campaign, prepared, admitted FROM d WHERE prepared <> admitted""")
def digest_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A34, H9."""
    digest = lambda df: df.groupBy(F.col("run").alias("campaign")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("task")), ","), 256).alias("digest"))
    rows = bridge.task_rows(spark, sf_dir)
    return records.digest_mismatches(digest(rows), digest(rows.filter("task % 20 <> 3")))


@register("policy_violations", """
WITH n AS (SELECT count(*) FILTER (WHERE NOT length(string_split(text, chr(10))[1]) <= 72) AS long_subject, count(*) FILTER (WHERE NOT regexp_matches(text, '^[A-Z]')) AS no_capital, count(*) FILTER (WHERE regexp_matches(text, '[.]$')) AS ends_in_dot
           FROM conversations WHERE text IS NOT NULL AND text <> '')
SELECT 'long_subject' AS rule, long_subject AS violations FROM n UNION ALL SELECT 'no_capital', no_capital FROM n UNION ALL SELECT 'ends_in_dot', ends_in_dot FROM n""")
def policy_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn read as a commit message."""
    rows = table(spark, sf_dir, "conversations").filter("text IS NOT NULL AND text <> ''")
    rules = {"long_subject": F.length(F.split("text", "\n")[0]) <= 72, "no_capital": F.col("text").rlike("^[A-Z]"), "ends_in_dot": ~F.col("text").rlike(r"[.]\z")}
    return records.rule_counts(rows, rules)


@register("producer_status", with_(EVENTS) + """
SELECT pool AS producer, CASE WHEN arg_max(event, sequence) = 'failed' THEN 'failed' ELSE 'unknown' END AS status, max(ts) FILTER (WHERE event = 'started') AS last_trigger, max(ts) FILTER (WHERE event = 'completed') AS last_emission,
       max(ts) FILTER (WHERE event = 'started') + INTERVAL 1 HOUR AS next_due FROM lifecycle GROUP BY pool""")
def producer_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A37."""
    kind = F.when(F.col("event") == "failed", "error").when(F.col("event") == "started", "trigger").when(F.col("event") == "completed", "emission").otherwise("other")
    return records.producer_status(bridge.lifecycle(spark, sf_dir).select(F.col("pool").alias("producer"), F.col("sequence").alias("n"), kind.alias("kind"), "ts"), 3600)


@register("numbered_log", with_(WITNESS, EVENTS) + _LOG + "SELECT task, origin, count(*) AS n, max(number) AS head FROM log GROUP BY ALL")
def numbered_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both origins of each task's log."""
    return _log(spark, sf_dir).groupBy("task", "origin").agg(F.count("*").alias("n"), F.max("number").alias("head"))


@register("json_digests", """
SELECT event_id, sha256('{"a":[1,{"c":null,"d":' || (user_id % 3) || '}],"k":' || coalesce((props->>'$.k'), 'null') || '}') AS digest FROM events""")
def json_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H7: members come in another order than the canonical one."""
    raw = F.concat(F.lit('{"k": '), F.coalesce(F.get_json_object("props", "$.k"), F.lit("null")), F.lit(', "a": [1, {"d": '), (F.col("user_id") % 3).cast("string"), F.lit(', "c": null}]}'))
    return table(spark, sf_dir, "events").select("event_id", texts.json_digest(raw).alias("digest"))


@register("worker_outcomes", """
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN CASE WHEN event_id % 3 = 0 THEN 'invalid' ELSE 'needs-authority' END WHEN event_id % 4 = 1 THEN CASE WHEN event_id % 5 = 0 THEN 'invalid' ELSE 'impossible' END END AS class FROM events""")
def worker_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter lacks authority, some of these without paths; a quarter is impossible, some with a member too many."""
    n = F.col("event_id")
    authority = F.when(n % 3 == 0, '{"outcome":"needs-authority","paths":[]}').otherwise('{"paths":["b","a"],"outcome":"needs-authority"}')
    impossible = F.when(n % 5 == 0, '{"outcome":"impossible","reason":"x","more":1}').otherwise('{"outcome":"impossible","reason":" no way "}')
    raw = F.when(n % 4 == 0, authority).when(n % 4 == 1, impossible).when(n % 4 == 2, '{"outcome":"done"}')
    return table(spark, sf_dir, "events").select("event_id", texts.worker_outcome(raw)["class"].alias("class"))


@register("redacted_documents")
def redacted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their secrets taken out; tested by hand."""
    return table(spark, sf_dir, "documents").select("doc_id", texts.redacted(F.col("text")).alias("text"))
