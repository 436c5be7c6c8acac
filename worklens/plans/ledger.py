"""Queries over the ledger tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worklens.functions import predicates as P
from worklens.functions import texts
from worklens.operators import graphs, ledger, usage
from worklens.plans import ORACLES, longs, register, table
from worklens.plans.sql import EVENTS, JUDGED, LINEAGE, MEMBERS, POOLS, TASKS, USAGE, WITNESS, with_
from worklens.sources import bridge


@register("run_gpu_seconds", with_(WITNESS, TASKS) + """
SELECT run, count(*) AS n_records, count(*) FILTER (WHERE verdict = 'pass') AS n_pass, count(*) FILTER (WHERE verdict = 'failed') AS n_failed,
       round(coalesce(sum(gpu_seconds) FILTER (WHERE labor_class = 'fresh' AND verdict NOT IN ('preempted')), 0), 2) AS gpu_seconds
FROM witness JOIN task_rows USING (task) GROUP BY run""")
def run_gpu_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, F12, R11. No seq is asked for, so Catalyst drops the bridge's window."""
    rows = bridge.witness(spark, sf_dir).join(bridge.task_rows(spark, sf_dir).select("task", "run"), "task")
    counted = F.when(P.canonical_gpu(F.col("verdict"), F.col("labor_class")), F.col("gpu_seconds")).otherwise(0.0)
    return rows.groupBy("run").agg(F.count("*").alias("n_records"), F.count_if(F.col("verdict") == "pass").alias("n_pass"), F.count_if(F.col("verdict") == "failed").alias("n_failed"), F.round(F.sum(counted), 2).alias("gpu_seconds"))


@register("jobs_filter", with_(WITNESS) + """
SELECT ledger_id, seq, task, verdict FROM witness
WHERE verdict = 'pass' AND ts >= TIMESTAMP '1999-01-01' AND ts <= TIMESTAMP '2000-01-01' AND lease_epoch % 10 = 7 AND labor_class = 'fresh' AND (dedup_key % 3 = 1 OR task % 5 = 1)""")
def jobs_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record's lease says its pool, its labor the adapter, its keys the origin."""
    rows = bridge.witness(spark, sf_dir).withColumns({
        "last_event_at": F.col("ts"), "terminal_at": F.col("ts"), "terminal_verdict": F.col("verdict"), "adapter": F.col("labor_class"), "pools": F.array(F.concat(F.lit("pool-"), F.col("lease_epoch") % 10)),
        "origin_source": F.when(F.col("dedup_key") % 3 == 1, "forge").otherwise("manual"), "producer": F.when(F.col("task") % 5 == 1, "forge"),
    })
    keep = P.jobs_filter(terminal_verdict="pass", pool="pool-7", adapter="fresh", origin="forge", since=F.to_timestamp(F.lit("1999-01-01")), until=F.to_timestamp(F.lit("2000-01-01")))
    return rows.filter(keep & P.passing(F.col("verdict"))).select("ledger_id", "seq", "task", "verdict")


@register("lifecycle_filter", with_(EVENTS) + """
SELECT sequence, task, event FROM lifecycle WHERE event = 'completed' AND attempt = 1 AND ledger_id % 2 = 0 AND pool = 'pool-3' AND ts >= TIMESTAMP '2024-01-02'
UNION ALL SELECT sequence, task, event FROM lifecycle WHERE event IN ('completed', 'failed') AND context_tokens > 60""")
def lifecycle_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one filter of several fields, and all terminal records of wide contexts."""
    rows = bridge.lifecycle(spark, sf_dir).withColumns({"journal_scope": F.when(F.col("ledger_id") % 2 == 0, "even").otherwise("odd"), "source": F.col("pool")})
    one = rows.filter(P.lifecycle_filter(event="completed", attempt=1, journal_scope="even", source="pool-3", since=F.to_timestamp(F.lit("2024-01-02"))))
    return one.union(rows.filter(P.terminal(F.col("event")) & (F.col("context_tokens") > 60))).select("sequence", "task", "event")


@register("archived_runs", with_(TASKS) + """
SELECT run, count(*) FILTER (WHERE run % 5 <> 0) AS shown, count(*) FILTER (WHERE run % 5 = 0) AS hidden FROM task_rows GROUP BY run""")
def archived_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the latest reader state of a run hides it in broad views; hidden rows are counted."""
    rows = bridge.task_rows(spark, sf_dir)
    marks = rows.select("run", F.lit(1).alias("line"), F.lit(True).alias("archived")).union(rows.select("run", F.lit(2), F.col("run") % 5 == 0)).distinct()
    latest = ledger.argmax(marks, ["run"], "line").select("run", "archived")
    flagged = rows.join(latest, "run", "left").withColumn("archived", F.coalesce("archived", F.lit(False)))
    return flagged.groupBy("run").agg(F.count_if(~F.col("archived")).alias("shown"), F.count_if("archived").alias("hidden"))


@register("governing_witness", with_(WITNESS, EVENTS) + """,
last AS (SELECT task, max(attempt) AS last_attempt FROM lifecycle GROUP BY task),
kept AS (SELECT w.* FROM witness w LEFT JOIN last USING (task) WHERE last_attempt IS NULL OR attempt >= last_attempt)
SELECT task, seq, attempt, verdict FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY seq DESC) AS n FROM kept) WHERE n = 1""")
def governing_witness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3, R1."""
    last = bridge.lifecycle(spark, sf_dir).groupBy("task").agg(F.max("attempt").alias("last_attempt"))
    return ledger.governing_witness(last, bridge.witness(spark, sf_dir)).select("task", "seq", "attempt", "verdict")


@register("latest_witness", with_(WITNESS) + """
SELECT task, attempt, lease_epoch, seq FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY attempt DESC, lease_epoch DESC, seq DESC) AS n FROM witness) WHERE n = 1""")
def latest_witness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W4, R2."""
    return ledger.argmax(bridge.witness(spark, sf_dir), ["task"], "attempt", "lease_epoch", "seq").select("task", "attempt", "lease_epoch", "seq")


@register("journal_state", with_(EVENTS) + """
SELECT task, arg_max(event, (epoch_us(ts), sequence)) AS state, max(attempt) AS max_attempt, coalesce(array_to_string(list_sort(list(DISTINCT attempt) FILTER (WHERE event = 'failed')), ','), '') AS failed_attempts
FROM lifecycle GROUP BY task""")
def journal_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W2, R4."""
    return ledger.journal_state(bridge.lifecycle(spark, sf_dir)).withColumn("failed_attempts", F.array_join("failed_attempts", ","))


@register("milestones", with_(EVENTS) + """
SELECT task, min(ts) FILTER (WHERE event = 'enqueued') AS enqueued_at, min(ts) FILTER (WHERE event = 'started') AS started_at, max(ts) AS last_event_at,
       arg_max(ts, sequence) FILTER (WHERE event IN ('completed', 'failed')) AS terminal_at, count(*) AS n_events FROM lifecycle GROUP BY task""")
def milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W6, W7."""
    return ledger.milestones(bridge.lifecycle(spark, sf_dir))


_SPOKEN = """journal AS (
  SELECT task, sequence AS line, CASE WHEN sequence % 6 <> 0 THEN epoch_us(date_trunc('hour', ts)) END AS us, attempt, event, CASE WHEN sequence % 5 = 0 THEN 'x' || sequence END AS executor, CASE WHEN sequence % 4 = 0 THEN 's' || sequence END AS source, CASE WHEN sequence % 9 = 0 THEN 'j' || sequence END AS session,
         CASE WHEN sequence % 2 = 0 THEN pool END AS pool FROM lifecycle),
seen AS (
  SELECT ledger_id, CASE WHEN seq % 97 <> 0 THEN task END AS task, seq, attempt, verdict, labor_class, gpu_seconds, ts AS at_, CASE WHEN seq % 3 = 0 THEN 'w' || seq END AS executor, CASE WHEN seq % 5 = 0 THEN 't' || seq END AS session, CASE WHEN seq % 4 = 0 THEN 'm' || seq END AS model, CASE WHEN seq % 7 = 0 THEN 'b' || seq END AS brief_hash, 'lease-' || lease_epoch AS pool
  FROM judged WHERE ledger_id = 0 OR seq % 97 <> 0)"""


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, seq = F.col("sequence"), F.col("seq")
    some = lambda c, k, name: F.when(c % k == 0, F.concat(F.lit(name), c))
    rows = bridge.task_rows(spark, sf_dir).select("task", F.when(F.col("task") % 4 == 0, F.col("priority")).alias("attempt"), "state", F.lit("row").alias("executor"), F.when(F.col("task") % 2 == 0, "row").alias("source"), F.lit(None).cast("string").alias("session"), F.lit("row").alias("model"), F.lit("row").alias("pool"))
    us = F.when(n % 6 != 0, F.unix_micros(F.date_trunc("hour", "ts").cast("timestamp")))
    journal = bridge.lifecycle(spark, sf_dir).select("task", n.alias("line"), us.alias("us"), "attempt", "event", some(n, 5, "x").alias("executor"), some(n, 4, "s").alias("source"), some(n, 9, "j").alias("session"), F.when(n % 2 == 0, F.col("pool")).alias("pool"))
    witness = bridge.judged(spark, sf_dir).filter((F.col("ledger_id") == 0) | (seq % 97 != 0)).select(
        "ledger_id", F.when(seq % 97 != 0, F.col("task")).alias("task"), "seq", "attempt", "verdict", "labor_class", "gpu_seconds", F.col("ts").alias("at"), some(seq, 3, "w").alias("executor"), some(seq, 5, "t").alias("session"), some(seq, 4, "m").alias("model"), some(seq, 7, "b").alias("brief_hash"), F.concat(F.lit("lease-"), "lease_epoch").alias("pool")
    )
    return ledger.jobs_v1(rows, journal, witness)


@register("jobs_v1", with_(WITNESS, TASKS, EVENTS, JUDGED, _SPOKEN) + """,
c AS (SELECT *, max(us) OVER (PARTITION BY task ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM journal),
k AS (SELECT *, latest IS NULL OR coalesce(us >= latest, false) AS counts FROM c),
j AS (
  SELECT task, max(attempt) AS attempt, arg_max(event, line) FILTER (WHERE counts) AS state, max(line) FILTER (WHERE counts) AS last_line, arg_max(executor, line) FILTER (WHERE counts AND executor IS NOT NULL) AS executor, arg_min(source, line) FILTER (WHERE counts AND source IS NOT NULL) AS source,
         arg_max(session, line) FILTER (WHERE counts AND session IS NOT NULL) AS session, arg_max(pool, line) FILTER (WHERE counts AND pool IS NOT NULL) AS pool FROM k GROUP BY task),
o AS (
  SELECT task::VARCHAR AS anchor, r.state AS r_state, j.state AS j_state, greatest(CASE WHEN task % 4 = 0 THEN r.priority END, j.attempt) AS last_attempt, j.executor AS j_executor, CASE WHEN r.task IS NOT NULL THEN 'row' END AS r_any, CASE WHEN r.task % 2 = 0 THEN 'row' END AS r_source, j.source AS j_source, j.session AS j_session, j.pool AS j_pool,
         (SELECT us FROM journal x WHERE x.line = j.last_line) AS us FROM task_rows r FULL JOIN j USING (task)),
w AS (SELECT coalesce(s.task::VARCHAR, 'witness:' || seq) AS anchor, s.* FROM seen s),
g AS (SELECT w.* FROM w LEFT JOIN o USING (anchor) WHERE last_attempt IS NULL OR attempt >= last_attempt),
b AS (
  SELECT anchor, max(seq) AS seq, arg_max(attempt, seq) AS attempt, arg_max(verdict, seq) AS verdict, arg_max(labor_class, seq) AS labor_class, arg_max(gpu_seconds, seq) AS gpu_seconds, arg_max(at_, seq) AS at_, arg_max(pool, seq) AS pool, arg_max(executor, seq) FILTER (WHERE executor IS NOT NULL) AS executor,
         arg_max(session, seq) FILTER (WHERE session IS NOT NULL) AS session, arg_max(model, seq) FILTER (WHERE model IS NOT NULL) AS model, arg_max(brief_hash, seq) FILTER (WHERE brief_hash IS NOT NULL) AS brief_hash FROM g GROUP BY anchor)
SELECT anchor, CASE WHEN b.seq IS NOT NULL THEN 'terminal' ELSE coalesce(j_state, r_state) END AS state, verdict, last_attempt, b.attempt AS witness_attempt, b.seq AS witness_seq, labor_class, coalesce(b.executor, j_executor, r_any) AS executor, coalesce(r_source, j_source) AS source, coalesce(b.session, j_session) AS session,
       coalesce(model, r_any) AS model, brief_hash, CASE WHEN b.seq IS NOT NULL THEN b.pool ELSE coalesce(j_pool, r_any) END AS pool, gpu_seconds, CASE WHEN labor_class = 'fresh' AND verdict NOT IN ('clean-exit-no-artifact', 'preempted', 'cancelled', 'substituted') THEN gpu_seconds END AS canonical_gpu_seconds,
       CASE WHEN b.seq IS NOT NULL THEN at_ ELSE make_timestamp(us) END AS last_event_at, CASE WHEN b.seq IS NOT NULL THEN 'witness' ELSE 'queue' END AS scope
FROM o FULL JOIN b USING (anchor)""")
def jobs_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journal times are of whole hours and some are null, so that ties and the order of the file decide; some witnesses have no task."""
    return _jobs(spark, sf_dir)


@register("scoped_jobs", f"SELECT anchor, state, last_attempt, 'queue' AS asked FROM ({ORACLES['jobs_v1']}) WHERE scope = 'queue' UNION ALL SELECT anchor, verdict, witness_attempt, 'witness' FROM ({ORACLES['jobs_v1']}) WHERE scope = 'witness'")
def scoped_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """jobs of the queue, and those of the witness."""
    jobs = _jobs(spark, sf_dir)
    of = lambda scope, state, attempt: ledger.in_scope(jobs, scope).select("anchor", F.col(state).alias("state"), F.col(attempt).alias("last_attempt"), F.lit(scope).alias("asked"))
    return of("queue", "state", "last_attempt").union(of("witness", "verdict", "witness_attempt"))


@register("echo_collapse", with_(WITNESS, EVENTS) + """,
b AS (
  SELECT 'journal' AS origin, task, attempt, CASE WHEN task % 3 = 0 THEN attempt END AS lease_epoch, NULL AS ledger, sequence AS number, ts, event IN ('completed', 'failed') AS terminal, NULL AS v, NULL AS l, gpu_seconds AS g FROM lifecycle
  UNION ALL SELECT 'witness', task, attempt, CASE WHEN task % 3 = 0 THEN attempt END, ledger_id, seq, ts, false, verdict, labor_class, gpu_seconds FROM witness),
k AS (SELECT *, row_number() OVER (PARTITION BY task, attempt, lease_epoch, origin ORDER BY ledger, number) AS k, max(number) FILTER (WHERE terminal) OVER (PARTITION BY task, attempt, lease_epoch) AS last FROM b),
f AS (
  SELECT *, max(number) FILTER (WHERE origin = 'witness' AND k = 1) OVER lane AS n1, max(v) FILTER (WHERE origin = 'witness' AND k = 1) OVER lane AS v1, max(l) FILTER (WHERE origin = 'witness' AND k = 1) OVER lane AS l1, max(g) FILTER (WHERE origin = 'witness' AND k = 1) OVER lane AS g1
  FROM k WINDOW lane AS (PARTITION BY task, attempt, lease_epoch)),
m AS (SELECT *, coalesce(terminal AND number = last AND n1 IS NOT NULL, false) AS merged FROM f WHERE NOT (origin = 'witness' AND k = 1 AND last IS NOT NULL))
SELECT CASE WHEN merged THEN 'journal+witness' ELSE origin END AS origin, task, attempt, lease_epoch, number, ts, CASE WHEN merged THEN coalesce(v1, v) ELSE v END AS verdict, CASE WHEN merged THEN coalesce(l1, l) ELSE l END AS labor_class,
       CASE WHEN merged THEN coalesce(g1, g) ELSE g END AS gpu_seconds, CASE WHEN merged THEN n1 WHEN origin = 'witness' THEN number END AS witness_seq FROM m""")
def echo_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks of two thirds have no lease, which matches as null."""
    lease = F.when(F.col("task") % 3 == 0, F.col("attempt"))
    return ledger.echo_collapse(bridge.lifecycle(spark, sf_dir).withColumn("lease_epoch", lease), bridge.witness(spark, sf_dir).withColumn("lease_epoch", lease))


@register("dedup_probe", with_(WITNESS) + """,
hit AS (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY seq DESC, ledger_id DESC) AS n FROM witness WHERE verdict = 'pass' AND discount <> 0.05 AND lease_epoch % 3 <> 0)
SELECT p_partkey AS dedup_key, task, attempt, seq, task IS NOT NULL AS found FROM part LEFT JOIN (SELECT * FROM hit WHERE n = 1) h ON p_partkey = dedup_key""")
def dedup_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some records were reused, a third have no content; neither is found."""
    rows = bridge.witness(spark, sf_dir).withColumns({"verdict": F.when((F.col("verdict") == "pass") & (F.col("discount") == 0.05), "reused").otherwise(F.col("verdict")), "has_content": F.col("lease_epoch") % 3 != 0})
    return ledger.dedup_probe(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("dedup_key")), rows)


@register("run_members", with_(TASKS, MEMBERS) + """
SELECT run, count(DISTINCT task) AS n_tasks FROM (SELECT run, task FROM task_rows UNION SELECT run, task FROM membership) GROUP BY run""")
def run_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U2, R8."""
    members = ledger.run_members(bridge.task_rows(spark, sf_dir), bridge.membership(spark, sf_dir))
    return members.groupBy("run").agg(F.count("*").alias("n_tasks"))


@register("first_membership", with_(TASKS, MEMBERS) + "SELECT task, arg_min(run, (line, run)) AS run FROM membership GROUP BY task")
def first_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W17, J36."""
    return ledger.first_membership(bridge.membership(spark, sf_dir))


@register("log_order_page", with_(WITNESS, EVENTS) + """,
log AS (
  SELECT 'journal' AS origin, 1 AS r, CASE WHEN sequence % 50 <> 0 THEN date_trunc('day', ts) END AS ts, sequence AS number, 'e' || task AS event_id FROM lifecycle
  UNION ALL SELECT 'witness', 2, CASE WHEN seq % 50 <> 0 THEN TIMESTAMP '2024-01-01' + to_days((seq % 40)::INT) END, seq, ledger_id || '/' || seq FROM witness)
SELECT origin, ts, number, event_id FROM log WHERE ts > TIMESTAMP '2024-01-07' OR (ts = TIMESTAMP '2024-01-07' AND (r > 1 OR (r = 1 AND number > 2500))) ORDER BY ts, r, number, event_id LIMIT 1000""")
def log_order_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1, O3: both origins, past a place in the log; the limit is the page."""
    n, seq = F.col("sequence"), F.col("seq")
    journal = bridge.lifecycle(spark, sf_dir).select(F.lit("journal").alias("origin"), F.when(n % 50 != 0, F.date_trunc("day", "ts").cast("timestamp_ntz")).alias("ts"), n.alias("number"), F.concat(F.lit("e"), "task").alias("event_id"))
    day = F.expr("TIMESTAMP_NTZ '2024-01-01' + make_dt_interval(cast(seq % 40 AS int))")
    witness = bridge.witness(spark, sf_dir).select(F.lit("witness").alias("origin"), F.when(seq % 50 != 0, day).alias("ts"), seq.alias("number"), F.concat_ws("/", "ledger_id", "seq").alias("event_id"))
    log = ledger.log_key(journal.union(witness))
    cursor = F.struct(F.expr("TIMESTAMP_NTZ '2024-01-07'").alias("ts"), F.lit(1).alias("origin"), F.lit(2500).cast("long").alias("number"), F.lit("\U0010ffff").alias("event_id"))
    return ledger.page(log, F.col("place") > cursor, [F.col("place")], 1000).select("origin", "ts", "number", "event_id")


@register("sequence_gaps", with_(EVENTS) + """,
r AS (SELECT ledger_id, sequence // 16 + sequence % 3 AS seq, sequence AS line FROM lifecycle),
s AS (SELECT *, lag(seq) OVER (PARTITION BY ledger_id ORDER BY line) AS before, count(*) OVER (PARTITION BY ledger_id, seq) AS copies FROM r),
g AS (SELECT ledger_id, min(seq + 1) AS first_gap FROM (SELECT ledger_id, seq, lead(seq) OVER (PARTITION BY ledger_id ORDER BY seq) AS next FROM (SELECT DISTINCT ledger_id, seq FROM r)) WHERE next > seq + 1 GROUP BY ledger_id)
SELECT *, out_of_order = 0 AND repeated = 0 AND first_gap IS NULL AS ok FROM (
  SELECT ledger_id, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq, count(*) FILTER (WHERE seq < before) AS out_of_order, count(*) FILTER (WHERE copies > 1) AS repeated FROM s GROUP BY ledger_id) LEFT JOIN g USING (ledger_id)""")
def sequence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W12, W13, A23."""
    rows = bridge.lifecycle(spark, sf_dir)
    return ledger.sequence_gaps(rows.select("ledger_id", (F.floor(F.col("sequence") / 16) + F.col("sequence") % 3).alias("seq"), F.col("sequence").alias("line")))


@register("compare_ledgers", with_(WITNESS) + """,
a AS (SELECT task, attempt, max(seq) AS seq, count(*) AS n FROM witness WHERE task % 10 <> 3 GROUP BY ALL),
b AS (SELECT task, attempt, max(seq) AS seq, count(*) FILTER (WHERE lease_epoch <> 5) AS n FROM witness WHERE task % 10 <> 4 GROUP BY ALL)
SELECT coalesce(a.task, b.task) AS task, coalesce(a.attempt, b.attempt) AS attempt,
       CASE WHEN b.task IS NULL THEN 'missing' WHEN a.task IS NULL THEN 'orphan' WHEN a.n <> b.n THEN 'differs' ELSE 'agrees' END AS status,
       CASE WHEN a.task IS NOT NULL AND b.task IS NOT NULL THEN CASE WHEN a.n <> b.n THEN 'n' ELSE '' END END AS fields
FROM a FULL JOIN b ON a.task = b.task AND a.attempt = b.attempt""")
def compare_ledgers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J7, U5, J27."""
    rows = bridge.witness(spark, sf_dir)
    ours = rows.filter("task % 10 <> 3").groupBy("task", "attempt").agg(F.max("seq").alias("seq"), F.count("*").alias("n"))
    theirs = rows.filter("task % 10 <> 4").groupBy("task", "attempt").agg(F.max("seq").alias("seq"), F.count_if(F.col("lease_epoch") != 5).alias("n"))
    return ledger.compare_ledgers(ours, theirs, ["task", "attempt"], ["seq", "n"])


_LAST = """,
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task, attempt ORDER BY seq DESC, ledger_id DESC) AS n FROM attestations) WHERE n = 1)
"""


@register("usage_rollup", with_(WITNESS, USAGE, TASKS) + _LAST + """
SELECT run, count(*) AS attempts, sum(input_tokens)::BIGINT AS input_tokens, sum(cache_read_tokens)::BIGINT AS cache_read_tokens, sum(cache_write_tokens)::BIGINT AS cache_write_tokens, sum(output_tokens)::BIGINT AS output_tokens,
       count(input_tokens) AS n_input_tokens, count(cache_read_tokens) AS n_cache_read_tokens, count(cache_write_tokens) AS n_cache_write_tokens, count(output_tokens) AS n_output_tokens,
       sum(input_tokens + cache_write_tokens)::BIGINT AS fresh_input, count(input_tokens + cache_write_tokens) AS n_fresh_input,
       sum(CASE WHEN known THEN coalesce(declared_total, coalesce(input_tokens, 0) + coalesce(cache_read_tokens, 0) + coalesce(cache_write_tokens, 0) + coalesce(output_tokens, 0)) END)::BIGINT AS total_tokens,
       CASE WHEN bool_or(declared_total IS NOT NULL) AND bool_or(declared_total IS NULL AND known) THEN 'mixed' WHEN bool_or(declared_total IS NOT NULL) THEN 'harness' WHEN bool_or(declared_total IS NULL AND known) THEN 'derived' END AS total_source, false AS saturated,
       round(sum(cost) FILTER (WHERE currency = 'USD'), 6) AS cost_usd, count(*) FILTER (WHERE currency <> 'USD') AS n_other_currency
FROM (SELECT *, declared_total IS NOT NULL OR coalesce(input_tokens, cache_read_tokens, cache_write_tokens, output_tokens) IS NOT NULL AS known FROM last) JOIN task_rows USING (task) GROUP BY run""")
def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 to A5, W15, R5, R14."""
    last = usage.last_attestation(bridge.attestations(spark, sf_dir))
    return longs(usage.roll_up(last.join(bridge.task_rows(spark, sf_dir).select("task", "run"), "task"), "run"))


@register("field_coverage", with_(WITNESS, USAGE, TASKS) + """,
long AS (UNPIVOT (SELECT run, coalesce(input_tokens, -1) AS input_tokens, coalesce(cache_read_tokens, -1) AS cache_read_tokens, coalesce(cache_write_tokens, -1) AS cache_write_tokens, coalesce(output_tokens, -1) AS output_tokens
                  FROM attestations JOIN task_rows USING (task)) ON input_tokens, cache_read_tokens, cache_write_tokens, output_tokens INTO NAME field VALUE v)
SELECT run, field, count(*) FILTER (WHERE v >= 0) AS reported, count(*) FILTER (WHERE v < 0) AS unreported FROM long GROUP BY run, field""")
def field_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6, A10."""
    rows = bridge.attestations(spark, sf_dir).join(bridge.task_rows(spark, sf_dir).select("task", "run"), "task")
    return usage.field_coverage(rows, "run")


@register("missing_attempts", with_(WITNESS) + """,
top AS (SELECT task, max(attempt) AS top FROM witness GROUP BY task),
gone AS (SELECT task, a FROM (SELECT task, unnest(range(1, top + 1)) AS a FROM top) ANTI JOIN (SELECT DISTINCT task, attempt AS a FROM witness) USING (task, a))
SELECT task, count(*) AS n_missing, string_agg(a::VARCHAR, ',' ORDER BY a) AS missing FROM gone GROUP BY task""")
def missing_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7, A8, X5."""
    return usage.missing_attempts(bridge.witness(spark, sf_dir))


@register("trailing_debit", with_(EVENTS) + """
SELECT pool, sequence, round(sum(gpu_seconds) OVER (PARTITION BY pool ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW), 4) AS in_window FROM lifecycle""")
def trailing_debit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W19, A26."""
    return usage.trailing_debit(bridge.lifecycle(spark, sf_dir), 3600)


@register("first_grants", with_(EVENTS) + """
SELECT task, attempt, sequence, pool, gpu_seconds, ts FROM (SELECT *, row_number() OVER (PARTITION BY task, attempt ORDER BY sequence) AS n FROM lifecycle) WHERE n = 1""")
def first_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W14."""
    return usage.first_grants(bridge.lifecycle(spark, sf_dir))


@register("pool_headroom", with_(EVENTS, POOLS) + """,
lane AS (SELECT pool, task, attempt, max(sequence) FILTER (WHERE event = 'started') AS began, max(sequence) FILTER (WHERE event = 'enqueued') AS asked,
                max(sequence) FILTER (WHERE event IN ('completed', 'failed')) AS ended, sum(gpu_seconds) FILTER (WHERE event = 'started') AS spent FROM lifecycle GROUP BY ALL),
f AS (SELECT pool, spent, began IS NOT NULL AND (ended IS NULL OR ended < began) AS holds, asked IS NOT NULL AND (began IS NULL OR began < asked) AND (ended IS NULL OR ended < asked) AS waits FROM lane),
held AS (SELECT pool, count(*) FILTER (WHERE holds) AS held, count(*) FILTER (WHERE waits) AS queued, sum(spent) FILTER (WHERE holds) AS used FROM f GROUP BY pool),
t AS (SELECT p.*, coalesce(held, 0) AS held, coalesce(queued, 0) AS queued, round(coalesce(used, 0), 4) AS used FROM pools p LEFT JOIN held USING (pool)),
p AS (SELECT *, floor(used * 100 / capacity)::BIGINT AS percent, greatest(0, slots - held) AS remaining FROM t)
SELECT *, CASE WHEN remaining <= 0 OR greatest(percent, coalesce(meter, 0)) >= 90 THEN 'STOP' WHEN greatest(percent, coalesce(meter, 0)) >= 70 OR coalesce(weekly, 0) >= 80 THEN 'SLOW' ELSE 'GO' END AS allows FROM p""")
def pool_headroom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A26 to A28, H25."""
    return usage.pool_headroom(bridge.lifecycle(spark, sf_dir), bridge.pools(spark, sf_dir))


@register("fair_interleave", with_(TASKS) + """
SELECT task, run, priority, row_number() OVER (PARTITION BY priority, run ORDER BY created, task) AS nth,
       first_value(task) OVER (PARTITION BY priority, run ORDER BY created, task) AS oldest FROM task_rows""")
def fair_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W20."""
    return usage.interleaved(bridge.task_rows(spark, sf_dir), "run").select("task", "run", "priority", "nth", "oldest")


@register("lineage_heads", with_(LINEAGE, """walk AS (
  SELECT run, successor AS head, 1 AS steps FROM lineage UNION ALL SELECT w.run, l.successor, steps + 1 FROM walk w JOIN lineage l ON w.head = l.run)""", recursive=True) + """
SELECT run, arg_max(head, steps) AS head, max(steps) AS steps FROM walk GROUP BY run""")
def lineage_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J15."""
    return graphs.heads(bridge.lineage(spark, sf_dir))


@register("lineage_conflicts", with_(TASKS, "e AS (SELECT DISTINCT run, run + priority - 2 AS successor FROM task_rows)", "f AS (SELECT run, min(successor) AS next FROM e GROUP BY run)", """
walk AS (SELECT run AS start, next AS at_ FROM f UNION SELECT start, f.next FROM walk JOIN f ON f.run = at_)""", recursive=True) + """
SELECT run, 'second-successor' AS problem FROM e GROUP BY run HAVING count(*) > 1
UNION ALL SELECT successor, 'second-predecessor' FROM e GROUP BY successor HAVING count(*) > 1
UNION ALL SELECT run, 'self-edge' FROM e WHERE run = successor
UNION ALL SELECT start, 'cycle' FROM walk WHERE start = at_""")
def lineage_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J16."""
    edges = bridge.task_rows(spark, sf_dir).select("run", (F.col("run") + F.col("priority") - 2).alias("successor")).distinct()
    return graphs.conflicts(edges)


@register("blocked_roots", with_(LINEAGE, """needs AS (SELECT successor AS task, run AS needs FROM lineage)""", """
closure AS (SELECT task, needs AS root FROM needs WHERE needs % 9 = 0 UNION SELECT n.task, c.root FROM needs n JOIN closure c ON n.needs = c.task)""", recursive=True) + "SELECT task, root FROM closure")
def blocked_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A32."""
    edges = bridge.lineage(spark, sf_dir).select(F.col("successor").alias("task"), F.col("run").alias("needs"))
    return graphs.blocked_by(edges, edges.filter("needs % 9 = 0").select(F.col("needs").alias("task")).distinct())


@register("gate_budget", with_(WITNESS, TASKS) + """
SELECT priority, CASE WHEN max(gpu_seconds) IS NULL THEN 3600 ELSE greatest(60, floor(max(gpu_seconds) * 2)) END::DOUBLE AS budget FROM task_rows LEFT JOIN witness USING (task) GROUP BY priority""")
def gate_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A25."""
    rows = bridge.task_rows(spark, sf_dir).select("task", "priority").join(bridge.witness(spark, sf_dir).select("task", "gpu_seconds"), "task", "left")
    most = F.max("gpu_seconds")
    return rows.groupBy("priority").agg(F.when(most.isNull(), F.lit(3600.0)).otherwise(F.greatest(F.lit(60.0), F.floor(most * 2).cast("double"))).alias("budget"))


@register("secret_lines", r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
t AS (SELECT doc_id, line, list_transform(regexp_split_to_array(line, '[\s\x{1c}-\x{1f}\x{85}\p{Z}]+'), lambda p: trim(p, '"`()[]{},;' || chr(39))) AS tokens FROM l),
f AS (SELECT doc_id, regexp_matches(lower(line), '(' || array_to_string(['authorization', 'bearer', 'token', 'secret', 'password', 'passwd', 'credential', 'credentials', 'api_key', 'api-key', 'apikey', 'private key', 'access key', 'access_key', 'secret_key', 'client_secret', 'client key', 'cookie', 'dsn', 'session_id', 'sessionid'], '|') || ')[''"` \t]*[:=]') AS marked,
  len(list_filter(tokens, lambda t: regexp_matches(lower(t), '^(ghp_|gho_|ghu_|ghs_|ghr_|github_pat_|sk-|xoxb-|xoxp-|xoxa-|xoxr-)') OR (regexp_matches(t, '^A[KS]IA') AND length(t) >= 16) OR (contains(t, '://') AND (contains(t, '@') OR contains(t, '?')))
    OR regexp_full_match(t, '[^.]{8,}\.[^.]{8,}\.[^.]{8,}') OR (length(t) >= 32 AND CASE WHEN regexp_full_match(t, '[0-9A-Fa-f]+') THEN NOT regexp_full_match(t, '[0-9a-f]{40}|[0-9a-f]{64}')
      ELSE regexp_full_match(t, '[A-Za-z0-9+/_=-]+') AND regexp_matches(t, '[0-9]') AND ((regexp_matches(t, '[a-z]') AND regexp_matches(t, '[A-Z]')) OR length(t) >= 40) END))) > 0 AS shaped FROM t)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE marked) AS marked, count(*) FILTER (WHERE shaped) AS shaped, count(*) FILTER (WHERE marked OR shaped) AS redacted FROM f GROUP BY doc_id""")
def secret_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line's two signs are found once, in the row's own array, and added up from there."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    signs = F.transform(lines, lambda x: texts.marked_line(x).cast("int") + 2 * texts.holds_token(x).cast("int"))
    found = table(spark, sf_dir, "documents").select("doc_id", signs.alias("signs"))
    n = lambda *which: F.size(F.filter("signs", lambda x: x.isin(*which))).cast("long")
    return found.select("doc_id", F.size("signs").cast("long").alias("n_lines"), n(1, 3).alias("marked"), n(2, 3).alias("shaped"), n(1, 2, 3).alias("redacted"))


@register("event_windows", with_(EVENTS) + """
SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event, pool, count(*) AS n, round(sum(gpu_seconds), 4) AS gpu_seconds FROM lifecycle GROUP BY ALL""")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T15, as a batch."""
    rows = bridge.lifecycle(spark, sf_dir)
    return rows.groupBy(F.window("ts", "1 hour").alias("w"), "event", "pool").agg(F.count("*").alias("n"), F.round(F.sum("gpu_seconds"), 4).alias("gpu_seconds")).select(F.col("w.start").alias("start"), "event", "pool", "n", "gpu_seconds")


@register("retention_plan", with_(EVENTS) + """
SELECT ledger_id, count(*) AS examined, min(sequence) FILTER (WHERE ts >= TIMESTAMP '2024-01-15') AS boundary,
       count(*) FILTER (WHERE sequence < b) AS dropped, count(*) FILTER (WHERE sequence >= b) AS kept
FROM (SELECT *, min(sequence) FILTER (WHERE ts >= TIMESTAMP '2024-01-15') OVER (PARTITION BY ledger_id) AS b FROM lifecycle) GROUP BY ledger_id""")
def retention_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prefix goes, from the first record inside the horizon on everything stays."""
    rows = bridge.lifecycle(spark, sf_dir)
    first = F.min(F.when(F.col("ts") >= F.to_timestamp(F.lit("2024-01-15")), F.col("sequence")))
    bounds = rows.groupBy("ledger_id").agg(first.alias("boundary"))
    return rows.join(bounds, "ledger_id").groupBy("ledger_id", "boundary").agg(F.count("*").alias("examined"), F.count_if(F.col("sequence") < F.col("boundary")).alias("dropped"), F.count_if(F.col("sequence") >= F.col("boundary")).alias("kept"))


@register("execution_ids", with_(WITNESS) + """
SELECT DISTINCT task, attempt, lease_epoch, sha256('{"taskUuid":' || task || ',"attempt":' || attempt || ',"leaseEpoch":' || lease_epoch || '}') AS execution_id FROM witness""")
def execution_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H8, H9, H10."""
    lanes = bridge.witness(spark, sf_dir).select(*ledger.LANE).distinct()
    return lanes.withColumn("execution_id", P.execution_id(F.col("task"), F.col("attempt"), F.col("lease_epoch")))


@register("url_slugs", """
SELECT page_id, regexp_replace(left(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 48), '-+$', '', 'g') AS slug FROM pages""")
def url_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H11."""
    return table(spark, sf_dir, "pages").select("page_id", P.slug(F.col("url")).alias("slug"))


@register("clipped_turns", """
SELECT conv_id, turn, CASE WHEN length(f) > 80 THEN left(f, 77) || '...' ELSE f END AS shown FROM (SELECT conv_id, turn, trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')) AS f FROM conversations)""")
def clipped_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H13."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", P.clipped(F.col("text"), 80).alias("shown"))
