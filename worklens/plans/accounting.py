"""Queries for usage accounting and for ready sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from worklens.operators import accounting, graphs
from worklens.plans import register, table
from worklens.plans.sql import LINEAGE, TASKS, WITNESS, with_
from worklens.sources import bridge

_FIELDS = ["cacheReadTokens", "costUsd", "inputTokensWithCacheRead", "outputTokens"]
#: Scrapes: a session is a part, its counters rise with seq; by seq some drop, aren't reported, name another attempt or declare other fields.
_SCRAPES = """x AS (
  SELECT *, lag(seq) OVER s AS pred_seq, lag(task) OVER s AS pt, lag(attempt) OVER s AS pa, lag(lease_epoch) OVER s AS pl FROM witness WINDOW s AS (PARTITION BY ledger_id, dedup_key ORDER BY seq)),
scrapes AS (
  SELECT ledger_id, seq, task, attempt, lease_epoch, CASE WHEN dedup_key % 2 = 0 THEN 'even' ELSE 'odd' END AS adapter, CASE WHEN seq % 19 <> 0 THEN 's' || dedup_key END AS session, CASE WHEN dedup_key % 5 = 0 THEN 'attempt' ELSE 'session-cumulative' END AS scope,
         CASE WHEN pt IS NULL OR seq % 10 = 0 THEN 'fresh' ELSE 'resume' END AS mode, pt AS pred_task, pa AS pred_attempt, CASE WHEN seq % 17 = 0 THEN pl + 1000000 ELSE pl END AS pred_lease, pred_seq,
         CASE WHEN seq % 31 = 0 THEN 'legacy' WHEN seq % 37 <> 0 THEN 'accounted' END AS evidence, CASE WHEN seq % 23 = 0 THEN 'outputTokens' ELSE 'cacheReadTokens,costUsd,inputTokensWithCacheRead,outputTokens' END AS declared,
         CASE WHEN seq % 41 = 0 THEN 'not-reported' ELSE 'reported' END AS state, CASE WHEN seq % 29 = 0 THEN 1 WHEN seq % 13 <> 0 THEN seq * 10 END AS inclusive, CASE WHEN seq % 7 <> 0 THEN seq * (1 + seq % 2) END AS cached, seq * 3 AS output, seq / 8 AS cost, CASE WHEN seq % 13 = 0 THEN 'inputTokensWithCacheRead' ELSE '' END AS unreadable FROM x)"""


def _scrapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq, nth = F.col("seq"), lambda k: F.col("seq") % k == 0
    session = Window.partitionBy("ledger_id", "dedup_key").orderBy("seq")
    before = lambda c: F.lag(c).over(session)
    rows = bridge.witness(spark, sf_dir).withColumns({"pred_seq": before("seq"), "pred_task": before("task"), "pred_attempt": before("attempt"), "pred_lease": before("lease_epoch")})
    count = lambda c: c.cast("decimal(20,0)")
    inclusive, cached = F.when(nth(29), 1).when(~nth(13), seq * 10), F.when(~nth(7), seq * (1 + seq % 2))
    none = F.lit(None).cast("decimal(20,0)")
    return rows.select(
        "ledger_id", "seq", "task", "attempt", "lease_epoch", F.when(F.col("dedup_key") % 2 == 0, "even").otherwise("odd").alias("adapter"), F.when(~nth(19), F.concat(F.lit("s"), "dedup_key")).alias("session"), F.when(F.col("dedup_key") % 5 == 0, "attempt").otherwise("session-cumulative").alias("scope"),
        F.when(F.col("pred_task").isNull() | nth(10), "fresh").otherwise("resume").alias("mode"), "pred_task", "pred_attempt", F.when(nth(17), F.col("pred_lease") + 1_000_000).otherwise(F.col("pred_lease")).alias("pred_lease"), "pred_seq",
        F.when(nth(31), "legacy").when(~nth(37), "accounted").alias("evidence"), F.when(nth(23), F.array(F.lit("outputTokens"))).otherwise(F.array(*map(F.lit, _FIELDS))).alias("declared"), F.when(nth(41), "not-reported").otherwise("reported").alias("state"),
        F.when(nth(13), F.array(F.lit("inputTokensWithCacheRead"))).otherwise(F.array().cast("array<string>")).alias("unreadable"), count(F.greatest(F.lit(0), inclusive - cached)).alias("input_tokens"), count(inclusive).alias("input_as_reported"), count(cached).alias("cache_read_tokens"),
        none.alias("cache_write_tokens"), count(seq * 3).alias("output_tokens"), none.alias("reasoning_tokens"), none.alias("stated_total"), (seq / 8).cast("decimal(38,18)").alias("cost_usd"), F.lit("USD").alias("currency"),
    )


@register("usage_deltas", with_(WITNESS, _SCRAPES) + """,
p AS (SELECT ledger_id, task, attempt, lease_epoch, seq AS p_seq, adapter AS p_adapter, session AS p_session, scope AS p_scope, evidence AS p_evidence, declared AS p_declared, state AS p_state, inclusive AS p_inclusive, cached AS p_cached, output AS p_output, cost AS p_cost FROM scrapes),
b AS (
  SELECT s.*, p.* EXCLUDE (ledger_id, task, attempt, lease_epoch), row_number() OVER (PARTITION BY s.ledger_id, s.seq ORDER BY p_seq DESC NULLS LAST) AS k
  FROM scrapes s LEFT JOIN p ON p.ledger_id = s.ledger_id AND p.task = pred_task AND p.attempt = pred_attempt AND p.lease_epoch = pred_lease AND p_seq < s.seq),
g AS (
  SELECT *, scope = 'session-cumulative' AND mode = 'resume' AS delta, declared <> 'outputTokens' AS all_declared,
         CASE WHEN p_seq IS NULL THEN 'missing-predecessor' WHEN p_evidence = 'legacy' THEN 'legacy-predecessor' WHEN p_evidence IS NULL THEN 'missing-predecessor' WHEN p_adapter <> adapter OR p_scope <> scope OR p_declared <> declared THEN 'declaration-mismatch'
              WHEN session IS NULL OR session IS DISTINCT FROM p_session THEN 'session-mismatch' WHEN p_state <> 'reported' THEN 'missing-predecessor' END AS why FROM b WHERE k = 1),
d AS (
  SELECT *, delta AND state = 'reported' AS subtracts, CASE WHEN cached IS NULL THEN 'unreadable-current' WHEN p_cached IS NULL THEN 'missing-predecessor' WHEN cached < p_cached THEN 'counter-underflow' END AS f_cached,
         CASE WHEN inclusive IS NULL THEN 'unreadable-current' WHEN p_inclusive IS NULL THEN 'missing-predecessor' WHEN inclusive < p_inclusive THEN 'counter-underflow' END AS f_inclusive,
         CASE WHEN output < p_output THEN 'counter-underflow' END AS f_output, inclusive - p_inclusive AS di, cached - p_cached AS dc FROM g),
o AS (SELECT *, coalesce(all_declared AND f_inclusive IS NULL AND f_cached IS NULL AND di < dc, false) AS over FROM d),
l AS (
  SELECT *, CASE WHEN subtracts AND why IS NOT NULL THEN declared WHEN subtracts THEN concat_ws(',', CASE WHEN all_declared AND f_cached IS NOT NULL THEN 'cacheReadTokens' END, CASE WHEN all_declared AND (f_inclusive IS NOT NULL OR over) THEN 'inputTokensWithCacheRead' END)
                 WHEN NOT delta AND state = 'reported' AND all_declared THEN unreadable ELSE '' END AS unavailable FROM o)
SELECT ledger_id, seq, CASE WHEN unavailable = '' THEN 'exact' WHEN subtracts AND why IS NOT NULL THEN 'unavailable' ELSE 'partial' END AS state, CASE WHEN delta THEN 'delta' ELSE 'fresh' END AS basis,
       CASE WHEN subtracts AND why IS NOT NULL THEN why WHEN subtracts AND over THEN 'counter-underflow' WHEN subtracts AND all_declared THEN coalesce(f_cached, f_inclusive, f_output) WHEN subtracts THEN f_output WHEN unavailable <> '' THEN 'unreadable-current' END AS reason, unavailable,
       CASE WHEN subtracts THEN CASE WHEN why IS NULL AND all_declared AND f_inclusive IS NULL AND f_cached IS NULL AND NOT over THEN di - dc END WHEN state = 'reported' THEN greatest(0, inclusive - cached) END::BIGINT AS input_tokens,
       CASE WHEN subtracts THEN CASE WHEN why IS NULL AND f_output IS NULL THEN output - p_output END WHEN state = 'reported' THEN output END::BIGINT AS output_tokens,
       CASE WHEN subtracts THEN CASE WHEN why IS NULL AND all_declared THEN cost - p_cost END WHEN state = 'reported' THEN cost END AS cost
FROM l""")
def usage_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative counters less those of the attempt that a scrape names, field by field with reasons."""
    a = accounting.account(_scrapes(spark, sf_dir)).select("ledger_id", "seq", "accounting.*")
    return a.select("ledger_id", "seq", "state", "basis", "reason", F.array_join("unavailable", ",").alias("unavailable"), F.col("input_tokens").cast("long").alias("input_tokens"), F.col("output_tokens").cast("long").alias("output_tokens"), F.col("cost_usd").cast("double").alias("cost"))


@register("usage_bindings", with_(WITNESS, _SCRAPES, """
r AS (SELECT *, CASE WHEN scope = 'attempt' THEN 'attempt' WHEN mode = 'fresh' THEN 'fresh-zero' WHEN seq % 11 = 0 THEN 'baseline-missing' ELSE 'delta' END AS derivation, state = 'reported' AS contributes FROM scrapes)""", """
b AS (
  SELECT r.ledger_id, r.seq, r.derivation, r.contributes, r.pred_seq, CASE WHEN r.derivation = 'delta' THEN coalesce(r.seq % 43 <> 0 AND p.lease_epoch = r.pred_lease AND p.adapter = r.adapter AND p.session = r.session AND p.declared = r.declared AND p.derivation IN ('fresh-zero', 'delta') AND p.contributes, false) END AS bound
  FROM r LEFT JOIN r p ON p.ledger_id = r.ledger_id AND p.seq = r.pred_seq)""", """
c AS (SELECT ledger_id, seq FROM b WHERE derivation IN ('fresh-zero', 'attempt') AND contributes UNION SELECT b.ledger_id, b.seq FROM b JOIN c ON b.ledger_id = c.ledger_id AND b.pred_seq = c.seq WHERE bound)""", recursive=True) + """
SELECT b.ledger_id, b.seq, bound, c.seq IS NOT NULL AS counted FROM b LEFT JOIN c USING (ledger_id, seq)""")
def usage_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that name the one before them in their session; some by a wrong hash, some without a baseline."""
    fresh = (F.col("mode") == "fresh") | (F.col("scope") == "attempt")
    rows = _scrapes(spark, sf_dir).withColumn("derivation", F.when(F.col("scope") == "attempt", "attempt").when(F.col("mode") == "fresh", "fresh-zero").when(F.col("seq") % 11 == 0, "baseline-missing").otherwise("delta"))
    digest = lambda c: F.sha2(F.concat_ws("/", "ledger_id", c), 256)
    named = ["pred_seq", "pred_task", "pred_attempt", "pred_lease"]
    rows = rows.withColumns({"hash": digest("seq"), "pred_hash": F.when(F.col("seq") % 43 != 0, digest("pred_seq")), "contributes": F.col("state") == "reported"} | {c: F.when(~fresh, F.col(c)) for c in named})
    return accounting.bindings(rows)


_ROSTER = """roster AS (SELECT run, task, CASE WHEN task % 9 <> 0 THEN (task % 8)::INT END AS ceiling FROM task_rows)"""


@register("usage_coverage", with_(WITNESS, TASKS, _SCRAPES, _ROSTER) + """,
good AS (SELECT s.*, run, ceiling, attempt >= 1 AND (ceiling IS NULL OR attempt <= ceiling) AS expected FROM scrapes s JOIN roster USING (task) WHERE ledger_id % 4 <> 3),
lanes AS (SELECT run, task, attempt, any_value(ceiling) AS ceiling, any_value(expected) AS expected, count(DISTINCT lease_epoch) AS leases FROM good GROUP BY run, task, attempt),
t AS (SELECT task, sum(leases) AS observed, count(*) FILTER (WHERE expected) AS attested, count(*) FILTER (WHERE NOT expected) AS unexpected, count(*) FILTER (WHERE expected AND ceiling IS NOT NULL AND leases > 1) AS twice FROM lanes GROUP BY task),
c AS (
  SELECT run, count(*) AS tasks, coalesce(sum(ceiling), 0) AS expected, count(*) FILTER (WHERE ceiling IS NULL) AS unknown_ceilings, coalesce(sum(observed), 0) AS observed, coalesce(sum(attested), 0) AS attested, coalesce(sum(unexpected), 0) AS unexpected, coalesce(sum(twice), 0) AS duplicate_leases,
         sum(ceiling - coalesce(attested, 0)) AS missing_attempts, count(*) FILTER (WHERE coalesce(attested, 0) = 0) AS tasks_without_attestation, bool_or(task IN (SELECT task FROM scrapes WHERE ledger_id % 4 = 3)) AS unverified FROM roster LEFT JOIN t USING (task) GROUP BY run),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run, task, attempt ORDER BY seq DESC, ledger_id DESC) AS k FROM good WHERE expected) WHERE k = 1),
f AS (
  SELECT *, evidence = 'accounted' AS acc, evidence = 'accounted' AND state = 'reported' AS said, declared <> 'outputTokens' AS full_, evidence = 'accounted' AND state = 'reported' AND declared <> 'outputTokens' AS fs FROM a),
s AS (
  SELECT run, sum(CASE WHEN fs AND cached IS NOT NULL AND inclusive IS NOT NULL AND unreadable = '' THEN greatest(0, inclusive - cached) END)::BIGINT AS input_tokens, sum(CASE WHEN said THEN output END)::BIGINT AS output_tokens, count(*) FILTER (WHERE fs AND cached IS NOT NULL) AS n_cache_read_tokens,
         round(sum(cost) FILTER (WHERE fs), 4) AS cost, count(*) FILTER (WHERE said) AS reported, count(*) FILTER (WHERE acc AND NOT said) AS not_reported, count(*) FILTER (WHERE evidence = 'legacy') AS legacy, count(*) FILTER (WHERE evidence IS NULL) AS without_record, count(*) FILTER (WHERE fs AND unreadable <> '') AS not_exact,
         count(*) FILTER (WHERE acc) AS d_out, count(*) FILTER (WHERE acc AND full_) AS d_full, count(*) FILTER (WHERE fs AND cached IS NOT NULL) AS r_cached, count(*) FILTER (WHERE fs) AS r_cost, count(*) FILTER (WHERE fs AND inclusive IS NOT NULL AND unreadable = '') AS r_in, count(*) FILTER (WHERE said) AS r_out,
         count(*) FILTER (WHERE acc AND full_ AND unreadable <> '') AS u_in, count(*) FILTER (WHERE fs AND inclusive IS NOT NULL AND unreadable = '' AND cached IS NULL) AS fresh_partial FROM f GROUP BY run)
SELECT run, tasks, expected, unknown_ceilings, observed, attested, unexpected, duplicate_leases, missing_attempts, tasks_without_attestation, input_tokens, output_tokens, n_cache_read_tokens, cost, reported,
  concat_ws(',', CASE WHEN r_cached < d_full THEN 'cacheReadTokens' END, CASE WHEN r_cost < d_full THEN 'costUsd' END, CASE WHEN r_in < d_full THEN 'inputTokensWithCacheRead' END, CASE WHEN r_out < d_out THEN 'outputTokens' END) AS missing_fields,
  concat_ws(',', CASE WHEN unverified THEN 'ledger-unverified' END, CASE WHEN missing_attempts > 0 THEN 'attempts-missing-attestation' END, CASE WHEN unknown_ceilings > 0 THEN 'attempt-counter-unavailable' END, CASE WHEN duplicate_leases > 0 THEN 'duplicate-attempt-leases' END, CASE WHEN unexpected > 0 THEN 'unexpected-attestation' END,
    CASE WHEN tasks_without_attestation > 0 THEN 'members-without-attestation' END, CASE WHEN not_reported > 0 THEN 'attempts-without-usage' END, CASE WHEN r_cached < d_full OR r_in < d_full OR r_out < d_out THEN 'partial-components' END, CASE WHEN without_record > 0 THEN 'unreadable-usage-record' END,
    CASE WHEN legacy > 0 THEN 'legacy-usage-contract,declared-surface-unknown' END, CASE WHEN not_exact > 0 THEN 'accounting-unavailable' END, CASE WHEN u_in > 0 THEN 'unreadable-fields' END, CASE WHEN fresh_partial > 0 THEN 'partial-fresh-input' END, CASE WHEN r_cost < d_full THEN 'partial-cost' END) AS caveats
FROM c LEFT JOIN s USING (run)""")
def usage_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against the roster; a quarter of the ledgers isn't verified."""
    scrapes = _scrapes(spark, sf_dir).withColumn("mode", F.lit("fresh")).drop("pred_task", "pred_attempt", "pred_lease", "pred_seq")
    scrapes = accounting.account(scrapes).withColumn("record", F.col("evidence"))
    roster = bridge.task_rows(spark, sf_dir).select("run", "task", F.when(F.col("task") % 9 != 0, F.col("task") % 8).cast("int").alias("ceiling"))
    verified = bridge.witness(spark, sf_dir).select("ledger_id", (F.col("ledger_id") % 4 != 3).alias("verified")).distinct()
    out = accounting.roll_up(roster, scrapes, verified)
    longs = [F.col(c).cast("long").alias(c) for c in ("input_tokens", "output_tokens")]
    return out.select("run", "tasks", "expected", "unknown_ceilings", "observed", "attested", "unexpected", "duplicate_leases", "missing_attempts", "tasks_without_attestation", *longs, "n_cache_read_tokens", F.round("cost_usd", 4).alias("cost"), "reported", F.coalesce(F.array_join("missing_fields", ","), F.lit("")).alias("missing_fields"), F.array_join("caveats", ",").alias("caveats"))


@register("expected_attempt_rows", with_(WITNESS, TASKS, _ROSTER) + """
SELECT run, e.task, e.attempt, w.task IS NOT NULL AS attested FROM (SELECT run, task, unnest(range(1, ceiling + 1))::INT AS attempt FROM roster WHERE ceiling > 0) e LEFT JOIN (SELECT DISTINCT task, attempt FROM witness) w ON w.task = e.task AND w.attempt = e.attempt""")
def expected_attempt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected attempts as rows, with whether anything attests them."""
    roster = bridge.task_rows(spark, sf_dir).select("run", "task", F.when(F.col("task") % 9 != 0, F.col("task") % 8).cast("int").alias("ceiling"))
    attested = bridge.witness(spark, sf_dir).select("task", "attempt").distinct().withColumn("attested", F.lit(True))
    return accounting.expected(roster).join(attested, ["task", "attempt"], "left").select("run", "task", "attempt", F.coalesce("attested", F.lit(False)).alias("attested"))


@register("missing_identities", with_(WITNESS, TASKS, _ROSTER) + """,
m AS (SELECT run, task, unnest(range(1, ceiling + 1)) AS attempt FROM roster WHERE ceiling > 0),
o AS (SELECT run, task, attempt, row_number() OVER (PARTITION BY run ORDER BY task, attempt) AS k FROM m WHERE (task, attempt) NOT IN (SELECT (task, attempt::BIGINT) FROM witness))
SELECT run, string_agg(task || '#' || attempt, ',' ORDER BY k) AS missing FROM o WHERE k <= 64 GROUP BY run""")
def missing_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 64 of each run; the limit is the feature."""
    roster = bridge.task_rows(spark, sf_dir).select("run", "task", F.when(F.col("task") % 9 != 0, F.col("task") % 8).cast("int").alias("ceiling"))
    return accounting.missing(roster, bridge.witness(spark, sf_dir)).select("run", F.array_join("missing", ",").alias("missing"))


_READY = with_(LINEAGE, "needs AS (SELECT successor AS task, run AS needs FROM lineage)", """
t AS (SELECT c_custkey AS task, c_custkey % 7 < 4 AS done, c_custkey % 50 = 11 AS blocked FROM customer)""", """
e AS (SELECT n.* FROM needs n JOIN t ON t.task = n.needs WHERE NOT t.done)""", """
b AS (SELECT e.task, needs AS root FROM e JOIN t ON t.task = needs WHERE t.blocked UNION SELECT e.task, b.root FROM e JOIN b ON e.needs = b.task)""", """
bad AS (SELECT task FROM t WHERE blocked AND NOT done UNION SELECT task FROM b)""", """
w AS (
  SELECT task, 0 AS wave FROM t WHERE NOT done AND task NOT IN (SELECT task FROM bad) AND task NOT IN (SELECT task FROM e)
  UNION ALL SELECT e.task, wave + 1 FROM w JOIN e ON e.needs = w.task JOIN t ON t.task = e.task WHERE NOT t.done AND e.task NOT IN (SELECT task FROM bad))""", """
s AS (
  SELECT t.task, CASE WHEN done THEN 'done' WHEN t.task IN (SELECT task FROM bad) THEN 'blocked' WHEN x.wave = 0 THEN 'ready' WHEN x.wave IS NOT NULL THEN 'waiting' ELSE 'stuck' END AS status, x.wave
  FROM t LEFT JOIN (SELECT task, max(wave) AS wave FROM w GROUP BY task) x ON x.task = t.task)""", recursive=True)


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    tasks = table(spark, sf_dir, "customer").select(key.alias("task"), (key % 7 < 4).alias("done"), (key % 50 == 11).alias("blocked"))
    return graphs.ready(tasks, bridge.lineage(spark, sf_dir).select(F.col("successor").alias("task"), F.col("run").alias("needs")))


@register("ready_tasks", _READY + "SELECT task, status, wave FROM s")
def ready_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer needs the one before it in its nation; four of seven are done."""
    return _states(spark, sf_dir).select("task", "status", "wave")


@register("settled_campaigns", _READY + """
SELECT task // 20 AS campaign, count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'ready') AS ready, bool_and(status = 'done') AS complete,
       NOT bool_and(status = 'done') AND bool_and(status <> 'ready' AND task % 97 <> 0) AS quiescent FROM s GROUP BY 1""")
def settled_campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty customers are a campaign, each 97th runs."""
    states = _states(spark, sf_dir)
    members = states.select(F.floor(F.col("task") / 20).alias("campaign"), "task")
    return graphs.settled(states, members, states.filter("task % 97 = 0").select("task"))
