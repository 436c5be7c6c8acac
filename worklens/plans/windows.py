"""Queries for budgets in trailing windows and for retries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worklens.operators import records, usage
from worklens.plans import register
from worklens.plans.sql import EVENTS, JUDGED, POOLS, WITNESS, with_
from worklens.sources import bridge

#: Grants: each third event is one; leases come again, and so do admissions under other leases.
_GRANTS = """g AS (SELECT ledger_id, sequence AS n, sequence // 6 AS lease_id, CASE WHEN sequence % 4 <> 0 THEN sequence // 10 END AS admission_key, pool, (sequence % 9)::BIGINT AS amount, ts AS admitted_at FROM lifecycle WHERE sequence % 3 = 0),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ledger_id, lease_id ORDER BY n) AS k FROM g) WHERE k = 1),
d AS (SELECT * EXCLUDE (k, k2) FROM (SELECT *, row_number() OVER (PARTITION BY ledger_id, coalesce('k' || admission_key, 'l' || lease_id) ORDER BY n) AS k2 FROM l) WHERE k2 = 1)"""


def _debits(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("sequence")
    rows = bridge.lifecycle(spark, sf_dir).filter(n % 3 == 0)
    return usage.first_debits(rows.select("ledger_id", n.alias("n"), F.floor(n / 6).alias("lease_id"), F.when(n % 4 != 0, F.floor(n / 10)).alias("admission_key"), "pool", (n % 9).alias("amount"), F.col("ts").alias("admitted_at")))


@register("first_debits", with_(EVENTS, _GRANTS) + "SELECT ledger_id, lease_id, admission_key, n, pool, amount FROM d")
def first_debits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By lease, then by admission key."""
    return _debits(spark, sf_dir).select("ledger_id", "lease_id", "admission_key", "n", "pool", "amount")


@register("window_headroom", with_(EVENTS, POOLS, _GRANTS) + """,
p AS (SELECT pool, slots + 1 AS slots, slots % 3 AS held, CASE WHEN slots % 2 = 0 THEN 86400 * (1 + slots) END AS window_seconds, CASE WHEN slots % 2 = 0 THEN (20 + slots * 10)::BIGINT END AS window_cap, CASE WHEN slots % 2 = 0 THEN meter END AS meter, CASE WHEN slots % 2 = 0 THEN weekly END AS weekly FROM pools),
u AS (SELECT pool, sum(amount)::BIGINT AS used, min(admitted_at + to_seconds(window_seconds)) AS reset_at FROM d JOIN p USING (pool) WHERE admitted_at + to_seconds(window_seconds) > TIMESTAMP '2024-01-28' GROUP BY pool),
f AS (SELECT p.*, used, reset_at, greatest(0, slots - held) AS remaining, CASE WHEN window_cap IS NOT NULL THEN least(coalesce(used, 0), window_cap) * 100.0 / window_cap ELSE least(held, slots) * 100.0 / slots END AS percent,
        CASE WHEN window_cap IS NOT NULL THEN least(greatest(0, window_cap - coalesce(used, 0)), coalesce(floor(window_cap * (100 - meter) / 100), window_cap)) END::BIGINT AS budget FROM p LEFT JOIN u USING (pool))
SELECT pool, used, reset_at, remaining, round(percent, 6)::DOUBLE AS percent, budget, CASE WHEN remaining = 0 OR greatest(percent, coalesce(meter, 0)) >= 90 THEN 'STOP' WHEN greatest(percent, coalesce(meter, 0)) >= 70 OR coalesce(weekly, 0) >= 80 THEN 'SLOW' ELSE 'GO' END AS signal FROM f""")
def window_headroom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pools of even slots have a window of some days, the others count what is held."""
    even, slots = F.col("slots") % 2 == 0, F.col("slots")
    pools = bridge.pools(spark, sf_dir).select("pool", (slots + 1).alias("slots"), (slots % 3).alias("held"), F.when(even, 86_400 * (1 + slots)).alias("window_seconds"), F.when(even, 20 + slots * 10).alias("window_cap"), F.when(even, F.col("meter")).alias("meter"), F.when(even, F.col("weekly")).alias("weekly"))
    spent = usage.window_usage(_debits(spark, sf_dir), pools, F.to_timestamp(F.lit("2024-01-28")).cast("timestamp_ntz"))
    out = usage.project_headroom(pools.join(spent, "pool", "left"))
    return out.select("pool", "used", "reset_at", "remaining", F.round("percent", 6).alias("percent"), F.col("budget").cast("long").alias("budget"), "signal")


@register("retry_plan", with_(WITNESS, JUDGED) + """,
t AS (SELECT ledger_id, seq, task, attempt, CASE WHEN verdict = 'failed' AND lease_epoch % 3 = 0 THEN 'pool-vanished' WHEN verdict = 'failed' AND lease_epoch % 3 = 1 THEN 'runtime-exceeded' ELSE verdict END AS verdict, lease_epoch FROM judged),
k AS (SELECT *, CASE verdict WHEN 'pool-vanished' THEN 'pool-return' WHEN 'preempted' THEN 'resource-return' WHEN 'runtime-exceeded' THEN 'bounded-requeue' END AS "trigger" FROM t)
SELECT ledger_id, seq, task, "trigger", CASE WHEN "trigger" IS NULL THEN 'none' WHEN attempt + 1 > 5 THEN 'exhausted' WHEN "trigger" = 'resource-return' THEN 'manual'
  WHEN "trigger" = 'pool-return' AND lease_epoch % 4 = 1 OR "trigger" = 'bounded-requeue' AND task % 5 = 0 THEN 'automatic' ELSE 'waiting' END AS retry FROM k""")
def retry_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fourth of the pools came back, a fifth of the tasks may be put back; lost resources wait for somebody."""
    rows = bridge.judged(spark, sf_dir)
    lease = F.col("lease_epoch")
    verdict = F.when((F.col("verdict") == "failed") & (lease % 3 == 0), "pool-vanished").when((F.col("verdict") == "failed") & (lease % 3 == 1), "runtime-exceeded").otherwise(F.col("verdict"))
    terminals = rows.select("ledger_id", F.col("task"), "attempt", "seq", verdict.alias("verdict"), F.array(F.concat(F.lit("p"), lease)).alias("pools"))
    back = rows.filter(lease % 4 == 1).select(F.lit("pool-return").alias("kind"), F.concat(F.lit("p"), lease).alias("name")).union(rows.filter("task % 5 = 0").select(F.lit("bounded-requeue"), F.col("task").cast("string"))).distinct()
    return records.retry_plan(terminals, back, {"pool-return": True, "bounded-requeue": True}, 5).select("ledger_id", "seq", "task", "trigger", "retry")
