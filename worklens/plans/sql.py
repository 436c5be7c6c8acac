"""The bridge of worklens.sources.bridge as SQL, for the oracle."""

WITNESS = """witness AS (
  SELECT l_orderkey // 1024 AS ledger_id,
         row_number() OVER (PARTITION BY l_orderkey // 1024 ORDER BY l_shipdate, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS seq,
         l_orderkey AS task, l_linenumber AS attempt, l_suppkey AS lease_epoch,
         CASE l_returnflag WHEN 'A' THEN 'pass' WHEN 'N' THEN 'failed' WHEN 'R' THEN 'preempted' END AS verdict,
         CASE l_linestatus WHEN 'F' THEN 'fresh' WHEN 'O' THEN 'replay' END AS labor_class,
         l_quantity AS gpu_seconds, l_shipdate AS ts, l_partkey AS dedup_key, l_discount AS discount FROM lineitem)"""
TASKS = """task_rows AS (
  SELECT o_orderkey AS task, o_custkey AS run, substr(o_orderpriority, 1, 1)::INT AS priority,
         CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' WHEN 'P' THEN 'recurring' END AS state,
         o_orderdate AS created, o_totalprice AS budget FROM orders)"""
EVENTS = """lifecycle AS (
  SELECT user_id // 16 AS ledger_id, event_id AS sequence, user_id AS task, (event_id // 2000)::INT AS attempt,
         CASE event_type WHEN 'signup' THEN 'enqueued' WHEN 'view' THEN 'started' WHEN 'click' THEN 'heartbeat' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END AS event,
         ts AS ts, value AS gpu_seconds, 'pool-' || (user_id % 50 + 1) AS pool, (props->>'$.k')::INT AS context_tokens FROM events)"""
MEMBERS = """membership AS (
  SELECT run, task, 1 AS line FROM task_rows UNION ALL SELECT run + 1, task, 2 FROM task_rows WHERE task % 7 = 0)"""
USAGE = """attestations AS (
  SELECT ledger_id, seq, task, attempt, lease_epoch, dedup_key AS session,
         CASE WHEN seq % 5 <> 0 THEN (gpu_seconds * 10)::BIGINT END AS input_tokens, CASE WHEN seq % 3 <> 0 THEN dedup_key % 100 END AS cache_read_tokens,
         CASE WHEN seq % 4 <> 0 THEN lease_epoch % 50 END AS cache_write_tokens, CASE WHEN seq % 6 <> 0 THEN gpu_seconds::BIGINT END AS output_tokens,
         CASE WHEN seq % 11 = 0 THEN (gpu_seconds * 11)::BIGINT END AS declared_total,
         CASE WHEN seq % 13 = 0 THEN 'EUR' ELSE 'USD' END AS currency, discount AS cost FROM witness)"""
LINEAGE = """lineage AS (
  SELECT run, successor FROM (
    SELECT c_custkey AS run, lead(c_custkey) OVER w AS successor FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey))
  WHERE successor IS NOT NULL)"""
POOLS = """pools AS (SELECT 'pool-' || s_suppkey AS pool, (s_suppkey * 50 + 100)::DOUBLE AS capacity, s_suppkey % 9 AS slots, CASE WHEN s_suppkey % 4 = 0 THEN (s_suppkey * 7 % 100)::DOUBLE END AS meter, CASE WHEN s_suppkey % 3 = 0 THEN (s_suppkey * 11 % 100)::DOUBLE END AS weekly FROM supplier)"""

LIVE = """live AS (
  SELECT task, attempt, event AS state FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY sequence DESC) AS n FROM lifecycle) WHERE n = 1 AND event IN ('started', 'heartbeat'))"""
PARENTS = """parents AS (
  SELECT task, parent FROM (SELECT task, lag(task) OVER (PARTITION BY run ORDER BY created, task) AS parent FROM task_rows) WHERE parent IS NOT NULL)"""
PATHS = """paths AS (SELECT page_id, path FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*/([^?#]*)', 1) AS path FROM pages) WHERE path <> '')"""
GRADED = """graded AS (
  SELECT * REPLACE (CASE WHEN event = 'heartbeat' AND sequence % 7 = 0 THEN 'evidence_fail' WHEN event = 'heartbeat' AND sequence % 7 < 3 THEN 'evidence_pass' ELSE event END AS event),
         CASE WHEN sequence % 3 <> 0 THEN sequence % 5 END AS lease_epoch, CASE WHEN sequence % 4 = 0 THEN 'retry' END AS labor_class FROM lifecycle)"""
JUDGED = """judged AS (
  SELECT * REPLACE (CASE WHEN verdict = 'pass' AND discount = 0.05 THEN 'reused' WHEN verdict = 'pass' AND discount = 0.06 THEN 'substituted' WHEN verdict = 'preempted' AND discount < 0.035 THEN 'cancelled' WHEN verdict = 'failed' AND discount = 0.03 THEN 'clean-exit-no-artifact' ELSE verdict END AS verdict,
         CASE WHEN verdict = 'pass' AND discount = 0.05 THEN 'reused' WHEN verdict = 'pass' AND discount = 0.06 THEN 'substituted' ELSE labor_class END AS labor_class) FROM witness)"""


def with_(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n"
