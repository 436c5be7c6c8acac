"""Queries for declared captures: conversations as the outputs of three adapters, each declared in its own way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worklens.operators import captures
from worklens.plans import register, table

#: The declarations, as a table would hold them: paths by line, paths over all lines, and regular expressions over the whole output.
DECLARED = [
    ("turns", "sessionRef", "$..thread_id", "stdout", "jsonPath", {}),
    ("turns", "finalMessage", "$[?@.type == 'item' && @.role != 'tool'].text", "stdout", "jsonPathLast", {}),
    ("turns", "usage", "$..usage", "stdout", "jsonPath", {"inputTokensWithCacheRead": ["input_tokens"], "cacheReadTokens": ["details.0", "cached"], "outputTokens": ["output_tokens"], "costUsd": ["cost"]}),
    ("sums", "usage", "$[?@.type == 'result' || @.type == 'partial'].usage", "stdout", "jsonPathLast", {}),
    ("plain", "sessionRef", "^session=(.+)$", "stdout", "regex", {}),
    ("plain", "note", "first: (\\w+)\\nsession=", "stdout", "regex", {}),
    ("plain", "usage", "^tokens: (\\d+)$", "stdout", "regex", {"totalTokens": ["$"]}),
]
_SCHEMA = "adapter string, name string, pattern string, stream string, mode string, fields map<string,array<string>>"

_OUT = """
WITH t AS (SELECT conv_id, turn, role, length(text) AS n FROM conversations WHERE turn IS NOT NULL),
a AS (SELECT conv_id AS task, ['turns', 'sums', 'plain'][conv_id % 3 + 1] AS adapter, max(turn) AS last, arg_max(n, turn) FILTER (WHERE role = 'assistant') AS n, max(turn) FILTER (WHERE role = 'assistant') AS said, arg_max(n, turn) AS any_n, max(turn) FILTER (WHERE role <> 'assistant') AS asked FROM t GROUP BY conv_id)
"""


def _outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task, attempt, lease_epoch, adapter, stream, body): a conversation's turns as an adapter's lines."""
    conv, turn, n = F.col("conv_id"), F.col("turn"), F.length("text")
    adapter = F.element_at(F.array(F.lit("turns"), F.lit("sums"), F.lit("plain")), (conv % 3 + 1).cast("int"))
    usage = F.struct(n.alias("input_tokens"), F.array(n % 7).alias("details"), turn.alias("output_tokens"), (turn / 8).cast("decimal(10,4)").alias("cost"))
    said = F.to_json(F.struct(F.lit("turn.completed").alias("type"), usage.alias("usage")))
    asked = F.to_json(F.struct(F.lit("item").alias("type"), F.col("role"), F.concat(F.lit("t"), conv).alias("thread_id"), F.concat(F.col("role"), turn).alias("text")))
    summed = F.to_json(F.struct(F.when(turn % 2 == 0, "partial").otherwise("other").alias("type"), F.struct(F.when(turn % 3 == 0, n).alias("total_tokens"), (n / 2).alias("input_tokens")).alias("usage")))
    plain = F.concat(F.lit("first: "), F.col("role"), F.lit("\nsession="), conv, F.lit("-"), turn, F.lit("\ntokens: "), n)
    line = F.when(adapter == "turns", F.when(F.col("role") == "assistant", said).otherwise(asked)).when(adapter == "sums", summed).otherwise(plain)
    lines = table(spark, sf_dir, "conversations").filter("turn IS NOT NULL").select(conv.alias("task"), adapter.alias("adapter"), F.struct("turn", line.alias("line")).alias("x"))
    bodies = lines.groupBy("task", "adapter").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"]), "\n").alias("body"))
    return bodies.select("task", F.lit(1).alias("attempt"), F.lit(1).cast("long").alias("lease_epoch"), "adapter", F.lit("stdout").alias("stream"), "body")


def _scraped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[captures.Capture]]:
    declared = captures.declarations(spark.createDataFrame(DECLARED, _SCHEMA))
    return captures.scrape(_outputs(spark, sf_dir), declared), declared


@register("declared_captures", _OUT + """
SELECT task, adapter, CASE adapter WHEN 'turns' THEN CASE WHEN asked IS NOT NULL THEN '"t' || task || '"' END WHEN 'plain' THEN '"' || task || '-' || last || '"' END AS session,
       CASE WHEN adapter = 'turns' AND asked IS NOT NULL THEN '"' || (SELECT role FROM t WHERE conv_id = task AND turn = asked) || asked || '"' WHEN adapter = 'plain' THEN '"' || (SELECT role FROM t WHERE conv_id = task AND turn = last) || '"' END AS message,
       CASE adapter WHEN 'turns' THEN said IS NOT NULL WHEN 'sums' THEN (SELECT bool_or(turn % 2 = 0) FROM t WHERE conv_id = task) ELSE true END AS has_usage, NULL::VARCHAR AS fault
FROM a""")
def declared_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three modes, the last match of each, a pattern over several lines."""
    out, _ = _scraped(spark, sf_dir)
    said = F.col("captures")
    return out.select("task", "adapter", said["sessionRef"].alias("session"), F.coalesce(said["finalMessage"], said["note"]).alias("message"), F.map_contains_key("captures", "usage").alias("has_usage"), "fault")


@register("usage_observations", _OUT + """,
s AS (SELECT conv_id AS task, arg_max(n, turn) AS n, max(turn) AS turn FROM t WHERE turn % 2 = 0 GROUP BY conv_id),
u AS (
  SELECT task, adapter, CASE WHEN said IS NULL THEN 'not-reported' ELSE 'reported' END AS state, CASE WHEN said IS NOT NULL THEN 'components' END AS shape, n - n % 7 AS input_tokens, n AS input_as_reported, n % 7 AS cache_read_tokens, said AS output_tokens,
         n + said AS total_tokens, CASE WHEN said IS NOT NULL THEN 'derived' END AS total_source, round(said / 8, 4)::DOUBLE AS cost, '' AS unreadable FROM a WHERE adapter = 'turns'
  UNION ALL
  SELECT a.task, adapter, CASE WHEN s.n IS NULL THEN 'not-reported' ELSE 'reported' END, CASE WHEN s.n % 2 = 0 THEN 'components' WHEN turn % 3 = 0 THEN 'lump' WHEN s.n IS NOT NULL THEN 'unmapped' END,
         CASE WHEN s.n % 2 = 0 THEN s.n // 2 END, CASE WHEN s.n % 2 = 0 THEN s.n // 2 END, NULL, NULL, CASE WHEN turn % 3 = 0 THEN s.n WHEN s.n % 2 = 0 THEN s.n // 2 END, CASE WHEN turn % 3 = 0 THEN 'harness' WHEN s.n % 2 = 0 THEN 'derived' END, NULL,
         CASE WHEN s.n % 2 = 1 THEN 'inputTokens' ELSE '' END FROM a LEFT JOIN s USING (task) WHERE adapter = 'sums'
  UNION ALL SELECT task, adapter, 'reported', 'unmapped', NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'totalTokens' FROM a WHERE adapter = 'plain')
SELECT * FROM u""")
def usage_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the captures say of usage, by the field map of each adapter; a number spelled as text is unreadable."""
    out = captures.observe(*_scraped(spark, sf_dir))
    longs = [F.col(c).cast("long").alias(c) for c in ("input_tokens", "input_as_reported", "cache_read_tokens", "output_tokens", "total_tokens")]
    return out.select("task", "adapter", "state", "shape", *longs, "total_source", F.col("cost_usd").cast("double").alias("cost"), F.array_join("unreadable", ",").alias("unreadable"))


@register("scraped_rows", _OUT + """,
s AS (SELECT conv_id AS task, turn AS seq, ['turns', 'sums', 'plain'][conv_id % 3 + 1] AS adapter, turn % 2 + 1 AS attempt, 1 AS lease_epoch, role || n AS session FROM t),
r AS (SELECT DISTINCT conv_id AS task, CASE WHEN conv_id % 5 = 0 THEN 'other' ELSE ['turns', 'sums', 'plain'][conv_id % 3 + 1] END AS adapter, conv_id % 2 + 1 AS attempt, CASE WHEN conv_id % 7 = 0 THEN 2 ELSE 1 END AS lease_epoch FROM t)
SELECT r.*, x.session, x.seq FROM r LEFT JOIN (SELECT task, adapter, attempt, lease_epoch, arg_max(session, seq) AS session, max(seq) AS seq FROM s GROUP BY ALL) x USING (task, adapter, attempt, lease_epoch)""")
def scraped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of other adapters, attempts or leases have no scrape."""
    turns = table(spark, sf_dir, "conversations").filter("turn IS NOT NULL")
    adapter = F.element_at(F.array(F.lit("turns"), F.lit("sums"), F.lit("plain")), (F.col("conv_id") % 3 + 1).cast("int"))
    scrapes = turns.select(F.col("conv_id").alias("task"), F.col("turn").alias("seq"), F.lit(0).alias("ledger_id"), adapter.alias("adapter"), (F.col("turn") % 2 + 1).alias("attempt"), F.lit(1).cast("long").alias("lease_epoch"), F.concat(F.col("role"), F.length("text")).alias("session"))
    rows = turns.select(F.col("conv_id").alias("task"), F.when(F.col("conv_id") % 5 == 0, "other").otherwise(adapter).alias("adapter"), (F.col("conv_id") % 2 + 1).alias("attempt"), F.when(F.col("conv_id") % 7 == 0, 2).otherwise(1).cast("long").alias("lease_epoch")).distinct()
    return captures.latest_scrape(rows, scrapes, ["session", "seq"])
