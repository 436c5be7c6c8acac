"""Queries that need folds; tested against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worklens.operators import folds, ledger
from worklens.plans import register
from worklens.plans.sql import EVENTS, with_
from worklens.sources import bridge
from worklens.streaming import events


@register("chain_faults")
def chain_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledgers sealed from lifecycle records; each 500th sequence is changed afterwards, then all are verified."""
    rows = bridge.lifecycle(spark, sf_dir)
    body = F.to_json(F.struct("task", "event", "gpu_seconds"))
    sealed = folds.reseal(rows.select("ledger_id", F.col("sequence").alias("seq"), body.alias("body")))
    changed = F.when(F.get_json_object("raw", "$.seq").cast("long") % 500 == 7, F.regexp_replace("raw", '"task":', '"task":9')).otherwise(F.col("raw"))
    problems = ledger.verify_chain(sealed.withColumn("raw", changed))
    return problems.groupBy("ledger_id", "problem").agg(F.count("*").alias("n"))


@register("pressure_levels")
def pressure_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W22, W23."""
    rows = bridge.lifecycle(spark, sf_dir).select(F.col("task").alias("store"), F.col("sequence").alias("n"), F.col("gpu_seconds").alias("used"))
    return folds.pressure_levels(rows, 20.0, 5.0)


@register("live_state", with_(EVENTS) + """
SELECT task, event, attempt, sequence FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY attempt DESC, sequence DESC) AS n FROM lifecycle) WHERE n = 1""")
def live_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4, T5, as a batch."""
    return events.live_state(bridge.lifecycle(spark, sf_dir))


@register("change_feed", with_(EVENTS) + "SELECT sequence, task, event, 5000 < min(sequence) OVER () - 1 AS gap FROM lifecycle WHERE sequence > 5000")
def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2."""
    return events.changes_after(bridge.lifecycle(spark, sf_dir).select("sequence", "task", "event"), 5000)
