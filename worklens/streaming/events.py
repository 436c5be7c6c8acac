"""Streaming forms of the lifecycle views; each gives what its batch twin gives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by event and pool in tumbling windows of event time."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event", "pool")
    return counted.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event", "pool", "n")


def once(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each sequence once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["sequence"])


def live_state(events: DataFrame) -> DataFrame:
    """T4, T5: the state of each task by (attempt, sequence); a late fact of a lower attempt never overwrites."""
    top = F.max_by(F.struct("event", "attempt", "sequence"), F.struct("attempt", "sequence"))
    return events.groupBy("task").agg(top.alias("x")).select("task", "x.*")


def changes_after(changes: DataFrame, cursor: int, earliest: int | None = None) -> DataFrame:
    """Records past a cursor, and whether some before them are gone already.

    A batch finds the earliest record that is still there by itself. A stream is
    told it, as its source is retained elsewhere, and is then a plain filter.
    """
    if earliest is not None:
        return changes.filter(F.col("sequence") > cursor).withColumn("gap", F.lit(cursor < earliest - 1))
    first = changes.agg(F.min("sequence").alias("earliest"))
    return changes.filter(F.col("sequence") > cursor).crossJoin(F.broadcast(first)).withColumn("gap", F.lit(cursor) < F.col("earliest") - 1).drop("earliest")  # one row
