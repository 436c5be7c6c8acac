"""Maintenance plans: what a compaction or a retention run would keep. Reports, nothing is deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(df: DataFrame, bucket: Column, order: list[str], amount: str) -> DataFrame:
    """df with `before`, the sum of amount over all rows earlier in order, without one partition for all.

    bucket must rise with order (a day, say); only the sums of buckets meet in one window.
    """
    df = df.withColumn("__bucket", bucket)
    sums = df.groupBy("__bucket").agg(F.sum(amount).alias("__sum"))
    earlier = F.sum("__sum").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select("__bucket", F.coalesce(earlier, F.lit(0)).alias("__start"))
    inside = F.sum(amount).over(Window.partitionBy("__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("__inside", F.coalesce(inside, F.lit(0))).join(starts, "__bucket").withColumn("before", F.col("__start") + F.col("__inside")).drop("__bucket", "__start", "__inside")


def protected_runs(members: DataFrame, live: DataFrame, writing: DataFrame) -> DataFrame:
    """U8: runs being written and runs that hold a live task."""
    alive = members.join(live.select("task").distinct(), "task", "left_semi").select("run")
    return alive.union(writing.select("run")).distinct()


def eviction_plan(members: DataFrame, protected: DataFrame, share: float) -> DataFrame:
    """(run, touched, held, evict): least recently touched whole runs go until at most `share` of records is left.

    members has (run, recorded_at, …), one row a record; protected runs stay and aren't listed.
    """
    runs = members.groupBy("run").agg(F.max("recorded_at").alias("touched"), F.count("*").alias("held"))
    total = runs.agg(F.sum("held").alias("total"))
    open_ = running_total(runs.join(protected, "run", "left_anti"), F.to_date("touched"), ["touched", "run"], "held")
    out = open_.crossJoin(total)  # one row
    return out.select("run", "touched", "held", (F.col("total") - F.col("before") > F.floor(F.col("total") * share)).alias("evict"))


def latest_only(records: DataFrame, key: str, order: str) -> DataFrame:
    """M3: each key's latest record, and how many it stands for."""
    rest = [c for c in records.columns if c != key]
    return records.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*([order] + [c for c in rest if c != order]))).alias("x"), F.count("*").alias("records")).select(key, "x.*", "records")


def newest(records: DataFrame, most: int, *order: str) -> DataFrame:
    """M4: the newest records of a bounded ledger; the bound is the ledger's own."""
    return records.orderBy(*[F.desc(c) for c in order]).limit(most)


def live_references(records: DataFrame, refs: str, at: str, since: Column) -> DataFrame:
    """(ref, keep): references that a record since the cutoff names are kept, others can be collected."""
    named = records.select(F.explode(refs).alias("ref"), (F.col(at) >= since).alias("recent"))
    return named.groupBy("ref").agg(F.coalesce(F.max("recent"), F.lit(False)).alias("keep"))


def prune_plan(files: DataFrame, since: Column, most: int) -> DataFrame:
    """M6: why each archived file goes: too old, or beyond the newest `most` of its store; null stays.

    Ranks are counted within days after whole newer days, so a large store isn't one window.
    """
    fresh = files.withColumn("expired", F.col("modified") < since)
    day = F.to_date("modified")
    kept = fresh.filter(~F.col("expired")).withColumn("__day", day)
    days = kept.groupBy("store", "__day").agg(F.count("*").alias("n"))
    newer = F.sum("n").over(Window.partitionBy("store").orderBy(F.desc("__day")).rowsBetween(Window.unboundedPreceding, -1))
    days = days.select("store", "__day", F.coalesce(newer, F.lit(0)).alias("newer"))
    inside = F.row_number().over(Window.partitionBy("store", "__day").orderBy(F.desc("modified"), F.desc("file")))
    ranked = kept.withColumn("rank", inside).join(days, ["store", "__day"]).select("store", "file", F.when(F.col("newer") + F.col("rank") > most, "count").alias("reason"))
    return fresh.filter("expired").select("store", "file", F.lit("age").alias("reason")).union(ranked)


def growth(samples: DataFrame) -> DataFrame:
    """Growth a completion since the last sample with fewer completions; (store, n, completions, used).

    Of samples with one number of completions the last counts; whole numbers, rounded toward zero.
    """
    points = samples.groupBy("store", "completions").agg(F.max_by("used", "n").alias("used"))
    before = Window.partitionBy("store").orderBy("completions")
    delta = F.col("completions") - F.lag("completions").over(before)
    rate = ((F.col("used") - F.lag("used").over(before)) / delta).cast("long")
    return points.select("store", "completions", "used", delta.alias("delta"), rate.alias("growth"))
