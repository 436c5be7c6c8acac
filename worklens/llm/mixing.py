"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from worklens.llm import common

#: For the weights 1, 2, 3, 1, 2, 3, ... in the order of the sources.
CYCLE = 3


def source_targets(sizes: DataFrame, most: int = 3) -> DataFrame:
    """sizes (source, source_size) with weight and target.

    Weights repeat 1, 2, 3 by the code points of the source, null last. The sum
    of all sizes is shared by weight; a target stops at `most` times its source's
    size, and what is over is shared again by weight among the others. That ends
    at one level L with target = min(weight * L, most * size); the sources that
    stop are those with the smallest most * size / weight, so running sums in
    that order give L. One row a source, so these windows see a small table.
    """
    alone = Window.partitionBy(F.lit(0))
    order = alone.orderBy(F.col("source").asc_nulls_last())
    before = alone.orderBy("stop_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    out = sizes.withColumn("weight", (F.row_number().over(order) - 1) % CYCLE + 1)
    out = out.withColumn("stop_at", F.col("source_size") * float(most) / F.col("weight"))
    total, weights = F.sum("source_size").over(alone).cast("double"), F.sum("weight").over(alone).cast("double")
    stopped = F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0)).cast("double")
    gone = F.coalesce(F.sum("weight").over(before), F.lit(0)).cast("double")
    out = out.withColumn("level", (total - stopped) / (weights - gone))
    out = out.withColumn("level", F.min_by(F.when(F.col("stop_at") >= F.col("level"), F.col("level")), F.when(F.col("stop_at") >= F.col("level"), F.struct("stop_at", "weight", F.coalesce("source", F.lit(""))))).over(alone))
    target = F.least(F.col("weight") * F.coalesce("level", F.lit(0.0)), F.col("source_size") * float(most))
    return out.select("source", "source_size", "weight", target.alias("target"))


def systematic_mix(docs: DataFrame, *, size: str = "size", source: str = "source", doc_id: str = "doc_id", tie: str = "tie", most: int = 3, seed: int = 0) -> DataFrame:
    """docs with source_size, target and copies: how often the mix takes each row.

    Within a source every row expects target / source_size copies, at most
    `most`. Rows are put in order of size, and a row gets one copy for each
    integer that the running sum of expected copies, plus one random offset of
    the source, crosses in it. As sizes rise along that order, the words taken
    miss the target by about the largest size at most. The offset is a hash of
    seed and source, so reruns agree.

    The running sum of equal expectations is rate * position, so only positions
    are needed: rows are counted by (source, size, salt of doc_id), counts are
    summed up level by level, and a row is numbered only among those that share
    all three. No window holds a whole source.

    A null source is a source of its own. Rows of size 0 may get copies; they
    add nothing. Rows with null doc_id share a salt. Repeated rows are rows.
    Rows of equal doc_id and size are told apart by `tie`, a column that the
    caller gives (such as a hash of the text). Clashing columns are replaced.
    """
    key = F.when(F.col(source).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(source)))
    salt = F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 1, 2)
    rows = docs.withColumns({"__key": key, "__size": F.col(size).cast("long"), "__salt": salt})
    among = Window.partitionBy("__key", "__size", "__salt").orderBy(doc_id, tie)
    rows = common.staged(rows.withColumn("__n", F.row_number().over(among)), "mix-rows")
    cells = rows.groupBy("__key", "__size", "__salt").agg(F.count("*").alias("n"), F.first(F.col(source)).alias("source"))
    sizes = cells.groupBy("__key", "__size").agg(F.sum("n").alias("n"), F.first("source").alias("source"))
    sources = sizes.groupBy("__key").agg(F.sum(F.col("n") * F.col("__size")).alias("source_size"), F.first("source").alias("source"))
    targets = source_targets(sources.select("source", "source_size"), most)
    key = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source")))
    # offsets on a grid of 2^-20: with a whole rate, sums stay exact and no row gets more than its rate
    unit = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("__key"))), 1, 5), 16, 10).cast("double") / float(1 << 20)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = targets.withColumn("__key", key).select("__key", F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), rate.alias("__rate"), unit.alias("__unit"))
    up_to = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__key", "__size", F.coalesce(F.sum("n").over(up_to("__key", "__size")), F.lit(0)).alias("__from"))
    cells = cells.select("__key", "__size", "__salt", F.coalesce(F.sum("n").over(up_to("__key", "__size", "__salt")), F.lit(0)).alias("__more"))
    cells = cells.join(sizes, ["__key", "__size"]).join(targets, "__key")
    at = (F.col("__from") + F.col("__more") + F.col("__n")).cast("double")
    crossed = F.floor(F.col("__rate") * at + F.col("__unit")) - F.floor(F.col("__rate") * (at - 1.0) + F.col("__unit"))
    out = rows.join(cells, ["__key", "__size", "__salt"])
    new = {"source_size": F.col("__source_size"), "target": F.col("__target"), "copies": crossed.cast("long")}
    return out.withColumns(new).drop("__key", "__size", "__salt", "__n", "__from", "__more", "__source_size", "__target", "__rate", "__unit")
