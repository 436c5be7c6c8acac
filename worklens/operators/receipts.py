"""Receipts of attempts: which count, what pardons reset, and when a task is worn out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def contiguous(receipts: DataFrame) -> DataFrame:
    """(campaign, sequence, task, kind, attempt, kept) for receipts of kinds `diagnosis` and `retry`.

    Attempt k of a kind is kept only if its task has kept k - 1 before; a row of
    kind `pardon` resets its task, or all tasks of the campaign if it names none.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        count, kept = {}, []
        for r in rows.sort_values("sequence").itertuples():
            if r.kind == "pardon":
                count = {} if pd.isna(r.task) else {k: n for k, n in count.items() if k[0] != r.task}
                continue
            at = (r.task, r.kind)
            good = r.attempt == count.get(at, 0) + 1
            count[at] = count.get(at, 0) + good
            kept.append((r.campaign, r.sequence, r.task, r.kind, r.attempt, bool(good)))
        return pd.DataFrame(kept, columns=["campaign", "sequence", "task", "kind", "attempt", "kept"])

    schema = "campaign long, sequence long, task long, kind string, attempt long, kept boolean"
    return receipts.select("campaign", "sequence", "task", "kind", "attempt").groupBy("campaign").applyInPandas(fold, schema)


def lifetime(receipts: DataFrame, limit: int = 10) -> DataFrame:
    """Attempts of each task over its life, which no pardon resets, and whether they reach the limit."""
    made = receipts.filter("kind <> 'pardon'").groupBy("campaign", "task").agg(F.count("*").alias("attempts"))
    return made.withColumn("exhausted", F.col("attempts") >= limit)


def shown(rows: DataFrame, key: str, item: str, most: int) -> DataFrame:
    """The first items of each key in order, and how many more there are."""
    ranked = rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(item)))
    first = F.sort_array(F.collect_list(F.when(F.col("__n") <= most, F.col(item))))
    return ranked.groupBy(key).agg(first.alias("first"), F.greatest(F.count("*") - most, F.lit(0)).alias("more"))
