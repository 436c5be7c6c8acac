"""Running values over ledgers of any length: pieces are scanned side by side and joined at their borders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places of a ledger's order that make a piece.
PIECE = 1 << 16


def with_before(rows: DataFrame, keys: list[str], order: str, value: Column, start: Column | None = None, piece: int = PIECE) -> DataFrame:
    """rows with before: the last value that isn't null on an earlier row of the same keys, else `start`.

    order is a whole number without repeats within its keys. Rows are cut in
    pieces by it, so a long ledger is as many tasks as it has pieces. Each piece
    is summed up by its last value; of these summaries, one row a piece, each
    gets the last one before it, and rows look there only if their own piece has
    nothing earlier. Column names that begin with two underscores are taken.
    """
    cut = rows.withColumns({"__piece": F.floor(F.col(order) / piece), "__value": value})
    inside = Window.partitionBy(*keys, "__piece").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("__own", F.last("__value", ignorenulls=True).over(inside))
    ends = rows.select(*keys, F.floor(F.col(order) / piece).alias("__piece"), F.col(order).alias("__at"), value.alias("__value")).groupBy(*keys, "__piece").agg(F.max_by("__value", F.when(F.col("__value").isNotNull(), F.col("__at"))).alias("__end"))
    carried = F.last("__end", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1))
    carry = ends.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__piece").alias("__at_piece"), carried.alias("__carry"))
    met = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col("__piece") == F.col("__at_piece")]
    out = cut.join(carry, met, "left")
    found = [F.col("__own"), F.col("__carry")] + ([] if start is None else [start])
    return out.select(*rows.columns, F.coalesce(*found).alias("before"))
