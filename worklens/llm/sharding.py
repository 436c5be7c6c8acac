"""Sharding by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from worklens.llm import common

#: The ring has 2^CELL_BITS cells; a text falls in the cell of its hash's top bits.
CELL_BITS = 12
CELLS = 1 << CELL_BITS


def ring(spark: SparkSession, shards: int, nodes: int) -> DataFrame:
    """(cell, prefer): for each cell the shards in the order in which a clockwise walk first meets them.

    Each shard has `nodes` virtual nodes at cells that hash its number and the
    node's, so that another shard leaves those of the others where they are. The
    table has a fixed number of rows, so its window runs in one task.
    """
    shard = F.floor(F.col("id") / nodes).cast("int")
    placed = spark.range(shards * nodes).select(shard.alias("shard"), F.pmod(F.xxhash64(F.lit("node"), shard, F.col("id") % nodes), F.lit(CELLS)).cast("int").alias("cell"))
    # one row a cell: the shards that have a node there
    here = placed.groupBy("cell").agg(F.collect_set("shard").alias("owners"))
    cells = spark.range(CELLS).select(F.col("id").cast("int").alias("cell")).join(here, "cell", "left")
    alone = Window.partitionBy(F.lit(0)).orderBy("cell")
    ahead, whole = alone.rowsBetween(0, Window.unboundedFollowing), alone.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    dist = []
    for s in range(shards):
        at = F.when(F.array_contains("owners", s), F.col("cell"))
        dist.append(F.struct((F.coalesce(F.min(at).over(ahead), F.min(at).over(whole) + CELLS) - F.col("cell")).alias("far"), F.lit(s).alias("shard")))
    return cells.select("cell", F.array_sort(F.array(*dist)).alias("met")).select("cell", F.col("met.shard").alias("prefer"))


def bounded_loads(cells: DataFrame, shards: int, slack: float) -> DataFrame:
    """cells (cell, prefer, load) with parts: which stretch [low, high) of a cell's load each shard takes.

    Every shard holds at most (1 + slack) times the mean load. In round r each
    cell asks the r-th shard that it meets for what it has not placed yet; a
    shard serves cells in ring order until it is full, and the rest goes on
    clockwise. Capacities exceed the total, so after as many rounds as there are
    shards nothing is left. A fixed number of rows: one task, no shuffle between
    rounds.
    """
    order = Window.partitionBy(F.lit(0)).orderBy("cell")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = cells.withColumns({
        "most": F.ceil(F.sum("load").over(whole) * (1.0 + slack) / shards).cast("long"),
        "left": F.col("load"), "used": F.lit(0).cast("long"), "parts": F.array().cast("array<struct<shard:int,low:bigint,high:bigint>>"),
        "full": F.array(*[F.lit(0).cast("long")] * shards),
    })
    for r in range(shards):
        asks = F.element_at("prefer", r + 1)
        wants = [F.when(asks == s, F.col("left")).otherwise(0) for s in range(shards)]
        out = out.withColumns({f"b{s}": F.coalesce(F.sum(w).over(before), F.lit(0)) for s, w in enumerate(wants)} | {f"t{s}": F.sum(w).over(whole) for s, w in enumerate(wants)})
        first = F.element_at(F.array(*[F.col(f"b{s}") for s in range(shards)]), asks + 1)
        room = F.col("most") - F.element_at("full", asks + 1) - first
        out = out.withColumn("take", F.greatest(F.lit(0), F.least("left", room)).cast("long"))
        full = F.array(*[(F.element_at("full", s + 1) + F.least(F.col("most") - F.element_at("full", s + 1), F.col(f"t{s}"))).cast("long") for s in range(shards)])
        part = F.struct(asks.alias("shard"), F.col("used").alias("low"), (F.col("used") + F.col("take")).alias("high"))
        out = out.select(
            "cell", "prefer", "load", "most", (F.col("left") - F.col("take")).alias("left"), (F.col("used") + F.col("take")).alias("used"),
            F.when(F.col("take") > 0, F.concat("parts", F.array(part))).otherwise(F.col("parts")).alias("parts"), full.alias("full"),
        )
    return out.select("cell", "load", "parts", F.element_at("prefer", 1).alias("home"))


def shard(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", shards: int = 8, nodes: int = 64, slack: float = 0.001, salts: int = 64, keep_text: bool = True) -> DataFrame:
    """docs with size (UTF-8 bytes + 1), shard and slot (gapless from 0 in each shard).

    Ring keys are texts, so equal texts stay together unless their shard is
    full; then they continue clockwise. Loads are sizes: a shard gets at most
    (1 + slack) times the mean, give or take half a row where a stretch ends.

    A group of copies counts as its (text, salt of doc_id) parts, so a text that
    makes a third of all rows is dealt to `salts` tasks. Rows are numbered only
    within such a part; parts are summed up within a cell of the ring, cells on
    the fixed ring. Null text has no bytes and shares the empty text's place;
    null doc_id is a value like any other; repeated rows are rows. Clashing
    columns are replaced. An empty table gives an empty table. Without keep_text
    the text is dropped once it is hashed, and the shuffled rows are short.
    """
    spark = docs.sparkSession
    rows = docs.withColumns({
        "__size": F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1,
        "__at": F.xxhash64(F.coalesce(F.col(text), F.lit(""))),
        "__salt": F.pmod(F.xxhash64(F.lit("salt"), F.col(doc_id)), F.lit(salts)).cast("int"),
    })
    rows = rows if keep_text else rows.drop(text)
    among = Window.partitionBy("__at", "__salt").orderBy(doc_id, "__size")
    rows = rows.withColumns({"__n": F.row_number().over(among), "__run": F.coalesce(F.sum("__size").over(among.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    rows = common.staged(rows, "shard-rows")
    cell = F.shiftrightunsigned("__at", 64 - CELL_BITS).cast("int")
    parts = rows.groupBy("__at", "__salt").agg(F.sum("__size").alias("load")).withColumn("cell", cell)
    loads = parts.groupBy("cell").agg(F.sum("load").alias("load"))
    cells = ring(spark, shards, nodes).join(loads, "cell", "left").fillna(0, ["load"])
    cells = common.staged(bounded_loads(cells, shards, slack), "shard-cells")
    along = Window.partitionBy("cell").orderBy("__at", "__salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("__at", "__salt", F.coalesce(F.sum("load").over(along), F.lit(0)).alias("__from"))
    out = rows.join(parts, ["__at", "__salt"]).withColumn("__cell", cell)
    out = out.join(F.broadcast(cells.select(F.col("cell").alias("__cell"), "parts")), "__cell")  # 2^CELL_BITS rows at any size
    middle = F.col("__from") + F.col("__run") + F.col("__size") / 2
    part = F.element_at(F.filter("parts", lambda p: (p["low"] <= middle) & (middle < p["high"])), 1)
    out = common.staged(out.withColumn("__shard", part["shard"]).drop("parts", "__from", "__run"), "shard-placed")
    counts = out.groupBy("__cell", "__at", "__salt", "__shard").agg(F.count("*").alias("n"), F.min("__n").alias("__n0"))
    by_cell = counts.groupBy("__cell", "__shard").agg(F.sum("n").alias("n"))
    up = lambda keys, order: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    by_cell = by_cell.select("__cell", "__shard", F.coalesce(F.sum("n").over(up(["__shard"], ["__cell"])), F.lit(0)).alias("__base"))
    counts = counts.withColumn("__off", F.coalesce(F.sum("n").over(up(["__cell", "__shard"], ["__at", "__salt"])), F.lit(0)))
    counts = counts.join(by_cell, ["__cell", "__shard"]).select("__at", "__salt", "__shard", (F.col("__base") + F.col("__off") - F.col("__n0")).alias("__slot"))
    out = out.join(counts, ["__at", "__salt", "__shard"])
    new = {"size": F.col("__size"), "shard": F.col("__shard"), "slot": F.col("__slot") + F.col("__n")}
    return out.withColumns(new).drop("__size", "__at", "__salt", "__n", "__cell", "__shard", "__slot")
