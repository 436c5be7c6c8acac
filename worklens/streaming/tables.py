"""State tables that streams keep: upserted batch by batch, in buckets of their keys, so that a batch rewrites only what it touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worklens.functions import facts
from worklens.operators import records

Batch = Callable[[DataFrame, int], None]


def _children(spark: SparkSession, path: str) -> list[str]:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = there.getFileSystem(spark._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in fs.listStatus(there)] if fs.exists(there) else []


def _buckets(spark: SparkSession, path: str) -> tuple[dict[int, int], set[int]]:
    """The last committed batch of each bucket, and all committed batches; at most as many entries as buckets and batches since the last vacuum()."""
    last, done = {}, set()
    for name in _children(spark, path):
        inside = _children(spark, f"{path}/{name}") if name.startswith("batch=") else []
        if "_SUCCESS" in inside:
            batch = int(name[6:])
            done.add(batch)
            for bucket in (int(x[7:]) for x in inside if x.startswith("bucket=")):
                last[bucket] = max(batch, last.get(bucket, -1))
    return last, done


def read(spark: SparkSession, path: str, schema: str, only: list[int] | None = None) -> DataFrame:
    """The table as of the last committed batch; only some buckets if asked."""
    last, _ = _buckets(spark, path)
    parts = [f"{path}/batch={batch}/bucket={bucket}" for bucket, batch in sorted(last.items()) if only is None or bucket in only]
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)


def upsert(path: str, schema: str, keys: list[str], order: list[str], first: bool = False, buckets: int = 64) -> Batch:
    """A foreachBatch function that keeps one row a key: the greatest in order, or with `first` the least.

    A batch that is committed is not applied again, so a replay changes nothing;
    nor does a late row that is less in order (a lower attempt), or an id that
    was seen, however long ago. Only the buckets whose keys a batch names are
    read and written, beside the old ones; a batch counts once it is whole. The
    order should be total.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id in _buckets(spark, path)[1]:
            return
        rows = batch.select(*[c.split()[0] for c in schema.split(", ")])
        touched = [r[0] for r in rows.select(bucket).distinct().collect()]
        if not touched:
            return
        both = read(spark, path, schema, touched).unionByName(rows)
        rest = [c for c in rows.columns if c not in keys]
        pick = (F.min_by if first else F.max_by)(F.struct(*rest), F.struct(*order))
        merged = both.groupBy(*keys).agg(pick.alias("x")).select(*keys, "x.*").select(*rows.columns, bucket.alias("bucket"))
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={batch_id}")

    return apply


def vacuum(spark: SparkSession, path: str) -> int:
    """Removes buckets that a later batch has replaced; a batch's marker stays, so it is still known as applied. How many went."""
    last, done = _buckets(spark, path)
    gone = 0
    for batch in done:
        for name in _children(spark, f"{path}/batch={batch}"):
            if name.startswith("bucket=") and last[int(name[7:])] > batch:
                there = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={batch}/{name}")
                there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
                gone += 1
    return gone


METER = "task string, attempt int, lease_epoch long, seq long, pool string, amount decimal(20,0)"


def metered(scrapes: DataFrame) -> DataFrame:
    """What each scrape charges to its pool; scrapes that charge nothing go.

    scrapes (task, attempt, lease_epoch, seq, pool, stated_total,
    input_as_reported, output_tokens, unreadable).
    """
    hurt = F.arrays_overlap("unreadable", F.array(*map(F.lit, ("totalTokens", "inputTokens", "inputTokensWithCacheRead", "outputTokens"))))
    amount = facts.meter_amount(F.col("stated_total"), F.col("input_as_reported"), F.col("output_tokens"), hurt)
    return scrapes.withColumn("amount", amount.cast("decimal(20,0)")).filter("amount IS NOT NULL").select("task", "attempt", "lease_epoch", "seq", "pool", "amount")


def meter(path: str, buckets: int = 64) -> Batch:
    """A foreachBatch function that charges each scraped attempt once, its last scrape counting."""
    put = upsert(path, METER, ["task", "attempt", "lease_epoch"], ["seq"], buckets=buckets)
    return lambda batch, batch_id: put(metered(batch), batch_id)


def meter_percents(spark: SparkSession, path: str, caps: DataFrame) -> DataFrame:
    """(pool, used, percent) of each pool of caps (pool, cap)."""
    used = read(spark, path, METER).groupBy("pool").agg(F.sum("amount").alias("used"))
    return caps.join(used, "pool", "left").select("pool", F.coalesce("used", F.lit(0)).alias("used"), facts.meter_percent(F.coalesce(F.col("used"), F.lit(0)).cast("double"), F.col("cap").cast("double")).alias("percent"))


def with_fresh_meters(pools: DataFrame, meters: Callable[[SparkSession], DataFrame], now: Column, seconds: int) -> DataFrame:
    """A batch of pools with their latest usable meter, null where there is none; meters are read anew for each batch."""
    good = records.fresh_meters(meters(pools.sparkSession), now, seconds).filter("fresh").select("pool", F.col("percent").alias("meter"))
    return pools.join(good, "pool", "left")


BOUNDARY = "ledger_id long, boundary long"


def record_boundary(path: str, cutoff: Callable[[], Column], buckets: int = 16) -> Batch:
    """A foreachBatch function that records, before anything is dropped, from where on each ledger of (ledger_id, sequence, ts) is kept.

    That is the first record inside the horizon, whose beginning cutoff() says
    anew for each batch; what stands before it goes, whatever its time, and all
    after it stays. A ledger without one keeps what comes after its last record.
    Boundaries only rise. The batch should be the whole of the ledgers it names.
    """
    put = upsert(path, BOUNDARY, ["ledger_id"], ["boundary"], buckets=buckets)

    def apply(batch: DataFrame, batch_id: int) -> None:
        inside = F.min(F.when(F.col("ts") >= cutoff(), F.col("sequence")))
        put(batch.groupBy("ledger_id").agg(F.coalesce(inside, F.max("sequence") + 1).alias("boundary")), batch_id)

    return apply


def retained(records: DataFrame, path: str) -> DataFrame:
    """Records from their ledger's recorded boundary on; a plain filter by a join, so a stream may use it too. Ledgers without a boundary stay whole."""
    bounds = read(records.sparkSession, path, BOUNDARY)
    return records.join(bounds, "ledger_id", "left").filter(F.col("boundary").isNull() | (F.col("sequence") >= F.col("boundary"))).drop("boundary")
