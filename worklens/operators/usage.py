"""Usage, pools and windows: what attempts spent and what pools still hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worklens.functions import predicates as P

COMPONENTS = ["input_tokens", "cache_read_tokens", "cache_write_tokens", "output_tokens"]
#: Where sums stop.
MOST = "18446744073709551615"


def last_attestation(rows: DataFrame) -> DataFrame:
    """The last attestation of each attempt, by seq within its ledger."""
    rest = [c for c in rows.columns if c not in ("task", "attempt")]
    return rows.groupBy("task", "attempt").agg(F.max_by(F.struct(*rest), F.struct("seq", "ledger_id")).alias("x")).select("task", "attempt", "x.*")


def roll_up(rows: DataFrame, key: str) -> DataFrame:
    """A2 to A5: sums with how many attempts gave each; what is missing stays null, never zero.

    R14: sums are taken as wide decimals and stop at MOST; `saturated` tells that one did.
    """
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    total = F.coalesce(wide("declared_total"), sum(F.coalesce(wide(c), F.lit(0)) for c in COMPONENTS))
    known = F.col("declared_total").isNotNull() | F.greatest(*[F.col(c) for c in COMPONENTS]).isNotNull()
    fresh = wide("input_tokens") + wide("cache_write_tokens")
    sums = {c: F.sum(wide(c)) for c in COMPONENTS} | {"fresh_input": F.sum(fresh), "total_tokens": F.sum(F.when(known, total))}
    most = F.lit(MOST).cast("decimal(38,0)")
    capped = [F.when(s.isNotNull(), F.least(s, most)).cast("decimal(20,0)").alias(c) for c, s in sums.items()]  # least passes nulls over
    over = F.greatest(*[F.coalesce(s > most, F.lit(False)) for s in sums.values()])
    counts = [F.count(c).alias(f"n_{c}") for c in COMPONENTS]
    usd = F.col("currency") == "USD"
    declared, derived = F.max(F.col("declared_total").isNotNull()), F.max(F.col("declared_total").isNull() & known)
    source = F.when(declared & derived, "mixed").when(declared, "harness").when(derived, "derived")
    return rows.groupBy(key).agg(
        F.count("*").alias("attempts"), *capped, *counts, F.count(fresh).alias("n_fresh_input"), over.alias("saturated"), source.alias("total_source"),
        F.round(F.sum(F.when(usd, F.col("cost"))).cast("double"), 6).alias("cost_usd"), F.count_if(~usd).alias("n_other_currency"),
    )


def field_coverage(rows: DataFrame, key: str) -> DataFrame:
    """For each field how many attempts report it and how many don't."""
    long = rows.unpivot([key], COMPONENTS, "field", "value")
    return long.groupBy(key, "field").agg(F.count("value").alias("reported"), F.count_if(F.col("value").isNull()).alias("unreported"))


def missing_attempts(rows: DataFrame, most: int = 64) -> DataFrame:
    """Attempts below the greatest that no attestation names, the first `most` of each task.

    Gaps between the attempts that are there are counted, not listed, so a lone
    attempt of a great number costs no more than another; each gap lists its
    first `most` at most.
    """
    before = F.coalesce(F.lag("attempt").over(Window.partitionBy("task").orderBy("attempt")), F.lit(0))
    gaps = rows.select("task", F.col("attempt").cast("long").alias("attempt")).filter("attempt > 0").distinct().withColumn("before", before).filter("attempt > before + 1")
    listed = F.sequence(F.col("before") + 1, F.least(F.col("attempt") - 1, F.col("before") + most))
    ranked = gaps.withColumn("upto", F.sum(F.col("attempt") - F.col("before") - 1).over(Window.partitionBy("task").orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)))
    near = F.when(F.coalesce("upto", F.lit(0)) < most, listed)
    out = ranked.groupBy("task").agg(F.sum(F.col("attempt") - F.col("before") - 1).alias("n_missing"), F.array_sort(F.flatten(F.collect_list(near))).alias("first"))
    return out.select("task", "n_missing", F.array_join(F.slice("first", 1, most), ",").alias("missing"))


def trailing_debit(debits: DataFrame, seconds: int) -> DataFrame:
    """Per pool the debits of the half-open trailing window at each debit; one expires at exactly its end.

    Time is cut in spans as long as the window, so a window lies in its own span
    and the one before. Sums run inside a span of a pool, never over a whole
    pool: what the own span holds up to here, and what the one before holds less
    what has expired there.
    """
    width = seconds * 1_000_000
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = debits.select("pool", "sequence", F.col("gpu_seconds").alias("x"), at.alias("at"), F.floor(at / width).alias("span"))
    span = Window.partitionBy("pool", "span")
    upto = span.orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    probes = rows.select("pool", "sequence", F.lit(0.0).alias("x"), (F.col("at") - width).alias("at"), (F.col("span") - 1).alias("span"), F.lit(True).alias("asks"))
    every = rows.withColumn("asks", F.lit(False)).union(probes)
    sums = every.withColumns({"so_far": F.sum("x").over(upto), "all": F.sum("x").over(span)})
    part = F.when(F.col("asks"), F.col("all") - F.col("so_far")).otherwise(F.col("so_far"))
    return sums.groupBy("pool", "sequence").agg(F.round(F.sum(part), 4).alias("in_window"))


def first_grants(events: DataFrame) -> DataFrame:
    """The first record of each lane."""
    return events.groupBy("task", "attempt").agg(F.min_by(F.struct("sequence", "pool", "gpu_seconds", "ts"), "sequence").alias("x")).select("task", "attempt", "x.*")


def pool_headroom(records: DataFrame, pools: DataFrame) -> DataFrame:
    """What pools hold, have queued, use and allow; pools without records too.

    A lane holds its pool from its last `started` until a later terminal record,
    and is queued from `enqueued` until it starts; each counts once. Its seconds
    are used while it holds. pools (pool, capacity, slots, meter, weekly).
    """
    last = records.groupBy("pool", "task", "attempt").agg(
        F.max(F.when(F.col("event") == "started", F.col("sequence"))).alias("began"), F.max(F.when(F.col("event") == "enqueued", F.col("sequence"))).alias("asked"),
        F.max(F.when(P.terminal(F.col("event")), F.col("sequence"))).alias("ended"), F.sum(F.when(F.col("event") == "started", F.col("gpu_seconds"))).alias("spent"),
    )
    holds = F.col("began").isNotNull() & (F.col("ended").isNull() | (F.col("ended") < F.col("began")))
    waits = F.col("asked").isNotNull() & (F.col("began").isNull() | (F.col("began") < F.col("asked"))) & (F.col("ended").isNull() | (F.col("ended") < F.col("asked")))
    held = last.groupBy("pool").agg(F.count_if(holds).alias("held"), F.count_if(waits).alias("queued"), F.sum(F.when(holds, F.col("spent"))).alias("used"))
    out = pools.join(held, "pool", "left").withColumns({"held": F.coalesce("held", F.lit(0)), "queued": F.coalesce("queued", F.lit(0)), "used": F.round(F.coalesce("used", F.lit(0.0)), 4)})
    out = out.withColumns({"percent": F.floor(F.col("used") * 100 / F.col("capacity")), "remaining": F.greatest(F.lit(0), F.col("slots") - F.col("held"))})
    return out.withColumn("allows", P.headroom(F.col("percent"), F.col("remaining"), F.col("meter"), F.col("weekly")))


def interleaved(rows: DataFrame, group: str) -> DataFrame:
    """A fair order: by rank, then the n-th of each group, then the group whose first came first."""
    among = Window.partitionBy("priority", group)
    return rows.withColumns({"nth": F.row_number().over(among.orderBy("created", "task")), "oldest": F.min(F.struct("created", "task")).over(among)["task"]})


def first_debits(grants: DataFrame) -> DataFrame:
    """Of (ledger_id, n, lease_id, admission_key, pool, amount, admitted_at) the first of each lease, and of these the first of each admission key.

    n is the place in the log. A lease granted again debits nothing; the same
    admission under another lease debits nothing either. Without a key each
    lease is an admission of its own.
    """
    rest = [c for c in grants.columns if c not in ("ledger_id", "lease_id")]
    leases = grants.groupBy("ledger_id", "lease_id").agg(F.min_by(F.struct(*rest), "n").alias("x")).select("ledger_id", "lease_id", "x.*")
    key = F.coalesce(F.concat(F.lit("k"), F.col("admission_key")), F.concat(F.lit("l"), F.col("lease_id")))
    rest = [c for c in leases.columns if c != "ledger_id"]
    return leases.withColumn("__key", key).groupBy("ledger_id", "__key").agg(F.min_by(F.struct(*rest), "n").alias("x")).select("ledger_id", "x.*")


def window_usage(debits: DataFrame, pools: DataFrame, now: Column) -> DataFrame:
    """(pool, used, reset_at) of pools with a window: debits whose window isn't over at now, and when the oldest of them ends."""
    ends = F.col("admitted_at") + F.make_dt_interval(secs=F.col("window_seconds"))
    live = debits.join(pools.filter("window_seconds IS NOT NULL").select("pool", "window_seconds"), "pool").withColumn("ends", ends).filter(F.col("ends") > now)
    return live.groupBy("pool").agg(F.sum("amount").alias("used"), F.min("ends").alias("reset_at"))


def project_headroom(pools: DataFrame) -> DataFrame:
    """Pools (slots, held, used, window_cap, meter, weekly) with remaining, percent, effective, budget and signal.

    A pool with a window is used as much as its debits of the cap; one without,
    as much as its slots are held. A meter counts if it says more. What is left
    of the budget is the lesser of what debits and meter leave.
    """
    used, cap = F.coalesce("used", F.lit(0)), F.col("window_cap")
    own = F.when(cap.isNotNull(), F.least(used, cap) * 100.0 / cap).otherwise(F.least("held", "slots") * 100.0 / F.col("slots"))
    by_meter = F.coalesce(F.least(F.floor(cap * (100.0 - F.col("meter")) / 100.0), cap), cap)
    out = pools.withColumns({"remaining": F.greatest(F.lit(0), F.col("slots") - F.col("held")), "percent": own, "budget": F.when(cap.isNotNull(), F.least(F.greatest(F.lit(0), cap - used), by_meter))})
    out = out.withColumn("effective", F.greatest("percent", F.coalesce("meter", F.lit(0.0))))
    signal = F.when((F.col("remaining") == 0) | (F.col("effective") >= 90), "STOP").when((F.col("effective") >= 70) | F.coalesce(F.col("weekly") >= 80, F.lit(False)), "SLOW").otherwise("GO")
    return out.withColumn("signal", signal)
