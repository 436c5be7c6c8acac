"""Stateful streams, fed in two batches, against plain folds."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from worklens.operators import folds, ledger, records
from worklens.streaming import events, stateful, tables


def fed(spark, tmp_path, name, batches, view, mode="append"):
    """The rows that a stream view makes of DataFrames that come one after the other."""
    folder = f"{tmp_path}/{name}"
    batches[0].limit(0).write.parquet(folder)
    stream = spark.readStream.schema(batches[0].schema).parquet(folder)
    query = view(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{folder}-state").start()
    for b in batches:
        b.coalesce(1).write.mode("append").parquet(folder)
        query.processAllAvailable()
    query.stop()
    return sorted(map(tuple, spark.table(name).collect()), key=str)


@pytest.fixture(scope="module")
def samples():
    return [(i % 3, i, float((i * 7919) % 31)) for i in range(120)]


def test_pressure(spark, tmp_path, samples):
    df = spark.createDataFrame(samples, "store long, n long, used double")
    got = fed(spark, tmp_path, "pressure", [df.filter("n < 50"), df.filter("n >= 50")], lambda s: stateful.pressure_levels(s, 20.0, 5.0))
    assert got == sorted(map(tuple, folds.pressure_levels(df, 20.0, 5.0).collect()), key=str)


def test_retention_retries_and_changes(spark, tmp_path):
    rows = [(i % 2, i, (i * 37) % 50) for i in range(60)]
    df = spark.createDataFrame(rows, "ledger_id long, sequence long, micros long")
    got = fed(spark, tmp_path, "kept", [df.filter("sequence < 20"), df.filter("sequence >= 20")], lambda s: stateful.retained(s, 45))
    first = {k: min(s for l, s, m in rows if l == k and m >= 45) for k in (0, 1)}
    assert got == sorted([r for r in rows if r[1] >= first[r[0]]], key=str)
    events = [(i % 4, i, "failed" if i % 3 else "started") for i in range(60)]
    df = spark.createDataFrame(events, "task long, sequence long, event string")
    got = fed(spark, tmp_path, "retries", [df.filter("sequence < 31"), df.filter("sequence >= 31")], lambda s: stateful.retries(s, 2))
    want = [(t, s, n, "automatic" if n <= 2 else "exhausted") for t, s, n in [(t, s, sum(a == t and b <= s and e == "failed" for a, b, e in events)) for t, s, x in events if x == "failed"]]
    assert got == sorted(want, key=str)
    said = [(1, 1, "armed"), (1, 2, "armed"), (2, 3, "armed"), (1, 4, "running"), (1, 5, "running"), (2, 6, "armed"), (1, 7, "armed")]
    df = spark.createDataFrame(said, "campaign long, n long, status string")
    got = fed(spark, tmp_path, "changes", [df.filter("n < 5"), df.filter("n >= 5")], stateful.status_changes)
    assert got == sorted([(1, 1, None, "armed"), (2, 3, None, "armed"), (1, 4, "armed", "running"), (1, 7, "running", "armed")], key=str)


def test_chain_of_appended_lines(spark, tmp_path):
    body = [(k, i, '{"task":%d}' % i) for k in (1, 2, 3) for i in range(12)]
    sealed = folds.reseal(spark.createDataFrame(body, "ledger_id long, seq long, body string"))
    rows = {(r.ledger_id, r.line): r.raw for r in sealed.collect()}
    rows[1, 7] = rows[1, 7].replace('"task":6', '"task":7')
    rows[3, 4] = "oops"
    schema = "ledger_id long, line long, raw string, size long"
    df = spark.createDataFrame([(k, n, raw, 12) for (k, n), raw in rows.items()], schema)
    want = sorted(map(tuple, ledger.verify_chain(df).collect()), key=str)
    part = lambda f: df.filter(f)
    got = fed(spark, tmp_path, "chain", [part("line IN (2, 5, 6, 12)"), part("line IN (1, 3, 7, 2)"), part("line NOT IN (12, 5)")], stateful.verify_appended)
    assert got == want and len(got) == 4  # shuffled, and some lines twice
    short = folds.reseal(spark.createDataFrame([(2, i, '{"task":%d}' % (i if i < 4 else 90)) for i in range(6)], "ledger_id long, seq long, body string")).withColumn("size", F.lit(6).cast("long"))
    bad = short.withColumn("raw", F.when(F.col("line") == 6, F.lit("oops")).otherwise(F.col("raw")))
    got = fed(spark, tmp_path, "shrunk", [part("ledger_id = 2"), bad.select(*df.columns)], stateful.verify_appended)
    assert got == sorted([(2, 0, "rebuilt"), (2, 6, "not-a-record")], key=str)
    got = fed(spark, tmp_path, "gap", [part("ledger_id = 2 AND line <> 5")], lambda s: stateful.verify_appended(s, 3))
    assert got == sorted([(2, 5, "gap"), (2, 6, "prev-hash-mismatch")], key=str)


def test_stalls_by_timers(spark, tmp_path):
    at = lambda rows: spark.createDataFrame(rows, "task long, s long").select("task", F.timestamp_seconds(F.col("s") + 1000).alias("ts"))
    batches = [at([(1, 0), (2, 0), (1, 5)]), at([(2, 12)]), at([(2, 31)]), at([(2, 36), (1, 38)]), at([(2, 37)])]
    got = fed(spark, tmp_path, "stalls", batches, lambda s: stateful.stalls(s, 10, "1 second"))
    said = [(t, a.timestamp() - 1000, n, m) for t, a, n, m in got]
    mine = [x for x in sorted(said, key=lambda x: (x[1], x[3])) if x[0] == 1]
    assert mine[-1] == (1, 38, "recovered", 3) and [m for _, _, n, m in mine if n == "stall"] == sorted({m for _, _, n, m in mine if n == "stall"}) and mine[-2][3] == 3 and all(a == 5 + 10 * m for _, a, n, m in mine if n == "stall")
    assert sorted(x for x in said if x[0] == 2) == [(2, 10, "stall", 1), (2, 12, "recovered", 1), (2, 22, "stall", 1), (2, 31, "recovered", 1)]


def test_state_tables_keep_what_they_know(spark, tmp_path):
    schema, path = "task long, attempt int, sequence long, event string", f"{tmp_path}/state"
    put = tables.upsert(path, schema, ["task"], ["attempt", "sequence"], buckets=4)
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    now = lambda: sorted(map(tuple, tables.read(spark, path, schema).collect()))
    assert now() == []
    put(rows((1, 1, 5, "started"), (2, 1, 6, "started"), (1, 1, 7, "failed")), 0)
    put(rows((1, 2, 8, "started")), 1)
    want = [(1, 2, 8, "started"), (2, 1, 6, "started")]
    assert now() == want
    put(rows((1, 9, 9, "replayed")), 1)  # a batch that was applied
    put(rows((1, 1, 99, "completed")), 2)  # a late fact of a lower attempt
    put(rows((1, 1, 99, "completed")).limit(0), 3)
    assert now() == want
    (tmp_path / "state/batch=4/bucket=0").mkdir(parents=True)  # a batch that never ended
    put(rows(*[(i, 1, 10 + i, "enqueued") for i in range(3, 9)]), 4)
    before = now()
    assert len(before) == 8 and tables.vacuum(spark, path) > 0 and now() == before
    put(rows((1, 9, 9, "replayed")), 1)
    assert now() == before
    once = tables.upsert(f"{tmp_path}/once", "id string, n long", ["id"], ["n"], first=True, buckets=2)
    ids = lambda *r: spark.createDataFrame(list(r), "id string, n long")
    once(ids(("a", 1), ("b", 2)), 0)
    once(ids(("a", 5), ("c", 3)), 1)
    assert sorted(map(tuple, tables.read(spark, f"{tmp_path}/once", "id string, n long").collect())) == [("a", 1), ("b", 2), ("c", 3)]


def test_meters_of_scrapes_on_a_stream(spark, tmp_path):
    schema = "task string, attempt int, lease_epoch long, seq long, pool string, stated_total decimal(20,0), input_as_reported decimal(20,0), output_tokens decimal(20,0), unreadable array<string>"
    d = lambda v: None if v is None else Decimal(v)
    row = lambda task, seq, pool, total, i, o, bad=(): (task, 1, 1, seq, pool, d(total), d(i), d(o), list(bad))
    batches = [[row("a", 1, "p", 50, 1, 1), row("b", 2, "p", None, 10, 5), row("c", 3, "q", None, 7, None, ["outputTokens"])], [row("a", 4, "p", 60, 1, 1), row("d", 5, "q", 0, 0, 0), row("e", 6, "q", None, 3, None)]]
    frames = [spark.createDataFrame(b, schema) for b in batches]
    folder, path = f"{tmp_path}/scrapes", f"{tmp_path}/meter"
    frames[0].limit(0).write.parquet(folder)
    query = spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(tables.meter(path, 4)).option("checkpointLocation", f"{tmp_path}/cp").start()
    for f in frames:
        f.coalesce(1).write.mode("append").parquet(folder)
        query.processAllAvailable()
    query.stop()
    caps = spark.createDataFrame([("p", 100), ("q", 4), ("r", 9)], "pool string, cap long")
    assert sorted((r.pool, int(r.used), r.percent) for r in tables.meter_percents(spark, path, caps).collect()) == [("p", 75, 75.0), ("q", 3, 75.0), ("r", 0, 0.0)]
    clock, seen = F.timestamp_seconds(F.lit(1000)), []
    meters = {"at": 950}
    read = lambda s: s.createDataFrame([("p", meters["at"], 1, "programmatic", 40.0)], "pool string, t long, n int, budget_class string, percent double").select("pool", F.timestamp_seconds("t").alias("observed_at"), "n", "budget_class", "percent", F.lit(None).cast("double").alias("weekly"), F.timestamp_seconds(F.lit(2000)).alias("resets_at"))
    apply = lambda batch, n: seen.append({r.pool: r.meter for r in tables.with_fresh_meters(batch, read, clock, 100).collect()})
    query = spark.readStream.schema(schema).parquet(folder).select("pool").writeStream.foreachBatch(apply).option("checkpointLocation", f"{tmp_path}/cp2").start()
    query.processAllAvailable()
    meters["at"] = 800  # too old by now
    frames[0].coalesce(1).write.mode("append").parquet(folder)
    query.processAllAvailable()
    query.stop()
    assert seen[0] == {"p": 40.0, "q": None} and seen[-1] == {"p": None, "q": None}


def test_retry_plan(spark):
    rows = [(1, 1, 1, "pass", ["a"]), (2, 1, 2, "pool-vanished", ["a", "b"]), (3, 1, 3, "pool-vanished", ["c"]), (4, 3, 4, "pool-vanished", ["b"]), (5, 1, 5, "preempted", ["b"]), (6, 1, 6, "runtime-exceeded", ["z"]), (7, 2, 7, "runtime-exceeded", None), (8, 1, 8, None, None)]
    terminals = spark.createDataFrame(rows, "task long, attempt int, seq long, verdict string, pools array<string>")
    triggers = spark.createDataFrame([("pool-return", "b"), ("pool-return", "b"), ("resource-return", "b"), ("bounded-requeue", "6")], "kind string, name string")
    out = records.retry_plan(terminals, triggers, {"pool-return": True, "resource-return": False, "bounded-requeue": True}, 3)
    assert {r.task: r.retry for r in out.collect()} == {1: "none", 2: "automatic", 3: "waiting", 4: "exhausted", 5: "manual", 6: "automatic", 7: "waiting", 8: "none"}


def test_budgets(spark, tmp_path):
    rows = [("a" if i % 2 else "b", i * 60, 1.0) for i in range(30)]
    df = spark.createDataFrame(rows, "pool string, s long, gpu_seconds double").select("pool", F.timestamp_seconds("s").alias("ts"), "gpu_seconds")
    got = fed(spark, tmp_path, "budgets", [df.filter("ts < timestamp_seconds(900)"), df.filter("ts >= timestamp_seconds(900)")], lambda s: stateful.budgets(s, "10 minutes", "5 minutes", "1 minute"), "complete")
    assert got == sorted(map(tuple, stateful.budgets(df, "10 minutes", "5 minutes", "1 minute").collect()), key=str)


def test_each_sequence_once_and_changes_after_a_cursor(spark, tmp_path):
    rows = spark.createDataFrame([(i % 7, 1000 + i) for i in range(20)], "sequence long, s long").select("sequence", F.timestamp_seconds("s").alias("ts"))
    got = fed(spark, tmp_path, "once", [rows.filter("sequence < 4"), rows], events.once)
    assert sorted(r[0] for r in got) == list(range(7))
    one = rows.select("sequence").distinct()
    got = fed(spark, tmp_path, "feed", [one.filter("sequence < 4"), one.filter("sequence >= 4")], lambda s: events.changes_after(s, 2, 5))
    assert got == [(i, True) for i in (3, 4, 5, 6)] and {r.gap for r in events.changes_after(one, 2).collect()} == {False}


def test_boundaries_are_recorded_before_records_go(spark, tmp_path):
    rows = [(1, 1, 10), (1, 2, 60), (1, 3, 40), (1, 4, 70), (2, 1, 10), (2, 2, 20), (3, 5, 90)]
    df = spark.createDataFrame(rows, "ledger_id long, sequence long, s long").select("ledger_id", "sequence", F.timestamp_seconds("s").alias("ts"))
    horizon, path = {"from": 50}, f"{tmp_path}/bounds"
    apply = tables.record_boundary(path, lambda: F.timestamp_seconds(F.lit(horizon["from"])), 2)
    apply(df, 0)
    kept = lambda: sorted((r.ledger_id, r.sequence) for r in tables.retained(df, path).collect())
    assert kept() == [(1, 2), (1, 3), (1, 4), (3, 5)]  # the third is older than the horizon, but comes after its first record
    horizon["from"] = 20
    apply(df, 1)
    assert kept() == [(1, 2), (1, 3), (1, 4), (3, 5)]  # boundaries only rise
    horizon["from"] = 65
    apply(df, 2)
    assert kept() == [(1, 4), (3, 5)]


def test_log_position_on_a_stream(spark, tmp_path):
    rows = [("journal", i) for i in range(1, 7)] + [("witness", i) for i in range(1, 5)]
    df = spark.createDataFrame(rows, "origin string, number long")
    got = fed(spark, tmp_path, "positions", [df.filter("number < 4"), df.filter("number >= 4")], lambda s: records.after_position(s, 3, 2))
    assert got == sorted([("journal", 4), ("journal", 5), ("journal", 6), ("witness", 3), ("witness", 4)], key=str)
    heads = tables.upsert(f"{tmp_path}/heads", "origin string, number long", ["origin"], ["number"], buckets=2)
    heads(df.filter("number >= 4"), 0)
    heads(df.filter("number < 4"), 1)  # late
    assert sorted(map(tuple, tables.read(spark, f"{tmp_path}/heads", "origin string, number long").collect())) == [("journal", 6), ("witness", 4)]
