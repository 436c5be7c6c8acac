"""The ledger queries against their SQL, folds and graphs against brute force, streams against batches."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from worklens.functions import predicates as P
from worklens.functions import texts
from worklens.operators import folds, graphs, ledger
from worklens.plans import catalog
from worklens.sources import bridge, lines
from worklens.streaming import events

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents pages conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_query_matches_its_sql(spark, duck, name):
    cursor = duck.execute(catalog.oracles()[name])
    names = [c[0] for c in cursor.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cursor.fetchall()), key=str)
    got = catalog.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted((tuple(plain(r[c]) for c in sorted(names)) for r in got.collect()), key=str) == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_chain(spark, tmp_path):
    body = [(1, i, '{"task":%d}' % i) for i in range(6)] + [(2, i, '{"task":1}') for i in range(3)]
    sealed = folds.reseal(spark.createDataFrame(body, "ledger_id long, seq long, body string"))
    assert ledger.verify_chain(sealed).count() == 0
    changed = sealed.withColumn("raw", F.when((F.col("ledger_id") == 1) & (F.col("line") == 3), F.replace("raw", F.lit('"task":2'), F.lit('"task":7'))).otherwise(F.col("raw")))
    assert {(r.line, r.problem) for r in ledger.verify_chain(changed).collect()} == {(3, "hash-mismatch"), (4, "prev-hash-mismatch")}
    removed = sealed.filter("NOT (ledger_id = 1 AND line = 2)")
    assert [(r.ledger_id, r.line, r.problem) for r in ledger.verify_chain(removed).collect()] == [(1, 3, "prev-hash-mismatch")]
    kept = [r.raw for r in sealed.filter("ledger_id = 1").orderBy("line").collect()]
    (tmp_path / "a.jsonl").write_text("\n".join([*kept, "", "oops", "[1]", ""]))
    read = lines.quality(lines.read_lines(spark, str(tmp_path))).orderBy("line").collect()
    assert [r.raw for r in read][:6] == kept and [r.rejected for r in read] == [None] * 6 + ["blank", "not-json", "not-a-record"]


def test_pressure(spark):
    used = [1, 9, 6, 6, 2, 8, 9, 3]
    rows = spark.createDataFrame([(1, i, float(u)) for i, u in enumerate(used)], "store long, n long, used double")
    got = folds.pressure_levels(rows, 8, 3).orderBy("n").collect()
    assert [r.level for r in got] == ["ok", "high", "high", "high", "ok", "high", "high", "ok"] and [r.episode for r in got] == [0, 1, 1, 1, 1, 2, 2, 2]


def test_graphs(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 51), (51, 50)], "run long, successor long")
    got = {r.run: (r.head, r.steps) for r in graphs.heads(edges).collect()}
    assert got == {i: (30, 30 - i) for i in range(30)} | {50: (None, None), 51: (None, None)}
    needs = spark.createDataFrame([(2, 1), (3, 1), (4, 2), (4, 3), (5, 4), (4, 5)], "task long, needs long")
    roots = graphs.blocked_by(needs, spark.createDataFrame([(1,)], "task long"))
    assert sorted((r.task, r.root) for r in roots.collect()) == [(2, 1), (3, 1), (4, 1), (5, 1)]


def test_functions(spark):
    rows = spark.createDataFrame([("2h 30min",), ("1month",), ("soon",), (None,)], "x string")
    assert [r[0] for r in rows.select(P.duration_seconds(F.col("x"))).collect()] == [9000.0, 2629800.0, None, None]
    secrets = spark.createDataFrame([("a" * 38 + "Z1",), ("a" * 40,), ("token = 1",)], "x string")
    assert [tuple(r) for r in secrets.select(texts.holds_token(F.col("x")), texts.marked_line(F.col("x"))).collect()] == [(True, False), (False, False), (False, True)]


def test_stream_is_batch(spark, tmp_path):
    rows = bridge.lifecycle(spark, SF).withColumn("ts", F.col("ts").cast("timestamp"))
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    for name, view in (("counts", events.event_counts), ("state", events.live_state)):
        query = view(stream).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").start()
        query.processAllAvailable()
        query.stop()
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, view(rows).collect()))
