"""Stores against files written here."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from worklens.operators import folds, ledger, records, segments
from worklens.sources import lines, stores


def test_torn_tail_is_skipped_and_bad_line_fails(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"n":1}\n{"n":2}\n{"n":')
    assert [r.record.n for r in stores.records(spark, str(tmp_path), "n long").orderBy("line").collect()] == [1, 2]
    (tmp_path / "c.jsonl").write_text('{"n":1}\n{"n":2}')  # torn, though it is JSON
    assert sorted(r.record.n for r in stores.records(spark, str(tmp_path), "n long").collect()) == [1, 1, 2]
    (tmp_path / "b.jsonl").write_text('{"n":1}\n{"n":\n{"n":3}\n')
    with pytest.raises(Exception, match="bad record"):
        stores.records(spark, str(tmp_path), "n long").collect()


def test_attestations_keep_rows_of_broken_ledgers(spark, tmp_path):
    body = [(k, i, '{"task":%d}' % i) for k in (1, 2) for i in range(4)]
    sealed = folds.reseal(spark.createDataFrame(body, "ledger_id long, seq long, body string")).orderBy("line").collect()
    for k in (1, 2):
        raw = [r.raw for r in sealed if r.ledger_id == k]
        if k == 2:
            raw[1] = raw[1].replace('"task":1', '"task":9')
        (tmp_path / f"{k}.jsonl").write_text("\n".join(raw) + "\n")
    got = stores.attestations(spark, str(tmp_path), "task long").withColumn("name", F.substring_index("ledger_id", "/", -1)).collect()
    assert sorted((r.name, r.line, r.ledger_verified) for r in got) == [(f"{k}.jsonl", n, k == 1) for k in (1, 2) for n in (1, 2, 3, 4)]


def test_admission_events(spark, tmp_path):
    for name, eid in (("e1", "e1"), ("e2", "other")):
        (tmp_path / f"{name}.json").write_text(json.dumps({"eventId": eid, "row": {"uuid": "u"}}, indent=1))
    got = stores.admission_events(spark, str(tmp_path), "eventId string, row struct<uuid:string>").collect()
    assert sorted((r.file, r.named_right) for r in got) == [("e1.json", True), ("e2.json", False)]


def test_addressed_documents_and_envelope(spark, tmp_path):
    (tmp_path / (hashlib.sha256(b"x").hexdigest() + ".json")).write_bytes(b"x")
    (tmp_path / "0123.json").write_bytes(b"y")
    got = stores.addressed(spark, str(tmp_path))
    assert sorted(r.valid for r in got.collect()) == [False, True]
    row = stores.envelope(got, "documents", 2, F.to_timestamp(F.lit("2024-01-01"))).first()
    assert (row.kind, row.schema_version, row["items"]) == ("documents", 2, 2)


def test_lines_of_a_long_file_in_many_splits(spark, tmp_path):
    texts = [f'{{"n":{i},"x":"{"é" * (i % 37)}"}}' for i in range(60_000)]
    (tmp_path / "long.jsonl").write_text("\n".join(texts) + "\n")
    (tmp_path / "torn.jsonl").write_text("a\n\r\nb")
    (tmp_path / "empty.jsonl").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        read = lines.read_lines(spark, str(tmp_path))
        got = read.filter(F.col("file").endswith("long.jsonl")).select("line", "raw", "torn").collect()
        assert read.rdd.getNumPartitions() >= 8 and sorted((r.line, r.raw) for r in got) == list(enumerate(texts, 1)) and not any(r.torn for r in got)
        assert sorted((r.line, r.raw, r.torn) for r in read.filter(F.col("file").endswith("torn.jsonl")).collect()) == [(1, "a", False), (2, "\r", False), (3, "b", True)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    good, bad = lines.quarantined(spark.createDataFrame([("f", 1, '{"a":"b c"}', False), ("f", 2, '{"a": 1}', False), ("f", 3, "[1]", False), ("f", 4, '{"a":1}', True)], "file string, line long, raw string, torn boolean"))
    assert [r.line for r in good.collect()] == [1] and [(r.line, r.rejected) for r in bad.collect()] == [(2, "not-canonical"), (3, "not-a-record"), (4, "torn")]


def test_one_long_ledger_is_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(segments, "PIECE", 64)
    body = [(k, i, '{"task":%d}' % i) for k in (1, 2) for i in range(1500)]
    sealed = folds.reseal(spark.createDataFrame(body, "ledger_id long, seq long, body string"))
    rows = {(r.ledger_id, r.line): r.raw for r in sealed.collect()}
    other = json.loads(rows[2, 640])
    rows |= {(1, 64): rows[1, 64].replace('"task":63', '"task":9'), (1, 500): "oops", (1, 501): "", (2, 640): json.dumps(other), (2, 700): json.dumps(other | {"hash": "sha256:zz"}, separators=(",", ":"))}
    df = spark.createDataFrame([(*k, v) for k, v in rows.items()], "ledger_id long, line long, raw string")
    want, last = [], {}
    for (k, n), raw in sorted(rows.items()):
        if not raw.startswith("{"):
            want.append((k, n, "not-a-record"))
            continue
        said = json.loads(raw)
        blank = raw[: -len(said["hash"]) - 2] + '"}'
        if "sha256:" + hashlib.sha256(blank.encode()).hexdigest() != said["hash"]:
            want.append((k, n, "hash-mismatch"))
            continue
        if said["prevHash"] != last.get(k, folds.GENESIS):
            want.append((k, n, "prev-hash-mismatch"))
        last[k] = said["hash"]
    for piece in (64, 1 << 16):
        monkeypatch.setattr(segments.with_before, "__defaults__", (None, piece))
        assert sorted(map(tuple, ledger.verify_chain(df).collect())) == want
    gaps = spark.createDataFrame([(1, i, s) for i, s in enumerate([1, 2, 4, 3, 3, 900, 5, 7])] + [(2, 0, 5)], "ledger_id long, line long, seq long")
    got = {r.ledger_id: (r.n, r.first_seq, r.last_seq, r.out_of_order, r.repeated, r.first_gap, r.ok) for r in ledger.sequence_gaps(gaps).collect()}
    assert got == {1: (8, 1, 900, 2, 2, 6, False), 2: (1, 5, 5, 0, 0, None, True)}
    checks = spark.createDataFrame([(1, 1, 1, "lifecycle:1", 5), (1, 2, 2, "lifecycle:3", 6), (1, 3, 4, "lifecycle:4", 7), (1, 4, 5, "lifecycle:5", 6)], "ledger_id long, line long, sequence long, cursor string, ts long")
    assert [r.ok for r in records.sequence_checks(checks).orderBy("line").collect()] == [True, False, False, False]


def test_journal_lines(spark, tmp_path):
    (tmp_path / "j").write_text('{"SYSLOG_IDENTIFIER":"ours","TASK":"a"}\n\n{"SYSLOG_IDENTIFIER":"other","TASK":"b"}\n{"TASK":"c"}\n{"SYSLOG_IDENTIFIER":"ours","TASK":"d"}')
    assert [(r.line, r.entry.TASK) for r in stores.journal(spark, str(tmp_path), "TASK string", "ours").orderBy("line").collect()] == [(1, "a"), (5, "d")]
    (tmp_path / "k").write_text("oops\n")
    with pytest.raises(Exception, match="bad journal line"):
        stores.journal(spark, str(tmp_path), "TASK string", "ours").collect()
