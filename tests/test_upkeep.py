"""Folds, globs and scalar rules against plain Python."""

import fnmatch

import pytest
from pyspark.sql import functions as F

from worklens.functions import facts
from worklens.operators import maintenance, paths, receipts


def test_contiguous_receipts(spark):
    rows = [(1, 1, 7, "retry", 1), (1, 2, 7, "retry", 3), (1, 3, 7, "retry", 2), (1, 4, 7, "diagnosis", 1), (1, 5, 8, "retry", 1), (1, 6, 7, "pardon", None), (1, 7, 7, "retry", 1),
            (1, 8, 8, "retry", 2), (1, 9, None, "pardon", None), (1, 10, 8, "retry", 3), (2, 1, 7, "retry", 2)]
    df = spark.createDataFrame(rows, "campaign long, sequence long, task long, kind string, attempt long")
    kept = {(r.campaign, r.sequence) for r in receipts.contiguous(df).collect() if r.kept}
    assert kept == {(1, 1), (1, 3), (1, 4), (1, 5), (1, 7), (1, 8)}
    assert receipts.contiguous(df.limit(0)).count() == 0


@pytest.mark.parametrize("glob", ["a*", "?b", "[a-c]x", "[!a]x", "*.py", "a[b", "x]y", "[]]x"])
def test_component_globs(spark, glob):
    names = ["a", "ab", "bb", "cx", "dx", "ax", "f.py", "fpy", "a[b", "x]y", "]x", "[x"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    got = {r.path for r in paths.forbidden(df, [glob]).collect()}
    assert got == {n for n in names if fnmatch.fnmatchcase(n, glob)}


def test_span_globs(spark):
    df = spark.createDataFrame([(p,) for p in ("src/a/b.rs", "src/b.rs", "src", "lib/src/x", "SRC/q.RS")], "path string")
    hits = lambda g: {r.path for r in paths.forbidden(df, [g]).collect()}
    assert hits("src/**/*.rs") == {"src/a/b.rs", "src/b.rs", "SRC/q.RS"}
    assert hits("src") == {"src/a/b.rs", "src/b.rs", "src", "lib/src/x", "SRC/q.RS"}


def test_running_total(spark):
    df = spark.range(200).select("id", (F.col("id") % 7).alias("n"))
    got = {r.id: r.before for r in maintenance.running_total(df, F.floor(F.col("id") / 13), ["id"], "n").collect()}
    assert got == {i: sum(j % 7 for j in range(i)) for i in range(200)}


def test_facts_of_nulls(spark):
    c = lambda v, t: F.lit(v).cast(t)
    row = spark.range(1).select(
        facts.component_sum(c(None, "long"), c(None, "long")).alias("none"), facts.component_sum(c(None, "long"), c(3, "long")).alias("some"), facts.as_count(F.lit("2.0")).alias("whole"),
        facts.as_count(F.lit("2.5")).alias("part"), facts.as_count(F.lit("-1")).alias("minus"), facts.as_count(F.lit("x")).alias("word"), facts.cursor_sequence(F.lit("job:7"), "change").alias("other"),
        facts.pool_set(F.array(F.lit("b"), F.lit("a"), F.lit("b"), c(None, "string"))).alias("pools"), facts.is_content_hash(c(None, "string")).alias("hash"), facts.meter_percent(F.lit(5), F.lit(0)).alias("nocap"),
    ).first()
    assert (row.none, row.some, row.whole, row.part, row.minus, row.word, row.other, row.pools, row.hash, row.nocap) == (None, 3, 2, None, None, None, None, ["a", "b"], False, None)
