"""Line dedup: explode normalised lines, hash, count documents, drop frequent lines, reassemble."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklens.llm import common


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case."""
    return common.ascii_lower(F.btrim(line, F.lit(common.BLANKS)))


def _digest(key: Column) -> Column:
    return F.unhex(F.md5(key))


def drop_common_lines(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text.

    A line whose key has at least min_chars code points and occurs in at least
    min_docs rows goes, everywhere. Each row counts as a document, repeated rows
    too; a line that repeats within a row counts once. Null text is one empty
    line, as is the empty text; a row that loses all lines keeps the empty text.
    Columns that clash with the three new ones are replaced; others are kept.
    An empty table gives an empty table. A text of many lines costs as much as
    the same lines in many texts, but for sorting their digests in its own row.

    Lines are exploded with their digest, their place, and whether they are the
    row's first of that key. The count is aggregated before its shuffle, so a
    line of a third of all rows is one small row for each task; lines that are
    that frequent are few, and broadcast to their rows. Only digests and places
    travel for counting; texts travel once, to meet the places that they lose.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    row_key = F.unhex(F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.lit("|"), body)))
    keyed = docs.select(row_key.alias("row"), F.transform(F.split(body, "\n"), line_key).alias("keys"))
    digests = F.transform("keys", lambda k, i: F.when(F.length(k) >= min_chars, F.struct(_digest(k).alias("line"), i.cast("int").alias("at"))))
    digests = keyed.select("row", F.array_sort(F.array_compact(digests)).alias("lines"))
    first = F.transform("lines", lambda x, i: F.struct(x["line"].alias("line"), x["at"].alias("at"), ((i == 0) | (F.get("lines", i - 1)["line"] != x["line"])).cast("int").alias("first")))
    places = common.staged(digests.select("row", F.inline(first)), "line-places")
    counts = places.groupBy("line").agg(F.sum("first").alias("docs"), F.count("*").alias("n"))
    frequent = common.staged(counts.filter(F.col("docs") >= min_docs).select("line", "n"), "frequent-lines")
    # rows that repeat whole share their key, so their places come several times
    lost = common.spread_join(places, frequent, ["line"], places.count()).groupBy("row").agg(F.collect_set("at").alias("__lost"))
    out = docs.withColumn("__row", row_key).join(lost.withColumnRenamed("row", "__row"), "__row", "left")
    lines = F.split(body, "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__lost"))
    out = out.withColumn("__lines", lines).withColumn("__kept", F.when(F.col("__lost").isNull(), F.col("__lines")).otherwise(F.transform(stay, lambda i: F.get("__lines", i))))
    return out.withColumns(
        {
            "n_lines": F.size("__lines").cast("long"),
            "n_dropped": (F.size("__lines") - F.size("__kept")).cast("long"),
            "kept_text": F.array_join("__kept", "\n"),
        },
    ).drop("__row", "__lost", "__lines", "__kept")
