"""Ledger files as lines in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, raw, torn) with line counting from 1 in each file; torn is a last line without an end.

    Spark's row ids rise within a split of a file, so a line's number is its
    place in the split and the lines of the splits before. Splits are summed up
    in a scan of their own, to one row each, and put in order by their start; no
    file is brought together. A file whose lines and their ends are one byte more
    than itself lacks the last end. Only \\n ends a line.
    """
    read = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("raw")
    )
    splits = read.groupBy("file", "start").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.sum(F.octet_length("raw").cast("long") + 1).alias("bytes"), F.first("size").alias("size"))
    among = Window.partitionBy("file")
    before = F.coalesce(F.sum("n").over(among.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("file", "start", (before - F.col("first") + 1).alias("shift"), F.when(F.sum("bytes").over(among) > F.col("size"), F.sum("n").over(among)).alias("torn_line"))
    rows = read.drop("size").join(splits, ["file", "start"]).withColumn("line", F.col("id") + F.col("shift"))
    return rows.select("file", "line", "raw", F.coalesce(F.col("line") == F.col("torn_line"), F.lit(False)).alias("torn"))


def quality(lines: DataFrame) -> DataFrame:
    """Why a line is rejected, null for a record: torn, blank, not JSON, not an object, or spaced otherwise than a writer does."""
    parsed = F.try_parse_json("raw")
    torn = F.col("torn") if "torn" in lines.columns else F.lit(False)
    spaced = F.regexp_replace("raw", r'"(?:[^"\\]|\\.)*+"', "").rlike(r"\s")
    reason = F.when(torn, "torn").when(F.trim("raw") == "", "blank").when(parsed.isNull(), "not-json").when(~F.col("raw").startswith("{"), "not-a-record").when(spaced, "not-canonical")
    return lines.withColumn("rejected", reason)


def quarantined(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records and the rejected lines, the latter with their reason, to be appended to tables of their own."""
    judged = quality(lines)
    return judged.filter("rejected IS NULL").drop("rejected"), judged.filter("rejected IS NOT NULL")
