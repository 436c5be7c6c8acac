"""Stores of JSON records: logs whose last line may be torn, directories of one record a file, result envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worklens.operators import ledger
from worklens.sources import lines


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, line, record) of every log under path; R9.

    A last line without an end is a torn append and skipped, whatever it holds;
    any other line that isn't JSON fails the read when its rows are used.
    """
    rows = lines.read_lines(spark, path).filter(~F.col("torn"))
    bad = F.raise_error(F.concat(F.lit("bad record at "), F.col("file"), F.lit(":"), F.col("line"))).cast("string")
    checked = F.when(F.try_parse_json("raw").isNull(), bad).otherwise(F.col("raw"))
    return rows.select("file", "line", F.from_json(checked, schema).alias("record"))


def journal(spark: SparkSession, path: str, schema: str, identifier: str) -> DataFrame:
    """(file, line, entry) of exported journal lines under path whose SYSLOG_IDENTIFIER is ours; blank lines and those of others are skipped, a bad line of any kind fails the read."""
    rows = lines.read_lines(spark, path).filter(F.trim("raw") != "")
    bad = F.raise_error(F.concat(F.lit("bad journal line at "), F.col("file"), F.lit(":"), F.col("line"))).cast("string")
    checked = F.when(F.try_parse_json("raw").isNull(), bad).otherwise(F.col("raw"))
    mine = F.get_json_object(checked, "$.SYSLOG_IDENTIFIER") == identifier
    return rows.filter(mine).select("file", "line", F.from_json("raw", schema).alias("entry"))


def attestations(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of every ledger under path; ledger_verified says whether the whole chain of its file holds."""
    rows = lines.read_lines(spark, path).withColumnRenamed("file", "ledger_id")
    broken = ledger.verify_chain(rows).select("ledger_id").distinct().withColumn("broken", F.lit(True))
    return rows.join(broken, "ledger_id", "left").select("ledger_id", "line", F.from_json("raw", schema).alias("record"), F.col("broken").isNull().alias("ledger_verified"))


def admission_events(spark: SparkSession, folder: str, schema: str, event_id: str = "eventId") -> DataFrame:
    """One record a file `<id>.json`; named_right says whether the name is the record's id."""
    rows = spark.read.schema(schema).option("multiLine", True).json(f"{folder}/*.json", recursiveFileLookup=False).withColumn("file", F.col("_metadata.file_name"))
    return rows.withColumn("named_right", F.coalesce(F.concat(F.col(event_id), F.lit(".json")) == F.col("file"), F.lit(False)))


def addressed(spark: SparkSession, folder: str) -> DataFrame:
    """(file, valid) for documents named by the digest of their content, with or without an ending."""
    rows = spark.read.format("binaryFile").load(folder)
    name = F.substring_index(F.col("path"), "/", -1)
    return rows.select(name.alias("file"), (F.substring_index(name, ".", 1) == F.sha2("content", 256)).alias("valid"))


def envelope(result: DataFrame, kind: str, version: int, now: Column) -> DataFrame:
    """The one-row metadata of a result, to be written beside it."""
    return result.agg(F.count("*").alias("items")).select(F.lit(kind).alias("kind"), F.lit(version).alias("schema_version"), now.alias("generated_at"), "items")
