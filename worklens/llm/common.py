"""What the operators share: the shared folder, staging, text expressions and batching."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worklens.sources.shared import shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: \x20 and \x09 to \x0D.
BLANKS = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"


def scratch(spark: SparkSession, name: str) -> str:
    """A new place in this application's part of the folder that driver and executors share."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read again: later uses and lost executors don't compute it anew."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def discard(df: DataFrame) -> None:
    """Removes what staged() wrote for df, once nothing that is still to run reads it."""
    _delete(df.sparkSession, df.staged_path)


def remove_scratch(spark: SparkSession) -> None:
    """Removes all that this application staged: for callers, after they have written or collected their results."""
    _delete(spark, f"{shared_folder(spark)}/{spark.sparkContext.applicationId}")


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], total: int, most: int = 2000) -> DataFrame:
    """left joined with right, which has one row for each of the keys, and n, the number of left's rows with them.

    total is the number of left's rows. Keys of more than a `most`-th of these,
    10000 at least, are `most` at most, so they are broadcast, and no task gets
    all rows of one of them.
    """
    limit = max(10_000, total // most)
    hot = F.broadcast(right.filter(F.col("n") > limit))
    rest = left.join(hot.select(*keys), keys, "left_anti").join(right.filter(F.col("n") <= limit), keys)
    return left.join(hot, keys).select(*rest.columns).union(rest)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, other letters untouched; lower() does that where all characters are ASCII, and faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_count(text: Column) -> Column:
    """Number of maximal runs without blanks; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_bytes(docs: DataFrame, text: str) -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length(text).cast("long")), F.lit(0))).first()[0]


def batch_count(docs: DataFrame, text: str, target: int) -> int:
    """How many batches of about target bytes the texts make."""
    return max(8, math.ceil(text_bytes(docs, text) / target))


def batched(docs: DataFrame, n: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(batch, doc_id, text): rows dealt to n batches by the hash of doc_id; rows with one doc_id come together."""
    batch = F.pmod(F.xxhash64(F.col(doc_id)), F.lit(n)).cast("int")
    return docs.select(batch.alias("batch"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).repartition(n, "batch")


def by_partition(tables: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts record batches into pieces of about most bytes, so that long texts don't pile up in Python."""
    for b in tables:
        if b.num_rows == 0:
            continue
        step = max(1, int(b.num_rows * most / max(b.nbytes, 1)))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def schema_with(df: DataFrame, **new: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, *[T.StructField(k, v) for k, v in new.items()]])
