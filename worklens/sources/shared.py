"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What the session names as spark.checkpoint.dir. Where it names none, a temporary one, but only if all of Spark runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """df written to the application's part of the shared folder, so that rounds don't pile up and survive lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{df.sparkSession.sparkContext.applicationId}/closure-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_path = path
    return out


def gone(*frames: DataFrame) -> None:
    """Removes what kept() wrote, once nothing reads it any more."""
    for df in frames:
        there = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.kept_path)
        there.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(there, True)


def clear(spark: SparkSession) -> None:
    """Removes all that this application wrote in the shared folder: for callers, after they have written or collected their results."""
    there = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{spark.sparkContext.applicationId}")
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
