"""Token counts through a cache keyed by content and tokenizer digests."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worklens.llm import common

CACHE = T.StructType([T.StructField("version", T.StringType()), T.StructField("digest", T.BinaryType()), T.StructField("n_tokens", T.LongType())])


def tokenizer_version(model: bytes, library: str) -> str:
    """Names the tokenizer: its file, its library and how it is called."""
    return hashlib.sha256(f"{library}|plain|".encode() + model).hexdigest()


def counter(model: bytes, library: str) -> Callable[[list[str]], list[int]]:
    """Counts tokens without special ones, truncation or padding."""
    if library == "sentencepiece":
        import sentencepiece

        piece = sentencepiece.SentencePieceProcessor(model_proto=model)
        return lambda texts: [len(x) for x in piece.encode(texts, num_threads=1)]
    if library == "tokenizers":
        from tokenizers import Tokenizer

        bpe = Tokenizer.from_str(model.decode())
        bpe.no_truncation()
        bpe.no_padding()
        return lambda texts: [len(x.ids) for x in bpe.encode_batch(texts, add_special_tokens=False)]
    raise ValueError(f"no such library: {library}")


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; none where nothing was stored yet."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.read.schema(CACHE).parquet(path)
    return spark.createDataFrame([], CACHE)


def count_tokens(docs: DataFrame, model: bytes, library: str, cache_path: str, *, text: str = "text", limit: int = 4096) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit.

    Contents are named by the SHA-256 of the text (null: the empty text; no
    other normalisation, as it could change counts). Only distinct contents that
    the cache at cache_path lacks for this tokenizer are encoded; their counts
    are appended to it. The cache may be shared by jobs: a content that two jobs
    append is one content, as reads group by digest.

    A text that makes a third of all rows shuffles once for each task, since
    copies meet before the shuffle; the join back to rows has short rows and one
    match each, which Spark splits where a digest is hot. Clashing columns are
    replaced; repeated rows stay. Texts are encoded whole, a long one in one task,
    as cutting it could change its count. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    version = tokenizer_version(model, library)
    body = F.coalesce(F.col(text), F.lit(""))
    cached = lambda: read_cache(spark, cache_path).filter(F.col("version") == version).groupBy("digest").agg(F.first("n_tokens").alias("n_tokens"))
    distinct = docs.select(F.unhex(F.sha2(body, 256)).alias("digest"), body.alias("text")).dropDuplicates(["digest"])
    missing = distinct.join(cached().select("digest"), "digest", "left_anti")
    shared = spark.sparkContext.broadcast(model)  # one tokenizer file

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(shared.value, library)
        for b in common.by_partition(batches, 1 << 20):
            yield pa.RecordBatch.from_arrays([pa.array([version] * b.num_rows), b["digest"], pa.array(count(b["text"].to_pylist()), pa.int64())], names=["version", "digest", "n_tokens"])

    missing.mapInArrow(encode, CACHE).write.mode("append").option("compression", "zstd").parquet(cache_path)
    out = docs.withColumns({"__digest": F.unhex(F.sha2(body, 256)), "__bytes": F.octet_length(body).cast("long")})
    out = out.join(cached().select(F.col("digest").alias("__digest"), F.col("n_tokens").alias("__tokens")), "__digest", "left")
    new = {"n_bytes": F.col("__bytes"), "n_tokens": F.col("__tokens"), "over_limit": F.col("__tokens") > limit}
    return out.withColumns(new).drop("__digest", "__bytes", "__tokens")
