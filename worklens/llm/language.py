"""Language identification by bit-sliced Bloom filters of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worklens.llm import common

UNKNOWN = "und"
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_TURN = np.uint64(0xBF58476D1CE4E5B9)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of lower-case letters, 0 for anything else, and where each text starts; texts are parted by zeros."""
    joined = "\x00".join(texts).lower()
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.concatenate([[0], np.flatnonzero(codes == 0) + 1]) if texts else np.zeros(0, np.int64)
    signs = (codes < 0xC0) | (codes == 0xD7) | (codes == 0xF7) | (codes >= 0x2000) & (codes < 0x2070) | (codes >= 0x3000) & (codes < 0x3005)
    kept = np.where((codes >= 97) & (codes <= 122) | ~signs, codes, 0)
    return kept, starts


def ngrams(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n characters that start at each place; 0 where they aren't n-1 letters, each a boundary at most at an end."""
    m = len(codes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(m, n, np.uint64)
    good = np.ones(m, bool)
    for i in range(n):
        part = codes[i : i + m]
        h = (h ^ part) * _MULTIPLY
        h ^= h >> np.uint64(29)
        if 0 < i < n - 1:
            good &= part > 0
    good &= (codes[:m] > 0) | (codes[n - 1 :] > 0)
    h *= _TURN
    h ^= h >> np.uint64(32)
    h[h == 0] = 1
    return np.where(good, h, np.uint64(0))


@dataclass
class Filters:
    """One Bloom filter a language, sliced by bit: slot i holds bit i of all filters, as a mask of languages."""

    languages: list[str]
    slots: np.ndarray  # (size, planes) of uint64
    hashes: int
    n: int

    def fill(self) -> np.ndarray:
        """The share of bits that are set, by language."""
        return np.array([np.count_nonzero(self.slots[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)) / len(self.slots) for i in range(len(self.languages))])

    def holders(self, grams: np.ndarray) -> np.ndarray:
        """Masks of the languages whose filter holds each n-gram."""
        found = None
        for at in places(grams, self.hashes, len(self.slots)):
            found = self.slots[at] if found is None else found & self.slots[at]
        return found

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The language with most n-grams beyond the false positives that its filter's fill explains, and its share."""
        if not self.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        codes, starts = _codes([(x or "").replace("\x00", " ") for x in texts])
        grams = ngrams(codes, self.n)
        real = np.flatnonzero(grams)
        masks = self.holders(grams[real])
        owner = np.searchsorted(starts, real, "right") - 1
        total = np.bincount(owner, minlength=len(texts)).astype(float)
        false = self.fill() ** self.hashes
        hits = np.stack([np.bincount(owner, weights=(masks[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).astype(float), minlength=len(texts)) for i in range(len(self.languages))], axis=1)
        true = np.clip((hits - total[:, None] * false) / np.maximum(1 - false, 1e-9), 0, None)
        best, mass = true.argmax(axis=1), true.sum(axis=1)
        score = np.where(mass > 0, true[np.arange(len(texts)), best] / np.maximum(mass, 1e-9), 1 / len(self.languages))
        return [(self.languages[b], float(min(1.0, s))) if x is not None and any(map(str.isalpha, x)) else (UNKNOWN, 0.0) for x, b, s in zip(texts, best, score)]


def places(grams: np.ndarray, hashes: int, size: int) -> Iterator[np.ndarray]:
    step = (grams >> np.uint64(32)) | np.uint64(1)
    for i in range(hashes):
        yield ((grams + np.uint64(i) * step) % np.uint64(size)).astype(np.int64)


def sampled(docs: DataFrame, *, text: str = "text", lang: str = "lang", per_language: int = 1000) -> DataFrame:
    """(lang, text): of each language the per_language distinct texts with the lowest hashes, or all that it has, however often each repeats."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    rows = rows.withColumn("hash", F.pmod(F.xxhash64("text"), F.lit(1 << 31)))
    # the highest hash that is taken, one row a language; of distinct hashes only the lowest of each task shuffle
    lowest = Window.partitionBy("lang").orderBy("hash")
    last = rows.select("lang", "hash").distinct().withColumn("rank", F.row_number().over(lowest)).filter(F.col("rank") <= per_language).groupBy("lang").agg(F.max("hash").alias("last"))
    # copies meet before they shuffle
    sample = rows.join(F.broadcast(last), "lang").filter(F.col("hash") <= F.col("last")).select("lang", "hash", "text").dropDuplicates(["lang", "hash"]).select("lang", "text")
    return common.staged(sample, "language-sample")


def learn(docs: DataFrame, *, text: str = "text", lang: str = "lang", n: int = 4, per_language: int = 1000, share: float = 0.02, bits: int = 1 << 19, hashes: int = 3) -> Filters:
    """Filters from labelled rows (null text or lang: passed over).

    Bounded sample: of each language per_language distinct texts, whole. An
    n-gram belongs to a language if at least `share` of its sampled texts hold
    it. Repeated rows count once. Slots are combined on the executors; the driver
    gets at most `bits` masks.
    """
    sample = sampled(docs, text=text, lang=lang, per_language=per_language)
    languages = [x[0] for x in sample.select("lang").distinct().orderBy("lang").collect()]  # as many as there are languages
    planes = max(1, -(-len(languages) // 64))

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.by_partition(batches, 1 << 20):
            for name, x in zip(b["lang"].to_pylist(), b["text"].to_pylist()):
                grams = np.unique(ngrams(_codes([x.replace("\x00", " ")])[0], n))
                grams = grams[grams > 0].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams)], names=["lang", "gram"])

    sizes = sample.groupBy("lang").agg(F.count("*").alias("rows"))
    held = sample.mapInArrow(distinct, "lang string, gram long").groupBy("lang", "gram").agg(F.count("*").alias("n")).join(sizes, "lang")
    held = held.filter(F.col("n") >= F.greatest(F.col("rows") * share, F.lit(1))).select("lang", "gram")
    number = {x: i for i, x in enumerate(languages)}

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            which = np.array([number[x] for x in b["lang"].to_pylist()], np.int64)
            for at in places(b["gram"].to_numpy().view(np.uint64), hashes, bits):
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array((which // 64).astype(np.int32)), pa.array((np.uint64(1) << (which % 64).astype(np.uint64)).view(np.int64))], names=["at", "plane", "mask"])

    found = held.mapInArrow(slots, "at long, plane int, mask long").groupBy("at", "plane").agg(F.bit_or("mask").alias("mask")).toArrow()
    table = np.zeros((bits, planes), np.uint64)
    table[found["at"].to_numpy(), found["plane"].to_numpy()] = found["mask"].to_numpy().view(np.uint64)
    return Filters(languages, table, hashes, n)


def identify(docs: DataFrame, filters: Filters, *, text: str = "text") -> DataFrame:
    """docs with lang_pred and score; `und` and 0 for null texts, texts without a letter, or if nothing was learned.

    One pass without a shuffle. The filters have a fixed size. Clashing columns
    are replaced, others kept; repeated rows are rows. Texts are read whole; a
    long one is held in one task, at some 50 bytes a character. Languages with
    equal evidence go to the first in order.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("lang_pred", "score")])
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    names = [docs.select(text).columns[0]]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.by_partition(batches, 1 << 20):
            found = shared.value.predict(b[names[0]].to_pylist())
            extra = [pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(predict, common.schema_with(docs, lang_pred=T.StringType(), score=T.DoubleType()))
