"""Benchmark decontamination with a generalised suffix automaton of the test items."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worklens.llm import common

#: Bytes that part words once A-Z are lower-cased: all of ASCII but digits and letters.
_TABLE = bytes(32 if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) else b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def word_spans(text: str) -> list[tuple[int, int]]:
    """Where each word stands, in bytes of the UTF-8 text."""
    raw = text.encode("utf-8", "surrogatepass").translate(_TABLE)
    out, at = [], 0
    for w in raw.split():
        at = raw.index(w, at)
        out.append((at, at + len(w)))
        at += len(w)
    return out


class Automaton:
    """Suffix automaton of several word sequences.

    A state stands for the sequences that end at the same places of the items.
    Each window of an item, `window` words or the whole of a shorter item, lies
    in one state, which gets a mark (length, items). `up` leads from a state to
    the nearest marked one along suffix links, itself included.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(name, [self.ids.setdefault(w, len(self.ids)) for w in words]) for name, words in items if words]
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        marks: dict[int, dict[int, set[str]]] = {}
        for name, codes in coded:
            need, state, size = min(window, len(codes)), 0, 0
            for c in codes:
                state, size = self._step(state, size, c)
                if size >= need:
                    at = state
                    while self.length[self.link[at]] >= need:
                        at = self.link[at]
                    marks.setdefault(at, {}).setdefault(need, set()).add(name)
        self.marks = {s: sorted(m.items(), reverse=True) for s, m in marks.items()}
        self.up = [-1] * len(self.link)
        for s in sorted(range(len(self.link)), key=self.length.__getitem__):
            self.up[s] = s if s in self.marks else self.up[self.link[s]] if self.link[s] >= 0 else -1
        self.least = min((n for m in marks.values() for n in m), default=0)

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:  # the sequence is there; its state may have to be parted
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._part(last, q, c)
        new = len(self.link)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._part(p, q, c)
        return new

    def _part(self, p: int, q: int, c: int) -> int:
        clone = len(self.link)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _step(self, state: int, size: int, c: int) -> tuple[int, int]:
        while state and c not in self.next[state]:
            state = self.link[state]
            size = self.length[state]
        if c in self.next[state]:
            return self.next[state][c], size + 1
        return 0, 0

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Stretches of words (from, to) that windows cover, in order and apart, and the items whose windows occur."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        codes = list(map(self.ids.get, words))
        codes.append(None)
        at, n = 0, len(words)
        while at < n:
            end = codes.index(None, at)  # words that no item has part the text
            if end - at >= self.least:
                self._run(codes, at, end, spans, items)
            at = end + 1
        merged: list[tuple[int, int]] = []
        for a, b in spans:
            while merged and a <= merged[-1][1]:
                a, b = min(a, merged[-1][0]), max(b, merged[-1][1])
                merged.pop()
            merged.append((a, b))
        return merged, items

    def _run(self, codes: list, at: int, end: int, spans: list, items: set[str]) -> None:
        step, link, length, up = self.next, self.link, self.length, self.up
        state = size = 0
        for i in range(at, end):
            c = codes[i]
            to = step[state].get(c)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = step[state].get(c)
            if to is None:
                continue
            state, size = to, size + 1
            if size < self.least:
                continue
            mark, covers = up[state], 0
            while mark >= 0:
                for need, names in self.marks[mark]:
                    if need <= size:
                        covers = max(covers, need)
                        items |= names
                mark = up[link[mark]] if link[mark] >= 0 else -1
            if covers:
                spans.append((i - covers + 1, i + 1))


def find_windows(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, most_words: int = 200_000) -> DataFrame:
    """docs with n_words, spans (array of word stretches [start, stop)) and items (sorted ids as strings).

    A document word is hit if it lies in an occurrence of `window` consecutive
    words of an item, or of a whole shorter item. Items without words match
    nothing; null texts have no words; items that repeat count by their id; a
    null item_id is the string "null". Clashing columns are replaced.

    Documents stay where they are read: no shuffle. The automaton goes to all
    tasks, so its size is checked: items are dealt to parts of about most_words
    words, some 200 MB of states at the default, and longer items are cut in
    pieces that share their windows. With several parts the documents pass
    through one automaton after the other, and are written in between, so that a
    task holds one at a time. A long text is held in one task, with its words.
    Repeated rows stay.
    """
    spark = docs.sparkSession
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_words", "spans", "items")])
    at = docs.select(text).columns[0]
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    words = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // 2
    parts = max(1, -(-words // most_words))
    stretch = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])
    fields = common.schema_with(docs, n_words=T.LongType(), spans=T.ArrayType(stretch), items=T.ArrayType(T.StringType()))
    out = docs.withColumns({"n_words": F.lit(0).cast("long"), "spans": F.array().cast("array<struct<start:int,stop:int>>"), "items": F.array().cast("array<string>")})
    for part in range(parts):
        mine = items if parts == 1 else items.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == part)
        rows = [(r[0], piece) for r in mine.collect() for piece in _pieces(words_of(r[1]), most_words, window)]  # about most_words words
        shared = spark.sparkContext.broadcast(pickle.dumps(Automaton(rows, window)))
        out = out.mapInArrow(_matcher(shared, at), fields)
        if part + 1 < parts:
            out = common.staged(out, "matched")
    return out


def _pieces(words: list[bytes], most: int, window: int) -> list[list[bytes]]:
    """words, or pieces of at most `most` of them and a window more that hold all their windows."""
    return [words[a : a + most + window - 1] for a in range(0, max(1, len(words) - window + 1), most)] if len(words) > most + window else [words]


def _matcher(shared, at: str):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = pickle.loads(shared.value)
        kinds = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        for b in common.by_partition(batches, 2 << 20):
            n, spans, items = [], [], []
            for x, old, had in zip(b[at].to_pylist(), b["spans"].to_pylist(), b["items"].to_pylist()):
                words = words_of(x)
                found, names = automaton.hits(words)
                n.append(len(words))
                spans.append([{"start": s, "stop": e} for s, e in _union(found, [(o["start"], o["stop"]) for o in old])])
                items.append(sorted(names.union(had)))
            kept = [b[c] for c in b.schema.names if c not in ("n_words", "spans", "items")]
            names = [c for c in b.schema.names if c not in ("n_words", "spans", "items")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n, pa.int64()), pa.array(spans, kinds), pa.array(items, pa.list_(pa.string()))], names=[*names, "n_words", "spans", "items"])

    return match


def _union(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    if not b:
        return a
    out: list[tuple[int, int]] = []
    for s, e in sorted([*a, *b]):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def hit_words(spans: str = "spans"):
    return F.coalesce(F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"]), F.lit(0).cast("long"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", window: int = 10, coverage: float = 0.5) -> DataFrame:
    """docs without their contaminated stretches; rows of which more than `coverage` is hit go whole. Same columns."""
    found = find_windows(docs, benchmark, text=text, window=window)
    found = found.filter(hit_words() <= F.col("n_words") * coverage)
    at, names = docs.select(text).columns[0], docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.by_partition(batches, 2 << 20):
            out = []
            for x, spans in zip(b[at].to_pylist(), b["spans"].to_pylist()):
                if spans:
                    where, raw, kept, last = word_spans(x), x.encode("utf-8", "surrogatepass"), [], 0
                    for s in spans:
                        kept.append(raw[last : where[s["start"]][0]])
                        last = where[s["stop"] - 1][1]
                    x = b"".join([*kept, raw[last:]]).decode("utf-8", "surrogatepass")
                out.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == at else b[c] for c in names], names=names)

    return found.mapInArrow(cut, docs.schema)
