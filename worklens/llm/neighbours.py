"""Approximate nearest neighbours by cross-polytope hashing, multiprobe tables and exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from worklens.llm import common

#: Bands of norms, each 1 / sqrt(2) of the one before; the last holds all that are shorter still.
BANDS = 16
#: Asking classes whose nearest are found exactly to choose tables and probes, other classes for their costs, and the share of the nearest to be found.
SAMPLE, OTHERS, RECALL = 256, 2048, 0.95
#: A band of which more than this share would be compared is compared whole.
WORTH = 0.8


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    rows, n = x.shape
    h = 1
    while h < n:
        x = x.reshape(rows, n // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(rows, n)
        h *= 2
    return x / np.sqrt(n)


def rotate(x: np.ndarray, table: int, seed: int) -> np.ndarray:
    """Pseudo-rotation: three rounds of random signs and a Hadamard transform, after padding with zeros."""
    n = 1 << max(1, (x.shape[1] - 1).bit_length())
    out = np.zeros((len(x), n))
    out[:, : x.shape[1]] = x
    signs = np.random.default_rng([seed, table]).choice([-1.0, 1.0], (3, n))
    for s in signs:
        out = hadamard(out * s)
    return out


@dataclass(frozen=True)
class Hash:
    """A cell is named by the nearest signed axes of `full` polytopes, and of one more by that axis modulo `groups`."""

    dims: int
    full: int
    groups: int
    seed: int

    @property
    def axes(self) -> int:
        return 2 << max(1, (self.dims - 1).bit_length())

    @property
    def polytopes(self) -> int:
        return self.full + (self.groups > 1)

    @property
    def cells(self) -> int:
        return self.axes**self.full * self.groups

    def turned(self, x: np.ndarray, table: int) -> list[np.ndarray]:
        """The coordinates along each signed axis of each polytope: axis i is 2i, its opposite 2i + 1."""
        each = [rotate(x, 64 * table + k, self.seed) for k in range(self.polytopes)]
        return [np.stack([r, -r], axis=2).reshape(len(x), -1) for r in each]

    def cell(self, x: np.ndarray, table: int) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        for k, along in enumerate(self.turned(x, table)):
            axis = along.argmax(axis=1)
            out = out * self.axes + axis if k < self.full else out * self.groups + axis % self.groups
        return out

    def shortfalls(self, x: np.ndarray, table: int) -> list[np.ndarray]:
        """For each polytope what each axis, or the best of each group, is short of the nearest one."""
        out = [along.max(axis=1, keepdims=True) - along for along in self.turned(x, table)]
        if self.groups > 1:
            out[-1] = np.stack([out[-1][:, g :: self.groups].min(axis=1) for g in range(self.groups)], axis=1)
        return out

    def shortfall(self, x: np.ndarray, cell: np.ndarray, table: int) -> np.ndarray:
        """What the cell of each row is short of the best one, summed over the polytopes."""
        out = np.zeros(cell.shape)
        for short in reversed(self.shortfalls(x, table)):
            cell, digit = np.divmod(cell, short.shape[1])
            out += np.take_along_axis(short, digit, 1)
        return out

    def probes(self, x: np.ndarray, table: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell): of each row the cells that are short of the best one by `slack` at most."""
        row, cell, spent = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
        for short in self.shortfalls(x, table):
            now = spent[:, None] + short[row]
            at, digit = np.nonzero(now <= slack)
            row, cell, spent = row[at], cell[at] * short.shape[1] + digit, now[at, digit]
        return row, cell


def hash_for(count: int, dims: int, leaf: int, seed: int) -> Hash:
    """So many polytopes that a cell holds about `leaf` of `count` vectors: they grow with the logarithm of the count."""
    h, cells = Hash(dims, 0, 1, seed), max(1, count // leaf)
    while h.axes ** (h.full + 1) <= cells:
        h = Hash(dims, h.full + 1, 1, seed)
    return Hash(dims, h.full, min(h.axes, max(1, cells // h.axes**h.full)), seed)


@dataclass(frozen=True)
class Plan:
    """How a band is searched: through so many tables with so much slack, or whole."""

    tables: int
    slack: float
    whole: bool


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _bands(x: np.ndarray, high: float, count: int) -> np.ndarray:
    with np.errstate(all="ignore"):
        found = np.nan_to_num(2 * np.log2(high / np.sqrt((x * x).sum(axis=1))), posinf=count)
    return np.clip(found, 0, count - 1).astype(np.int64)


def _seen_bands(high: float):
    def see(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(_bands(_matrix(b["v"]), high, BANDS)))], names=["band"])

    return see


def _sampled_pairs(classes: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors q of up to SAMPLE asking classes, and of each its k nearest other classes by a look at all: (q, i, x), x[j] near q[i[j]]."""
    some = classes.filter("asks").orderBy(F.xxhash64("class"), "class").limit(SAMPLE).select("class", "v").toArrow()
    if not some.num_rows:
        return np.zeros((0, 1)), np.zeros(0, np.int64), np.zeros((0, 1))
    q, own = _matrix(some["v"]), some["class"].to_numpy()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, ids = np.zeros((len(q), 0)), np.zeros((len(q), 0), np.int64)
        for b in common.by_partition(batches, 1 << 20):
            now = b["class"].to_numpy()
            found = q @ _matrix(b["v"]).T
            found[own[:, None] == now[None]] = -np.inf
            score, ids = np.concatenate([score, found], axis=1), np.concatenate([ids, np.broadcast_to(now, found.shape)], axis=1)
            if score.shape[1] > k:
                best = np.lexsort((ids, -score), axis=1)[:, :k]
                score, ids = np.take_along_axis(score, best, 1), np.take_along_axis(ids, best, 1)
        i = np.repeat(np.arange(len(q)), score.shape[1])
        real = score.ravel() > -np.inf
        yield pa.RecordBatch.from_arrays([pa.array(i[real]), pa.array(ids.ravel()[real]), pa.array(score.ravel()[real])], names=["i", "class", "score"])

    found = classes.select("class", "v").mapInArrow(search, "i long, class long, score double")
    found = found.withColumn("at", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("score"), "class"))).filter(F.col("at") <= k)
    found = classes.select("class", "v").join(F.broadcast(found.select("i", "class")), "class").select("i", "v").toArrow()  # SAMPLE * k rows at most
    return q, found["i"].to_numpy(), _matrix(found["v"]) if found.num_rows else np.zeros((0, q.shape[1]))


def _plans(h: Hash, q: np.ndarray, i: np.ndarray, x: np.ndarray, near: np.ndarray, others: np.ndarray, away: np.ndarray, tables: int) -> list[Plan]:
    """For each band the tables and slack that find RECALL of the sampled pairs with the fewest comparisons; near and away are the bands of x and others."""
    need, cost = np.zeros((tables, len(i))), np.zeros((tables, len(q), len(others)))
    unit = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
    for t in range(tables if len(i) else 0):
        for at in range(0, len(i), 4096):
            some = slice(at, at + 4096)
            need[t, some] = h.shortfall(unit[i[some]], h.cell(x[some], t)[:, None], t)[:, 0]
        cost[t] = h.shortfall(unit, np.broadcast_to(h.cell(others, t), (len(q), len(others))), t)
    out = []
    for band in range(BANDS):
        mine = near == band if (near == band).any() else np.ones(len(i), bool)
        there = away == band if (away == band).any() else np.ones(len(others), bool)
        found = []
        for n in [2**j for j in range(tables.bit_length())] if len(i) else []:
            slack = float(np.quantile(need[:n, mine].min(axis=0), RECALL, method="higher"))
            found.append(((cost[:n, :, there] <= slack).mean(axis=(1, 2)).sum() if there.any() else 1.0, n, slack))
        share, n, slack = min(found, default=(1.0, 1, 0.0))
        out.append(Plan(n, slack, bool(share > WORTH)))
    return out


def nearest(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", queries: str = "vec_id % 20 = 0", k: int = 20, tables: int = 8, leaf: int = 16, chunk: int = 1 << 16, seed: int = 7) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that `queries` selects its k nearest other rows found, by inner product.

    Vectors that are null, zero, of another length than most, or hold a null or
    non-finite component take no part. Equal vectors form a class, hashed and
    compared once; a class keeps its k + 1 smallest ids, as more can't be among
    the nearest. Classes are parted in bands by norm, each hashed by direction.
    A table names a class's cell by its nearest signed axes in several turned
    polytopes, as many as leave about `leaf` classes in a cell; a query looks in
    all cells whose axes are together short of its best ones by no more than the
    band's slack. The exact nearest of SAMPLE asking classes tell which number of
    tables, `tables` at most, and which slack find RECALL of them with the fewest
    comparisons. A band of which more than WORTH would be compared is compared
    whole, as are small tables. Scores come from the vectors as they are, in
    double precision, ties to the smaller id.

    Cells lie in parts of about `chunk` classes; a query goes to each part that
    holds one of its cells and meets just these there. A part of more classes is
    dealt to several tasks, and its queries go to each; each task returns k + 1
    candidates a query, which loses none of the nearest. Rows of a repeated
    vec_id count as rows; a null vec_id takes no part. Other columns are not
    carried along, whatever their names. An empty table gives an empty table.
    """
    spark = vectors.sparkSession
    kind = "float" if vectors.select(embedding).schema[0].dataType.simpleString() == "array<float>" else "double"  # floats travel as such
    v = F.col(embedding).cast(f"array<{kind}>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"), F.coalesce(F.expr(queries), F.lit(False)).alias("asks"))
    rows = rows.filter(F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    rows = rows.withColumns({"a": F.xxhash64("v"), "b": F.xxhash64(F.lit(1), "v")})
    length = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if length is None:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.size("v") == length["n"])
    classes = rows.groupBy("a", "b").agg(F.first("v").alias("v"), F.min("vec_id").alias("class"), F.max("asks").alias("asks"))
    classes = common.staged(classes, "vector-classes")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    high, count = classes.agg(F.max(norm), F.count("*")).first()
    h, parts_of = hash_for(count, length["n"], leaf, seed), max(1, count // chunk)
    q, i, x = _sampled_pairs(classes, k)
    some = _matrix(classes.orderBy(F.xxhash64(F.lit(2), "class"), "class").limit(OTHERS).select("v").toArrow()["v"])
    plan = _plans(h, q, i, x, _bands(x, high, BANDS), some, _bands(some, high, BANDS), tables)
    bands = sorted(r[0] for r in classes.select("v").mapInArrow(_seen_bands(high), "band long").distinct().collect())  # BANDS at most
    parts = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / chunk)).cast("int")
    direction = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    lies_in = lambda cell: cell * parts_of // h.cells if h.cells * parts_of < 1 << 62 else cell // -(-h.cells // parts_of)

    def placed(t: int, axis: np.ndarray, row: np.ndarray, b: pa.RecordBatch) -> pa.RecordBatch:
        take = pa.array(row)
        return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(t, len(row)).astype(np.int32)), pa.array(np.broadcast_to(axis, len(row)).astype(np.int64)), b["class"].take(take), b["v"].take(take)], names=["t", "part", "class", "v"])

    # t counts bands and tables; a band that is compared whole is one part, named -1
    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.by_partition(batches, 256 << 10):
            x = _matrix(b["v"])
            bands = _bands(x, high, BANDS)
            for band in np.unique(bands).tolist():
                row = np.flatnonzero(bands == band)
                if plan[band].whole:
                    yield placed(band * tables, -1, row, b)
                for t in range(0 if plan[band].whole else plan[band].tables):
                    yield placed(band * tables + t, lies_in(h.cell(x[row], t)), row, b)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.by_partition(batches, 256 << 10):
            x = direction(_matrix(b["v"]))
            for band, p in ((x, plan[x]) for x in bands):
                if p.whole:
                    yield placed(band * tables, -1, np.arange(b.num_rows), b)
                for t in range(0 if p.whole else p.tables):
                    row, cell = h.probes(x, t, p.slack)
                    row, part = np.unique(np.stack([row, lies_in(cell)]), axis=1)
                    yield placed(band * tables + t, part, row, b)

    keyed = f"t int, part long, class long, v array<{kind}>"
    base = classes.select("class", "v").mapInArrow(store, keyed)
    asked = classes.filter("asks").select("class", "v").mapInArrow(ask, keyed)
    # one row a part: as many as there are classes by chunk, bands and tables
    counts = common.staged(base.groupBy("t", "part").agg(F.count("*").alias("n")).join(asked.groupBy("t", "part").agg(F.count("*").alias("m")), ["t", "part"]), "part-sizes")
    counts = counts.select("t", "part", parts("n").alias("n"), parts("m").alias("m"))
    spread = lambda df, own, other: df.join(counts, ["t", "part"]).withColumns({own: F.pmod(F.xxhash64("class"), F.col("n" if own == "i" else "m")).cast("int"), other: F.explode(F.sequence(F.lit(0), F.col("m" if own == "i" else "n") - 1))}).drop("n", "m")
    bucket = ["t", "part", "i", "j"]

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], []]
        if left.num_rows and right.num_rows:
            x, q = _matrix(left["v"]), _matrix(right["v"])
            ids, asks = left["class"].to_numpy(), right["class"].to_numpy()
            band, t = divmod(left["t"][0].as_py(), tables)
            whole, cells = plan[band].whole, np.zeros(len(x), np.int64)
            if not whole:  # cells in a row
                cells = h.cell(x, t)
                order = np.argsort(cells, kind="stable")
                x, ids, cells = x[order], ids[order], cells[order]
            here, begin = np.unique(cells, return_index=True)
            end, longest = np.append(begin[1:], len(x)), np.linalg.norm(x, axis=1).max()
            for at in range(0, len(q), 256):
                part = q[at : at + 256]
                if whole:
                    score = part @ x.T
                else:
                    score = np.full((len(part), len(x)), -np.inf)
                    row, cell = h.probes(direction(part), t, plan[band].slack)
                    place = np.minimum(np.searchsorted(here, cell), len(here) - 1)
                    real = here[place] == cell
                    row, place = row[real], place[real]
                    order = np.argsort(place, kind="stable")
                    for mine in np.split(order, np.flatnonzero(np.diff(place[order])) + 1) if len(order) else []:
                        a, z = begin[place[mine[0]]], end[place[mine[0]]]
                        score[row[mine], a:z] = part[row[mine]] @ x[a:z].T
                # all that may tie with the last one kept, then exact scores, ties to the smaller class
                keep = min(k + 1, len(x))
                last = np.partition(score, len(x) - keep, axis=1)[:, len(x) - keep]
                slip = 4 * x.shape[1] * np.finfo(float).eps * np.linalg.norm(part, axis=1) * longest
                row, found = np.nonzero((score >= (last - slip)[:, None]) & (score > -np.inf))
                exact = (part[row] * x[found]).sum(axis=1)  # in one order for a pair, whatever the part
                order = np.lexsort((ids[found], -exact, row))
                row, found, exact = row[order], found[order], exact[order]
                first = np.arange(len(row)) - np.searchsorted(row, row) < keep
                row, found, exact = row[first], found[first], exact[first]
                out[0].append(asks[at : at + 256][row])
                out[1].append(ids[found])
                out[2].append(exact)
        return pa.table([pa.array(np.concatenate(c) if c else np.zeros(0), t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.float64()))], names=["query", "class", "score"])

    found = spread(base, "i", "j").groupBy(*bucket).cogroup(spread(asked, "j", "i").groupBy(*bucket)).applyInArrow(compare, "query long, class long, score double")
    found = found.groupBy("query", "class").agg(F.max("score").alias("score"))
    top = lambda df, by, *order: df.withColumn("at", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("at") <= k + 1).drop("at")
    found = top(found, "query", F.desc("score"), F.col("class"))
    named = rows.select("vec_id", "asks", "a", "b")
    members = top(named.withColumn("key", F.struct("a", "b")), "key", F.col("vec_id")).drop("key")
    members = members.join(classes.select("a", "b", "class"), ["a", "b"]).select("class", "vec_id")
    near = top(found.join(members, "class"), "query", F.desc("score"), F.col("vec_id"))
    near = near.groupBy("query").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id"))).alias("near"))
    asking = named.filter("asks").join(classes.select("a", "b", F.col("class").alias("query")), ["a", "b"])
    # an id that several equal rows share takes one of them away, the query's own
    own = F.array_position(F.col("near.vec_id"), F.col("vec_id")).cast("int")
    others = F.when(own > 0, F.concat(F.slice("near", F.lit(1), own - 1), F.slice("near", own + 1, k))).otherwise(F.col("near"))
    out = asking.join(near, "query").select(F.col("vec_id").alias("query_id"), F.posexplode(F.slice(others, 1, k)).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.less")).alias("score"))
