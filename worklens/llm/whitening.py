"""Whitening of vectors: principal components by Chebyshev-filtered subspace iteration over distributed passes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worklens.llm import common

#: Directions that are followed besides those asked for.
SPARE = 12
#: Steps of the polynomial between two orthogonalisations.
DEGREE = 10
#: Certified: the residual of each component is at most this share of the largest eigenvalue and of its distance to the others.
RESIDUAL = 1e-12
#: Eigenvalues of at most this share of the largest one count as zero.
RANK = 1e-12
#: A round that leaves more than this share of the residual counts as none; after so many in a row rounding is taken to be reached.
SLOWEST, PATIENCE = 0.7, 5
#: A residual of this share of the largest eigenvalue is rounding: the pair is fixed, and the others are kept apart from it.
ROUNDING = 2e-13
#: How much more than the last wanted pair the polynomial may raise the first one that isn't fixed.
APART = 1e8

Pass = Callable[[np.ndarray], np.ndarray]


def integers(vectors: DataFrame, column: str, scale: float) -> DataFrame:
    """vectors with x, floor(scale * entry) of each entry as long; rows whose vector is null, empty or holds null or non-finite entries are dropped.

    So are those whose length isn't the most frequent one (of equally frequent
    ones the greatest), as they have no place in one covariance.
    """
    finite = F.forall(column, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = vectors.filter(F.col(column).isNotNull() & (F.size(column) > 0) & finite)
    length = rows.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    rows = rows.filter(F.size(column) == (length.d if length else 0))
    return rows.withColumn("x", F.transform(column, lambda e: F.floor(e.cast("double") * F.lit(scale)).cast("long")))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _summed(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray], height: int, width: int) -> np.ndarray:
    """The sum of of(x), a matrix of that height and width, over the rows' vectors x.

    Each task sums up what it reads, and Spark sums up the tasks' rows by their
    number; the driver gets one matrix, however many tasks there are.
    """
    names = [f"c{j}" for j in range(width)]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                here = of(_matrix(b.column(0)))
                total = here if total is None else total + here
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(height), pa.int32()), *map(pa.array, np.asarray(total, float).T)], names=["i", *names])

    sums = rows.select("x").mapInArrow(part, "i int, " + ", ".join(f"{c} double" for c in names)).groupBy("i").agg(*[F.sum(c).alias(c) for c in names])
    out = np.zeros((height, width))
    for r in sums.collect():
        out[r.i] = r[1:]
    return out


def top_components(multiply: Pass, dims: int, count: int, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """The largest `count` eigenvalues and their unit vectors, as columns, of a symmetric positive matrix known by its products with blocks.

    Chebyshev-filtered subspace iteration: a random block of count + SPARE
    columns goes through a polynomial that is at most one on [0, lowest Ritz
    value of the block], where the unwanted eigenvalues lie, and grows fast above;
    QR and Rayleigh-Ritz then give new pairs. It ends when each wanted pair's
    residual is RESIDUAL of the largest eigenvalue and of its distance to the
    next one (what bounds the angle to the true vector), or when rounding lets it
    get no better. Leading pairs that have come so far are fixed and projected
    out of what the others go through, and the polynomial's degree is such that it
    never raises the first of the rest beyond what rounding bears; so a few great
    eigenvalues before a flat rest do no harm. With no more dimensions than columns the first Rayleigh-Ritz
    is the answer. Each vector's sign makes its entry of greatest size positive.
    """
    block, wanted = min(dims, count + SPARE), min(count, dims)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, block)))[0]
    best, waited, kept, locked = np.inf, 0, None, 0
    while True:
        aq = multiply(q)
        h = q.T @ aq
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, aq = q @ turn, aq @ turn
        top = max(values[0], 0.0)
        residual = np.linalg.norm(aq - q * values, axis=0)[:wanted]
        gaps = [min(abs(values[i] - values[j]) for j in range(block) if j != i) if block > 1 else top for i in range(wanted)]
        floor = [max(g, 1e-4 * v, 1e-9 * top) for g, v in zip(gaps, values)]  # equal eigenvalues have no vectors of their own
        share = [r / g if top else 0.0 for r, g in zip(residual, floor, strict=True)]
        worst = 0.0 if top == 0 or block == dims else max(share)
        waited = 0 if worst < SLOWEST * best else waited + 1
        if worst < best:
            best, kept = worst, (values.copy(), q.copy())
        if worst <= RESIDUAL or waited >= PATIENCE:
            break
        done = [s <= RESIDUAL or r <= ROUNDING * top for s, r in zip(share, residual, strict=True)]
        locked = max(locked, next((i for i, d in enumerate(done) if not d), wanted - 1))
        fixed, lead = q[:, :locked], max(values[locked], 1e-300)
        upper = max(values[-1], 1e-9 * lead)
        e = c = upper / 2
        # how far the polynomial may tell the first active pair from the last wanted one, as rounding drowns the latter else
        spread = np.arccosh(max(1.0, (lead - c) / e)) - np.arccosh(max(1.0, (values[wanted - 1] - c) / e))
        degree = int(min(DEGREE, max(1, np.log(APART) / max(spread, 1e-9))))
        apart = lambda y, v=fixed: y - v @ (v.T @ y)
        sigma = first = e / (lead - c)
        before = q[:, locked:]
        now = (apart(multiply(before)) - c * before) * (sigma / e)
        for _ in range(degree - 1):
            after = 1 / (2 / first - sigma)
            before, now = now, (apart(multiply(now)) - c * now) * (2 * after / e) - before * (sigma * after)
            sigma = after
        now = now / np.maximum(np.linalg.norm(now, axis=0), 1e-300)
        q = np.linalg.qr(np.concatenate([fixed, now], axis=1))[0]
    values, q = kept
    values, q = values[:wanted], q[:, :wanted]
    return values, q * np.where(q[np.abs(q).argmax(axis=0), range(wanted)] < 0, -1.0, 1.0)


def whiten(vectors: DataFrame, column: str = "embedding", count: int = 4, scale: float = 256.0) -> DataFrame:
    """For each remaining row of vectors and each of the first `count` components: component, n, deviation, whitened, explained, identity_error.

    See integers() for what becomes of entries and which rows remain. Mean and
    covariance are those of the distinct vectors, n of them, divided by n.
    deviation is exact, the sum of (n * x - S) squared, null where that doesn't
    fit in a long. whitened is x less the mean along the component over the root
    of its eigenvalue, null for an eigenvalue of zero (fewer distinct vectors
    than components, say); explained is its share of all variance, null if there
    is none. identity_error is measured on whitened itself, by one more pass over
    the distinct vectors. Vectors of fewer entries than `count` have as many
    components. Repeated rows have rows of their own; other columns stay, unless
    they are named like new ones. Without rows nothing is returned.

    Only blocks of a few columns go through the driver: the dimension times
    count + SPARE. Each pass centres the distinct vectors, which are written
    once, multiplies them with the block and sums up.
    """
    new = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = integers(vectors, column, scale)
    kept = [f for f in vectors.schema.fields if f.name not in [*new, "x", column]]
    rows = rows.select(*[f.name for f in kept], "x")
    schema = T.StructType([*kept, *T.StructType.fromDDL("component int, n bigint, deviation bigint, whitened double, explained double, identity_error double").fields])
    fit = common.staged(rows.select("x").distinct(), "whitening-fit")
    found = fit.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).first()
    n, dims = found.n, found.d or 0
    if not n:
        return vectors.sparkSession.createDataFrame([], schema)
    numbered = fit.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("s"))
    sums = [int(r.s) for r in sorted(numbered.collect())]
    mean = np.array([s / n for s in sums])  # one rounding each

    def multiply(q: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            c = x - mean
            return c.T @ (c @ q)

        return _summed(fit, part, dims, q.shape[1]) / n

    values, basis = top_components(multiply, dims, count)
    trace = _summed(fit, lambda x: ((x - mean) ** 2).sum(axis=0)[:, None], dims, 1).sum() / n
    real = values > RANK * max(values[0], 0.0)
    to_white = basis[:, real] / np.sqrt(values[real])
    k = int(real.sum())
    error = None
    if k:
        white = lambda x: (x - mean) @ to_white
        middle = _summed(fit, lambda x: white(x).sum(axis=0)[:, None], k, 1)[:, 0] / n

        def square(x: np.ndarray) -> np.ndarray:
            w = white(x) - middle
            return w.T @ w

        error = float(np.abs(_summed(fit, square, k, k) / n - np.eye(k)).max())
    explained = [float(v / trace) if trace > 0 else None for v in np.where(real, values, 0.0)]
    names = [f.name for f in kept]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for batch in batches for p in common.by_partition(iter([batch]))):
            x = _matrix(b.column(b.num_columns - 1))
            far = np.abs(x.astype(float) * n - np.array([float(s) for s in sums])).max()
            if far < 2.0**31 and far * far * dims < 2.0**62:
                deviation = ((x * n - np.array(sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
            else:
                deviation = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
                deviation = [v if v < 1 << 63 else None for v in deviation]
            white = (x - mean) @ to_white
            times = len(values)
            at = np.repeat(np.arange(b.num_rows), times)
            again = b.select(range(b.num_columns - 1)).take(pa.array(at)) if names else None
            shown = np.full((b.num_rows, times), np.nan)
            shown[:, np.flatnonzero(real)] = white
            m = len(at)
            yield pa.RecordBatch.from_arrays(
                [
                    *(again.columns if names else []), pa.array(np.tile(np.arange(1, times + 1, dtype=np.int32), b.num_rows)), pa.array(np.full(m, n, np.int64)), pa.array([deviation[i] for i in at], pa.int64()),
                    pa.array(shown.ravel(), pa.float64(), mask=np.tile(~real, b.num_rows)), pa.array(explained * b.num_rows, pa.float64()), pa.array([error] * m, pa.float64()),
                ], names=[*names, *new],
            )

    return rows.mapInArrow(project, schema)
