"""SimHash near-dedup with a hierarchical index over fingerprints in Gray order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worklens.llm import common, overlap
from worklens.llm.components import connected_components

SEED = 42
#: Codes of a leaf and children of a node.
FAN = 8
#: So many codes are compared directly.
FEW = 96
#: 64-bit words of a wide fingerprint.
WORDS = 8
_FACTORS = np.random.default_rng(8).integers(1, 1 << 63, WORDS).astype(np.uint64) | np.uint64(1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(raw: bytes, shingle: int) -> np.ndarray:
    """The hashes of the word shingles, repeats included; of fewer words, of the whole sequence; none for no words."""
    words = raw.lower().split()  # on bytes: A-Z only, and blanks \\x20, \\x09 to \\x0D
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)] if words else [], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    digest = xxhash.xxh64_intdigest
    starts, stops = (ends - sizes)[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], np.uint64)


def _majority(hashes: np.ndarray) -> np.ndarray:
    """hashes (n, words) to (words): bits set in over half the rows."""
    ones = np.zeros(64 * hashes.shape[1], np.int64)
    for at in range(0, len(hashes), 1 << 13):
        part = np.ascontiguousarray(hashes[at : at + (1 << 13)])
        ones += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)


def fingerprint(raw: bytes, shingle: int) -> int:
    """Bit i is 1 if it is set in over half the hashes of the word shingles; 0 for no words."""
    return int(_majority(shingle_hashes(raw, shingle)[:, None])[0])


def wide_fingerprint(raw: bytes, shingle: int) -> bytes:
    """WORDS fingerprints in one, each of other hashes of the same shingles; the first is the plain one."""
    return wide_majority(shingle_hashes(raw, shingle))


def wide_majority(hashes: np.ndarray) -> bytes:
    """The wide fingerprint of a text's shingle hashes."""
    hashes = hashes[:, None]
    mixed = hashes[:, :1] * _FACTORS[1:]
    mixed = (mixed ^ (mixed >> np.uint64(31))) * _SPREAD
    mixed ^= mixed >> np.uint64(29)
    return _majority(np.concatenate([hashes, mixed], axis=1)).tobytes()


def fingerprints(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", shingle: int = 4) -> DataFrame:
    """(doc_id, key, code): one row a row of docs; key is a digest of the text, code the fingerprint as a signed long."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.by_partition(batches, 2 << 20):
            codes = np.array([fingerprint(x, shingle) for x in b["raw"].to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["key"], pa.array(codes)], names=["doc_id", "key", "code"])

    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.md5(raw).alias("key"), raw.alias("raw")).mapInArrow(encode, "doc_id long, key string, code long")


def gray_rank(code: Column) -> Column:
    """The place of a code in Gray order: neighbours differ in one bit."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code


class GrayIndex:
    """Hierarchical index over codes in Gray order.

    A node keeps the bits that all codes below it share and its parent's don't,
    as mask and pattern. A search adds up the differences in these bits on its
    way down and leaves a node as soon as they exceed the distance; if they plus
    the node's open bits don't, all codes below match and it stops there too.
    """

    def __init__(self, codes: np.ndarray, distance: int):
        self.codes, self.distance = codes, distance
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        level = [(codes, np.full(len(codes), full))]  # values where shared, shared bits
        ands, ors = codes, codes
        while len(ands) > FAN:
            cut = np.arange(0, len(ands), FAN)
            ands, ors = np.bitwise_and.reduceat(ands, cut), np.bitwise_or.reduceat(ors, cut)
            shared = ~(ands ^ ors)
            level.append((ands & shared, shared))
        self.levels = level[::-1]
        self.open = [np.bitwise_count(~shared) for _, shared in self.levels]

    def links(self, every: bool = False, block: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places within the distance, enough of them to connect all that such pairs connect, or every one."""
        top, n = len(self.levels) - 1, len(self.codes)
        for depth in range(0 if every else top):  # nodes whose codes all match each other
            size = FAN ** (top - depth)
            for node in np.flatnonzero(self.open[depth] <= self.distance):
                members = np.arange(node * size, min(n, (node + 1) * size))
                yield np.full(len(members) - 1, members[0]), members[1:]
        for at in range(0, n, block):
            query, node = np.meshgrid(np.arange(at, min(n, at + block)), np.arange(len(self.levels[0][0])), indexing="ij")
            query, node = query.ravel(), node.ravel()
            known, so_far = np.zeros(len(query), np.uint64), np.zeros(len(query), np.int64)
            for depth, (pattern, shared) in enumerate(self.levels):
                so_far = so_far + np.bitwise_count((self.codes[query] ^ pattern[node]) & shared[node] & ~known)
                size = FAN ** (top - depth)
                near = (so_far <= self.distance) & (node * size <= query)  # each pair from its later code
                query, node, so_far = query[near], node[near], so_far[near]
                whole = (so_far + self.open[depth][node] <= self.distance) & (depth == top or not every)
                if whole.any():
                    yield query[whole], node[whole] * size
                    query, node, so_far = query[~whole], node[~whole], so_far[~whole]
                if depth == top or not len(query):
                    break
                known = np.repeat(shared[node], FAN)
                query, so_far = np.repeat(query, FAN), np.repeat(so_far, FAN)
                node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                there = node < len(self.levels[depth + 1][0])
                query, node, so_far, known = query[there], node[there], so_far[there], known[there]


def _join(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """parent with the groups of each pair made one; parent[x] is a smallest member."""
    while True:
        a, b = parent[i], parent[j]
        if (a == b).all():
            return parent
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def bucket_links(codes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """codes in Gray order to links (code, smallest place's code) that connect what pairs within distance connect."""
    parent = np.arange(len(codes))
    if len(codes) <= FEW:
        i, j = np.nonzero(np.triu(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= distance, 1))
        parent = _join(parent, i, j) if len(i) else parent
    else:
        for i, j in GrayIndex(codes, distance).links():
            parent = _join(parent, i, j)
    own = np.flatnonzero(parent != np.arange(len(codes)))
    return codes[own], codes[parent[own]]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _cuts(mask: int, parts: int) -> list[int]:
    """The bits outside mask in `parts` runs, each joined to mask."""
    bits = [b for b in range(64) if not mask >> b & 1]
    return [mask | sum(1 << b for b in bits[i * len(bits) // parts : (i + 1) * len(bits) // parts]) for i in range(parts)]


def near_links(codes: DataFrame, distance: int = 4, most: int = 4096, deepest: int = 4) -> DataFrame:
    """codes (code, distinct) to links (a, b) whose components are those of all pairs within distance.

    Two such codes agree in at least one of distance + 1 runs of bits, so every
    code goes to as many buckets. A bucket with over `most` codes is cut again:
    its codes agree elsewhere in one of distance + 1 runs of the other bits.
    Each bucket sorts its codes in Gray order and searches its own hierarchical
    index; it returns at most one link a code.
    """
    masks = _cuts(0, distance + 1)
    keyed = codes.select("code", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask")).withColumn("value", F.col("code").bitwiseAND(F.col("mask")))
    done = None
    for _ in range(deepest):
        sizes = keyed.groupBy("mask", "value").agg(F.count("*").alias("n"))
        hot = common.staged(sizes.filter(F.col("n") > most).select("mask", "value"), "hot-buckets")
        if hot.isEmpty():
            break
        finer = {m: _cuts(m, distance + 1) for m in masks}
        fits = keyed.join(hot, ["mask", "value"], "left_anti")
        done = fits if done is None else done.union(fits)
        table = F.create_map(*[x for m, cuts in finer.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(c)) for c in cuts]))])
        cut = keyed.join(hot, ["mask", "value"]).select("code", F.explode(table[F.col("mask")]).alias("mask"))
        keyed = common.staged(cut.withColumn("value", F.col("code").bitwiseAND(F.col("mask"))), "finer-buckets")
        masks = sorted({c for cuts in finer.values() for c in cuts})
    keyed = keyed if done is None else done.union(keyed)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        for b in batches:
            now = [np.concatenate([h, b[c].to_numpy()]) for h, c in zip(held, ("mask", "value", "code"))]
            cut = np.flatnonzero((now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1])) + 1
            yield from _searched(now[2], cut)
            held = [x[cut[-1] :] if len(cut) else x for x in now]
        yield from _searched(held[2], np.array([len(held[2])]))

    def _searched(values: np.ndarray, cut: np.ndarray) -> Iterator[pa.RecordBatch]:
        found, start = [], 0
        for stop in cut.tolist():
            if stop - start > 1:
                found.append(bucket_links(values[start:stop].view(np.uint64), distance))
            start = stop
        if found:
            a, b = (np.concatenate(x).view(np.int64) for x in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    placed = keyed.repartition("mask", "value").sortWithinPartitions("mask", "value", gray_rank(F.col("code")))
    return placed.select("mask", "value", "code").mapInArrow(search, "a long, b long")


def _wide_bucket_links(codes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of codes (n, WORDS) that connect just what pairs within distance, over all words, connect.

    Codes within the distance of a leader are its group, the first code of none
    leads the next. Two groups are compared code by code only if neither their
    leaders' distance nor a code's distance to the other leader excludes a pair.
    """
    apart = lambda x, y: np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)
    parent = np.arange(len(codes))
    if len(codes) <= FEW:
        i, j = np.nonzero(np.triu(apart(codes[:, None], codes[None]) <= distance, 1))
        parent = _join(parent, i, j)
    else:
        rest, leaders, groups, radius = parent, [], [], []
        while len(rest):
            d = apart(codes[rest], codes[rest[0]])
            mine = d <= distance
            leaders.append(rest[0])
            groups.append(rest[mine])
            radius.append(d[mine].max())
            rest = rest[~mine]
        lead, radius, root = np.array(leaders), np.array(radius), np.arange(len(leaders))
        for g in np.flatnonzero(radius):
            between = apart(codes[lead], codes[lead[g]])
            for h in np.flatnonzero(between <= distance + radius + radius[g]):
                if root[g] == root[h]:
                    continue
                x = codes[groups[g]]
                x = x[apart(x, codes[lead[h]]) <= distance + radius[h]]
                y = codes[groups[h]]
                y = y[apart(y, codes[lead[g]]) <= distance + radius[g]]
                step = max(1, (1 << 20) // max(1, len(y)))
                if any((apart(x[at : at + step, None], y[None]) <= distance).any() for at in range(0, len(x), step)):
                    root[root == max(root[g], root[h])] = min(root[g], root[h])
        for g, members in enumerate(groups):
            parent[members] = lead[root[g]]
    own = np.flatnonzero(parent != np.arange(len(codes)))
    return own, parent[own]


#: Bytes of a wide fingerprint by which codes are dealt, the first three of each word; for each, pairs of others, one of which must agree too.
DEALT = [at for at in range(8 * WORDS) if at % 8 < 3]
_OTHERS = [at for at in range(8 * WORDS) if at % 8 >= 3]
FINER = np.stack([np.concatenate([np.random.default_rng([11, n, i]).permutation(_OTHERS).reshape(-1, 2) for i in range(3)]) for n in range(len(DEALT))])


def _bands(count: int | None = None) -> list[list[int]]:
    """Hexadecimal digits of each band, a dealt byte and a finer pair; the same for any count, as no link may depend on how many codes there are.

    Two codes meet if they agree in one of these 24 x 60 bands of 24 bits: of
    pairs that differ in 77 bits (15.1 %) 99.96 % do, in 86 (16.8 %) 99.6 %. A
    band's values hold 60 codes each of a thousand million, if spread evenly.
    """
    return [[digit for byte in (dealt, *pair) for digit in (2 * byte, 2 * byte + 1)] for dealt, pairs in zip(DEALT, FINER.tolist()) for pair in pairs]


def _met_links(codes: np.ndarray, band: np.ndarray, bucket: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of codes (n, WORDS) that connect just what pairs of one bucket connect that agree in a finer pair and are within distance.

    bucket numbers the rows' buckets, band tells by which byte each was dealt. Pairs that are connected already are not compared.
    """
    octets, first = np.ascontiguousarray(codes).view(np.uint8).ravel(), np.arange(len(codes)) * (8 * WORDS)
    parent, bucket = np.arange(len(codes)), bucket.astype(np.int64) << 16
    for p, q in FINER.transpose(1, 2, 0):
        value = bucket | octets.take(first + p.take(band)).astype(np.int64) << 8 | octets.take(first + q.take(band))
        order = np.argsort(value)
        value = value[order]
        start = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        size = np.diff(np.append(start, len(value)))
        for at, n in zip(start[size > FEW].tolist(), size[size > FEW].tolist()):
            mine = order[at : at + n]
            if (parent[mine] != parent[mine[0]]).any():
                a, b = _wide_bucket_links(codes[mine], distance)
                parent = _join(parent, mine[a], mine[b])
        few = np.repeat(size <= FEW, size)
        left, step = np.flatnonzero(few), 1
        while len(left := left[left + step < len(value)]) and len(left := left[value[left] == value[left + step]]):
            i, j = order[left], order[left + step]
            apart = parent[i] != parent[j]
            i, j = i[apart], j[apart]
            for at in range(0, len(i), 1 << 16):
                x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                near = np.bitwise_count(codes[x] ^ codes[y]).sum(axis=1, dtype=np.int64) <= distance
                if near.any():
                    parent = _join(parent, x[near], y[near])
            step += 1
    own = np.flatnonzero(parent != np.arange(len(codes)))
    return own, parent[own]


def wide_links(codes: DataFrame, distance: int, most: int = 1 << 16) -> DataFrame:
    """codes (node long, wide binary; distinct) to links (a, b) of nodes within distance bits.

    Codes are compared where they agree in a dealt byte and in one of the finer
    pairs, see _bands(); whether two are linked depends on these two alone, never
    on what else is there. Buckets are dealt by the byte, the finer pairs are
    looked up inside. The codes of a bucket of over `most` are dealt to parts,
    and every two parts meet in a task, so no pair that agrees is lost. Each task
    returns at most one link a code and bucket. Only bits count, no text is read again.
    """
    entry = lambda n, at: F.xxhash64(F.lit(n), F.substring("wide", at + 1, 1))
    keyed = codes.select("node", "wide", F.posexplode(F.array(*[entry(n, at) for n, at in enumerate(DEALT)])).alias("band", "key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > most)
    hot = common.staged(sizes.select("key", F.ceil(F.col("n") / most).cast("int").alias("parts")), "hot-bands")
    if not hot.isEmpty():
        part = F.pmod(F.xxhash64("node", F.lit(2)), F.col("parts")).cast("int")
        other = F.explode(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: x != F.col("part")))
        dealt = keyed.join(F.broadcast(hot), "key").withColumn("part", part).withColumn("other", other)
        dealt = dealt.select("node", "wide", "band", F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("key"))
        keyed = keyed.join(F.broadcast(hot), "key", "left_anti").select("node", "wide", "band", "key").union(dealt)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0  # batches whose last bucket may go on
        for b in batches:
            wide = np.frombuffer(b"".join(b["wide"].to_pylist()), np.uint64).reshape(-1, WORDS)
            held.append((b["key"].to_numpy(), b["node"].to_numpy(), b["band"].to_numpy(), wide))
            rows += b.num_rows
            if held[0][0][0] != held[-1][0][-1] and rows >= 1 << 15:
                now = [np.concatenate(x) for x in zip(*held)]
                cut = np.flatnonzero(now[0][1:] != now[0][:-1])[-1] + 1
                yield from found([x[:cut] for x in now])
                held = [tuple(x[cut:] for x in now)]
                rows -= cut
        if rows:
            yield from found([np.concatenate(x) for x in zip(*held)])

    def found(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        bucket = np.cumsum(np.concatenate([[False], rows[0][1:] != rows[0][:-1]]))
        a, b = _met_links(rows[3], rows[2], bucket, distance)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(rows[1][a]), pa.array(rows[1][b])], names=["a", "b"])

    return keyed.repartition("key").sortWithinPartitions("key").select("key", "node", "band", "wide").mapInArrow(search, "a long, b long")


def _grouped(rows: DataFrame, links: Callable[[DataFrame], DataFrame], *more: str) -> DataFrame:
    """rows (doc_id, key, code, more) with root and component_id; links finds links between classes (code, more)."""
    classes = common.staged(rows.groupBy("code", *more).agg(F.min("doc_id").alias("first")), "classes")
    roots = connected_components(links(classes))
    classes = classes.join(roots, classes["code"] == roots["node"], "left").select("code", "first", F.coalesce("root", "code").alias("root"))
    classes = common.staged(classes, "fingerprint-classes")
    smallest = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(classes.select("code", "root").join(smallest, "root"), "code").select("doc_id", "key", "code", "root", "component_id")


def near_groups(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", shingle: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, key, code, root, component_id), one row a row of docs.

    Texts with one fingerprint are one class, whatever their number; classes
    within `distance` bits are linked, and root is one class for all that links
    connect. component_id is the smallest doc_id there. No words (or null text):
    fingerprint zero. Null ids are passed over in the minimum; repeated rows stay.
    Other columns of docs are not carried along. Texts are read whole; a long one
    is held in one task, at some 100 bytes a word. An empty table gives an empty table.
    """
    rows = common.staged(fingerprints(docs, text=text, doc_id=doc_id, shingle=shingle), "fingerprints")
    return _grouped(rows, lambda classes: near_links(classes.select("code"), distance))


def similar_groups(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, differing: float = 0.168) -> DataFrame:
    """As near_groups, for texts whose shingles are alike by 0.8 or more (Jaccard, of sets), and for those whose wide fingerprints are near.

    Wide fingerprints of two texts differ in acos(c) / pi of their bits, c being
    the cosine of their shingle counts: 15.1 % at similarity 0.8, 17.2 % at 0.75,
    19.2 % at 0.7, with a standard deviation of 1.6 points; `differing` is the
    largest share that links. That finds most pairs of 0.8 or more and some
    below. Those of 0.8 or more that it misses, as their bits differ more or
    share no band, are found by the sets themselves, none excepted: see overlap.
    code is a digest of the wide fingerprint. A long text is held in one task, at
    some 300 bytes a word; else as near_groups.
    """
    hashes = lambda raw: shingle_hashes(raw, shingle)
    raws = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw"))
    raws = raws.select("doc_id", F.md5("raw").alias("key"), "raw")
    prefixes = docs.sparkSession.sparkContext.broadcast(overlap.Prefixes(overlap.hot_shingles(raws, hashes)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.by_partition(batches, 2 << 20):
            own = [hashes(x) for x in b["raw"].to_pylist()]
            sid, n, prefix = zip(*[prefixes.value.of(x) for x in own])
            columns = [b["doc_id"], b["key"], pa.array([wide_majority(x) for x in own], pa.binary()), pa.array(sid, pa.int64()), pa.array(n, pa.int32()), pa.array(prefix, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "wide", "sid", "n", "prefix"])

    rows = raws.mapInArrow(encode, "doc_id long, key string, wide binary, sid long, n int, prefix array<long>")
    rows = common.staged(rows.withColumn("code", F.xxhash64("wide")), "wide-fingerprints")

    def links(classes: DataFrame) -> DataFrame:
        equal = rows.groupBy("sid").agg(F.min("code").alias("a"), F.max("code").alias("b")).select("sid", "a", "b").filter("a < b")
        equal = rows.select("sid", "code").join(equal, "sid").select("a", F.col("code").alias("b")).filter("a < b").distinct()
        near = wide_links(classes.select(F.col("code").alias("node"), "wide"), int(differing * 64 * WORDS))
        near = common.staged(near.union(equal), "near-links")
        return near.union(overlap.missed_links(rows, connected_components(near), raws, hashes))

    return _grouped(rows, links, "wide")


def keep_one(docs: DataFrame, groups: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with one row of each of the groups that near_groups or similar_groups found: that with the smallest doc_id, and of its repeats any."""
    first = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "key", "root")
    first = first.withColumn("n", F.row_number().over(Window.partitionBy("root").orderBy("key"))).filter("n = 1")
    first = first.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__id"), F.col("key").alias("__key"))
    named = docs.withColumns({"__id": F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "__key": F.md5(F.coalesce(F.col(text), F.lit("")))})
    kept = named.join(first, ["__id", "__key"], "left_semi")
    alike = Window.partitionBy("__id", "__key").orderBy(F.lit(0))
    return kept.withColumn("__n", F.row_number().over(alike)).filter("__n = 1").select(*docs.columns)
