"""The prefix trie of conversations: sorted shards finish their own nodes, nodes on the borders of shards are reduced."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worklens.llm import common

#: Hex digits of a turn's digest in a path: 128 bits of its SHA-256.
WIDTH = 32
#: Bytes of a path that a shard holds, about: 16 for each turn, once for each conversation.
SHARD = 16 << 20
#: Characters of conversation ids that one row of a border node's list holds.
PIECE = 1 << 20

_SUMS = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
_NODE = "shard int, open boolean, node binary, parent binary, conv_id bigint, depth bigint, parent_conv_id bigint, " + ", ".join(f"{c} bigint" for c in _SUMS) + ", ends_sha256 string, piece int, ids string"


def conversations(turns: DataFrame, conv_id: Column | str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", together: Column | None = None) -> DataFrame:
    """(conv_id, digests, sizes, together): each conversation's turns in order, as digests of role and text and as code points.

    Turns are ordered by turn, null first; equal ones by role, then by text: the
    first 64 characters, then its digest. Null roles and texts are empty. Rows
    without conv_id belong to no conversation. Rows that repeat are turns of
    their own. Texts stay behind: 16 bytes a turn go through one shuffle, by
    `together` if conversations are to be joined by it afterwards. One
    conversation's digests are one row.
    """
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t), 256), 1, WIDTH))
    conv = F.col(conv_id) if isinstance(conv_id, str) else conv_id
    rows = turns.filter(conv.isNotNull()).select(
        conv.cast("long").alias("conv_id"), (conv if together is None else together).alias("together"),
        F.struct(F.col(turn).alias("turn"), r.alias("role"), F.substring(t, 1, 64).alias("head"), digest.alias("digest"), F.length(t).alias("size")).alias("x"),
    )
    rows = rows.repartition("together").groupBy("together", "conv_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return rows.select("conv_id", F.transform("x", lambda x: x["digest"]).alias("digests"), F.transform("x", lambda x: x["size"]).alias("sizes"), "together")


def with_heads(convs: DataFrame, first: Column, most: int) -> DataFrame:
    """conversations() whose first turns, `first` of them and `most` at most, are those of the conversation that `together` names.

    A conversation that isn't there has no turns to give; one that has fewer gives all.
    """
    heads = convs.filter(F.col("conv_id") == F.col("together")).select("together", F.slice("digests", 1, most).alias("d"), F.slice("sizes", 1, most).alias("s"))
    joined = convs.join(heads, "together", "left").withColumn("first", first)
    put = lambda head, own: F.concat(F.slice(F.coalesce(head, F.array().cast(joined.schema[own].dataType)), F.lit(1), F.col("first")), F.slice(own, F.col("first") + 1, F.size(own))).alias(own)
    return joined.select("conv_id", put(F.col("d"), "digests"), put(F.col("s"), "sizes"))


class _Frame:
    """A node whose members are just being read."""

    __slots__ = ("children", "conv", "depth", "enters", "hash", "ids", "kids", "leaves", "n", "pieces", "saved", "shares", "size", "waiting")

    def __init__(self, depth: int, size: int, hashed, enters: bool):
        self.depth, self.size, self.hash, self.enters = depth, size, hashed, enters
        self.shares = enters  # goes on in another shard
        self.conv, self.n, self.children, self.leaves, self.saved, self.kids = None, 0, 0, 0, 0, False
        self.ids: list[int] = []
        self.pieces: list[str] = []
        self.waiting: list[tuple] = []  # finished children, till the smallest member is known


def _shard_nodes(rows: Iterator[tuple], shard: int, left: int, right: int) -> Iterator[tuple]:
    """The nodes of one shard. rows: (path, sizes, conv_id) in order; left, right: up to which depth the first and the last path go on beyond the shard.

    A node that goes on is open: its row holds what this shard adds. Sums add up
    over shards, as a node's own share of them (its saving less one copy, its
    being a child) counts where it begins, and its being a leaf where it ends.
    Members that end at a node come before those that go further, in order of
    conv_id.
    """
    stack: list[_Frame] = []
    path = b""

    def close(frame: _Frame, parent: _Frame | None, shares: bool) -> Iterator[tuple]:
        frame.shares |= shares
        frame.saved += frame.n * frame.size - (0 if frame.enters else frame.size)
        if not frame.kids and not shares:
            frame.leaves += 1
        key = frame.hash.digest()[:16]
        for x in frame.waiting:
            yield (*x[:3], key if frame.shares else None, *x[4:6], None if frame.shares else frame.conv, *x[7:])
        sums = (frame.n, frame.children, frame.leaves, frame.saved)
        if frame.shares:
            parts = [*frame.pieces, ",".join(map(str, frame.ids))] if frame.ids else frame.pieces
            above = parent.hash.digest()[:16] if parent else None
            yield (shard, True, key, above, frame.conv, frame.depth, None, *sums, None, 0, parts[0] if parts else None)
            for i, ids in enumerate(parts[1:], 1):
                yield (shard, True, key, above, None, frame.depth, None, 0, 0, 0, 0, None, i, ids)
            done = None
        else:
            ends = hashlib.sha256()
            for i, ids in enumerate([*frame.pieces, ",".join(map(str, frame.ids))] if frame.ids else frame.pieces):
                ends.update(("," * bool(i) + ids).encode())
            done = (shard, False, key, None, frame.conv, frame.depth, None, *sums, ends.hexdigest(), 0, None)
        if parent is None:
            if done:
                yield done
            return
        if done:
            parent.waiting.append(done)
        parent.children += not frame.enters
        parent.kids = True
        parent.leaves += frame.leaves
        parent.saved += frame.saved
        parent.n += frame.n
        parent.conv = frame.conv if parent.conv is None else min(parent.conv, frame.conv)

    for here, sizes, conv in rows:
        depth, first = len(here) // 16, not stack
        if first:
            stack.append(_Frame(0, 0, hashlib.sha256(b"root"), left >= 0))
        common_depth, most = 0, min(depth, len(stack) - 1)
        while common_depth < most and here[16 * common_depth : 16 * common_depth + 16] == path[16 * common_depth : 16 * common_depth + 16]:
            common_depth += 1
        while len(stack) > common_depth + 1:
            top = stack.pop()
            yield from close(top, stack[-1], False)
        for d in range(common_depth, depth):
            hashed = stack[-1].hash.copy()
            hashed.update(here[16 * d : 16 * d + 16])
            stack.append(_Frame(d + 1, sizes[d], hashed, first and d + 1 <= left))
        end = stack[-1]
        end.n += 1
        end.conv = conv if end.conv is None else min(end.conv, conv)
        end.ids.append(conv)
        if len(end.ids) >= PIECE // 20:
            end.pieces.append(",".join(map(str, end.ids)))
            end.ids = []
        path = here
    while stack:
        top = stack.pop()
        yield from close(top, stack[-1] if stack else None, top.depth <= right)


_ARROW = pa.schema([
    ("shard", pa.int32()), ("open", pa.bool_()), ("node", pa.binary()), ("parent", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()),
    *[(c, pa.int64()) for c in _SUMS], ("ends_sha256", pa.string()), ("piece", pa.int32()), ("ids", pa.string()),
])


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 20_000) -> Iterator[pa.RecordBatch]:
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += len(row[-1] or "")
        if len(held) >= most or chars >= 8 * PIECE:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types, strict=True)], schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types, strict=True)], schema=schema)


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for piece in common.by_partition(iter([b])):
            yield from zip(*[c.to_pylist() for c in piece.columns], strict=True)


def _nodes(borders: dict[int, tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def every() -> Iterator[tuple]:
            rows = _rows_of(batches)
            row = next(rows, None)
            while row is not None:
                shard = row[0]

                def mine(first: tuple, number: int) -> Iterator[tuple]:
                    nonlocal row
                    row = first
                    while row is not None and row[0] == number:
                        yield row[1:]
                        row = next(rows, None)

                yield from _shard_nodes(mine(row, shard), shard, *borders[shard])

        return _batches(every(), _ARROW)

    return run


def _common_depth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, depth): how many turns the first path of a shard and the last one of the shard before have in common; the root counts too."""
    for b in batches:
        out = []
        for a, c in zip(b.column("before").to_pylist(), b.column("first").to_pylist(), strict=True):
            n, most = 0, -1 if a is None else min(len(a), len(c)) // 16
            while n < most and a[16 * n : 16 * n + 16] == c[16 * n : 16 * n + 16]:
                n += 1
            out.append(n if a is not None else -1)
        yield pa.RecordBatch.from_arrays([b.column("shard"), pa.array(out, pa.int32())], names=["shard", "depth"])


def _joined_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, ends_sha256) from (node, shard, piece, ids) in order; a list passes through piece by piece."""

    def digests() -> Iterator[tuple]:
        node, hashed, some = None, None, False
        for n, _, _, ids in _rows_of(batches):
            if n != node:
                if node is not None:
                    yield node, hashed.hexdigest()
                node, hashed, some = n, hashlib.sha256(), False
            if ids is not None:
                hashed.update(("," * some + ids).encode())
                some = True
        if node is not None:
            yield node, hashed.hexdigest()

    return _batches(digests(), pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())]))


def prefix_trie(convs: DataFrame) -> DataFrame:
    """The nodes of the trie of (conv_id, digests, sizes): each distinct sequence of first turns, from the empty one on.

    conv_id is the smallest member (a conversation that begins with the node's
    turns), parent_conv_id that of the node one turn shorter (root: null),
    n_leaves the nodes without children in the subtree, saved_tokens what the
    subtree's texts would cost again without sharing, ends_sha256 the digest of
    the members that end here. Nodes are told apart by 128-bit digests. Without
    conversations there is no node, not even a root.

    Conversations are sorted by path and cut in shards by ranges of (path,
    conv_id), so that copies of one conversation spread like others. What the
    splitters' paths share with both sides is the skeleton: shards get its depth
    at their two borders (two numbers for each shard, broadcast) and finish
    every other node by one pass with a stack. Of skeleton nodes each shard has
    a part; these are summed up by node, at most one row for each shard and
    shared turn. The list of a skeleton node's members comes in pieces in order
    and runs through its digest one by one, as SHA-256 needs them in one row.
    """
    path = F.unhex(F.array_join(F.transform("digests", F.hex), "")).alias("path")
    rows = common.staged(convs.select(path, F.col("sizes"), "conv_id"), "trie-paths")
    held = rows.agg(F.coalesce(F.sum(F.octet_length("path") + 16), F.lit(0))).first()[0]
    shards = max(8, -(-held // SHARD))
    dealt = rows.repartitionByRange(shards, "path", "conv_id").select(F.spark_partition_id().alias("shard"), "path", "sizes", "conv_id")
    dealt = common.staged(dealt, "trie-shards")
    ends = dealt.groupBy("shard").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    ends = ends.withColumn("before", F.lag("last").over(Window.orderBy("shard"))).select("shard", "before", "first")
    depths = sorted((r.shard, r.depth) for r in ends.mapInArrow(_common_depth, "shard int, depth int").collect())
    after = [d for _, d in depths[1:]] + [-1] * bool(depths)
    borders = {shard: (left, right) for (shard, left), right in zip(depths, after, strict=True)}
    nodes = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "path", "conv_id").mapInArrow(_nodes(borders), _NODE)
    nodes = common.staged(nodes, "trie-nodes")
    parts = nodes.filter("open")
    lists = parts.select("node", "shard", "piece", "ids").repartition(shards, "node").sortWithinPartitions("node", "shard", "piece").mapInArrow(_joined_digest, "node binary, ends_sha256 string")
    reduced = parts.groupBy("node").agg(F.first("parent", ignorenulls=True).alias("parent"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), *[F.sum(c).alias(c) for c in _SUMS])
    skeleton = common.staged(reduced.join(lists, "node"), "trie-skeleton")
    above = skeleton.select(F.col("node").alias("parent"), F.col("conv_id").alias("above"), F.col("n_children").alias("n"))
    done = nodes.filter(~F.col("open")).select("node", "parent", "conv_id", "depth", "parent_conv_id", *_SUMS, "ends_sha256")
    orphans = done.filter("parent IS NOT NULL").union(skeleton.filter("parent IS NOT NULL").select("node", "parent", "conv_id", "depth", F.lit(None).cast("long"), *_SUMS, "ends_sha256"))
    placed = common.spread_join(orphans, above, ["parent"], held // 16).withColumn("parent_conv_id", F.col("above"))
    out = ["conv_id", "depth", "parent_conv_id", *_SUMS, "ends_sha256"]
    rest = done.filter("parent IS NULL").select(*out).union(skeleton.filter("parent IS NULL").select("conv_id", "depth", F.lit(None).cast("long"), *_SUMS, "ends_sha256"))
    return placed.select(*out).union(rest)
