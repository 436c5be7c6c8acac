"""Views that should agree: where a rebuilt one first differs from the live one, and what becomes of a finished lease."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ENTRIES = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("at", "path", "value", "parent")]))


def _entries(node: object, at: str, path: str, parent: str | None, hidden: re.Pattern | None) -> Iterator[tuple]:
    """A nested value as entries in order: each container before what it holds, members by name, elements by number."""
    if hidden and hidden.fullmatch(path):
        return
    kind = "object" if isinstance(node, dict) else "array" if isinstance(node, list) else json.dumps(node, sort_keys=True, ensure_ascii=False)
    yield at, path or "/", kind, parent
    if isinstance(node, dict):
        for name in sorted(node):
            segment = name.replace("~", "~0").replace("/", "~1")
            yield from _entries(node[name], f"{at}\0{name}", f"{path}/{segment}", None, hidden)
    elif isinstance(node, list):
        for i, element in enumerate(node):
            yield from _entries(element, f"{at}\0{i:010d}", f"{path}/{i}", path, hidden)


def first_differences(rebuilt: DataFrame, live: DataFrame, key: str, volatile: tuple[str, ...] = ()) -> DataFrame:
    """(key, path, rebuilt, live) for each view (key, view as JSON) that differs: the first path where it does, and what is there.

    Records are flattened to entries, joined by key and path, and the least
    differing one stands. Members come by name, elements by number. volatile
    paths (with * for one segment) don't count. A missing or additional member is
    named itself; arrays of other lengths that agree as far as both go differ in
    /length. A key that only one side has differs in /. Entries of a view spread
    by their path; none is brought together.
    """
    hidden = re.compile("|".join("[^/]*".join(map(re.escape, v.split("*"))) for v in volatile)) if volatile else None

    @F.pandas_udf(_ENTRIES)
    def flat(views: pd.Series) -> pd.Series:
        return views.map(lambda v: [] if v is None else [dict(zip(("at", "path", "value", "parent"), e, strict=True)) for e in _entries(json.loads(v), "", "", None, hidden)])

    side = lambda df, name: df.select(F.col(key).alias("__key"), F.explode(flat("view")).alias("e")).select("__key", F.col("e.at").alias("__at"), F.struct("e.path", "e.value", "e.parent").alias(name))
    both = side(rebuilt, "a").join(side(live, "b"), ["__key", "__at"], "full_outer").filter(~F.col("a.value").eqNullSafe(F.col("b.value")))
    first = both.groupBy("__key").agg(F.min_by(F.struct("a", "b"), "__at").alias("x"))
    a, b = F.col("x.a"), F.col("x.b")
    parent = F.coalesce(a["parent"], b["parent"])
    short = (a.isNull() | b.isNull()) & parent.isNotNull()
    path = F.when(short, F.concat(parent, F.lit("/length"))).otherwise(F.coalesce(a["path"], b["path"]))
    return first.select(F.col("__key").alias(key), path.alias("path"), F.when(~short, a["value"]).alias("rebuilt"), F.when(~short, b["value"]).alias("live"))


def lease_outcomes(leases: DataFrame, tasks: DataFrame, refs: DataFrame, prefix: str) -> DataFrame:
    """(campaign, outcome, reason, outstanding, proof): whether a campaign's lease lapses, or why it is to be renewed.

    leases (campaign, live_nodes, published_head), tasks (campaign, place, task,
    checkpoint), refs (campaign, reference, target). In this order: nodes still
    run; tasks without a completion (a merge's reference is the task, with 16
    hexadecimal digits after a hyphen or without; a checkpoint's is the task, 64
    of them, a slash and an object id); no checkpoint is declared; the
    published head is no object id; the last checkpoint has not proved that head.
    """
    of = lambda kind: F.regexp_extract("reference", f"^{re.escape(prefix)}/{kind}/(.+)$", 1)
    oid = "(?:[0-9a-f]{40}|[0-9a-f]{64})"
    named = refs.select("campaign", "reference", "target", of("merge").alias("merge"), of("checkpoint").alias("proof"))
    bare = F.regexp_replace("merge", "-[0-9a-f]{16}$", "")
    merged = named.filter("merge <> ''").select("campaign", F.explode(F.array_distinct(F.array("merge", bare))).alias("task")).distinct().withColumn("merged", F.lit(True))
    proofs = named.select("campaign", "reference", "target", F.regexp_extract("proof", f"^(.+)-[0-9a-f]{{64}}/{oid}$", 1).alias("task"), F.regexp_extract("proof", f"/({oid})$", 1).alias("revision")).filter("task <> ''")
    proved = proofs.select("campaign", "task").distinct().withColumn("proved", F.lit(True))
    state = tasks.join(merged, ["campaign", "task"], "left").join(proved, ["campaign", "task"], "left")
    done = F.coalesce(F.when(F.col("checkpoint"), F.col("proved")).otherwise(F.col("merged")), F.lit(False))
    by = state.groupBy("campaign").agg(F.count_if(~done).alias("outstanding"), F.max_by(F.when(F.col("checkpoint"), F.col("task")), F.when(F.col("checkpoint"), F.col("place"))).alias("gate"))
    proof = proofs.filter("target = revision").select("campaign", F.col("task").alias("gate"), F.col("target").alias("published_head"), "reference")
    proof = proof.groupBy("campaign", "gate", "published_head").agg(F.min("reference").alias("reference"))
    rows = leases.join(by, "campaign", "left").join(proof, ["campaign", "gate", "published_head"], "left")
    reason = (
        F.when(F.col("live_nodes") > 0, "running").when(F.col("outstanding") > 0, "outstanding").when(F.col("gate").isNull(), "no-gate")
        .when(~F.coalesce(F.col("published_head").rlike(f"^{oid}$"), F.lit(False)), "no-head").when(F.col("reference").isNull(), "not-proved").otherwise("proved")
    )
    return rows.select("campaign", F.when(reason == "proved", "lapse").otherwise("renew").alias("outcome"), reason.alias("reason"), F.coalesce("outstanding", F.lit(0)).alias("outstanding"), F.when(reason == "proved", F.col("reference")).alias("proof"))
