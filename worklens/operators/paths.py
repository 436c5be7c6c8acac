"""Path rules: globs, domains and their overlaps. Components are compared without regard to case."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worklens.sources.shared import kept


def component_regex(glob: str) -> str:
    """One path component's glob as a regular expression: `*`, `?` and classes, `!` or `^` for negation."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        found = re.match(r"\[([!^]?)(\]?[^\]]*)\]", glob[i:]) if c == "[" else None
        if found and found[2]:
            inside = re.sub(r"([\\\[\]^&~|])", r"\\\1", found[2])
            out.append(f"[{'^' if found[1] else ''}{inside}]")
            i += found.end()
            continue
        out.append({"*": "[^/]*", "?": "[^/]"}.get(c) or re.escape(c))
        i += 1
    return "".join(out)


def glob_regex(glob: str) -> str:
    """A whole path's pattern; `**` spans components, and a bare name matches any component."""
    glob = glob.lower()
    if "/" not in glob and glob != "**":
        return f"^(?:.*/)?{component_regex(glob)}(?:/.*)?$"
    parts = glob.split("/")
    out = "^"
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            out += ".*" if last else "(?:[^/]+/)*"
        else:
            out += component_regex(part) + ("" if last else "/")
    return out + "$"


def forbidden(paths: DataFrame, globs: list[str]) -> DataFrame:
    """(…, glob) for every pattern that a path matches; patterns are configuration and become columns, not a join."""
    hits = F.array_compact(F.array(*[F.when(F.lower("path").rlike(glob_regex(g)), F.lit(g)) for g in globs]))
    return paths.select("*", F.explode(hits).alias("glob"))


@F.pandas_udf(T.StringType())
def _fits(parts: pd.Series) -> pd.Series:
    return parts.map(lambda p: f"^{component_regex(p)}$")


def forbidden_by(paths: DataFrame, patterns: DataFrame) -> DataFrame:
    """(path, glob) for each of patterns (glob) that a path matches, both tables, by a trie of the patterns' components.

    A node of the trie is the beginning of some patterns, up to a component. In
    each round every path takes its next component from where it stands: to the
    child of that name, by an equi join, to children whose wildcards fit, of which
    it meets those whose letters before the first wildcard it begins with, and,
    standing behind a **, it may also stay. Before a ** it stands behind it as
    well. So a path only meets the edges of its nodes, not all patterns. As many
    rounds as the longest path has components. A ** at the end takes one
    component at least; a bare name matches any component.
    """
    low = F.lower("glob")
    bare = ~low.contains("/") & (low != "**")
    span = F.lit("**")
    ways = F.when(bare, F.array(F.array(span, low), F.array(span, low, span))).otherwise(F.array(F.split(low, "/")))
    rows = patterns.select("glob", F.explode(ways).alias("parts")).distinct()
    once = F.filter("parts", lambda p, i: (p != "**") | (i == 0) | (F.get("parts", i - 1) != "**"))  # ** and ** are one
    rows = rows.select("glob", once.alias("parts"))
    upto = lambda n: F.array_join(F.slice("parts", F.lit(1), n), "/")
    edges = kept(rows.select(F.posexplode("parts").alias("at", "part"), "parts").select(upto(F.col("at")).alias("node"), "part", upto(F.col("at") + 1).alias("child")).distinct())
    ends = kept(rows.select(F.array_join("parts", "/").alias("node"), "glob"))
    spans, wild = edges.filter("part = '**'").select("node", "child"), F.col("part").rlike(r"[*?\[]")
    names = edges.filter((F.col("part") != "**") & ~wild)
    globs = kept(edges.filter((F.col("part") != "**") & wild).select("node", "child", F.regexp_extract("part", r"^[^*?\[]*", 0).alias("start"), _fits("part").alias("pattern")))
    starts = F.explode(F.transform(F.sequence(F.lit(0), F.length("part")), lambda n: F.substring("part", F.lit(1), n)))
    before_span = lambda at: at.union(at.join(spans, "node").select("path", "parts", F.col("child").alias("node")))
    at = before_span(paths.select("path", F.split(F.lower("path"), "/").alias("parts"), F.lit("").alias("node")).distinct())
    found = []
    for i in range(paths.agg(F.max(F.size(F.split("path", "/")))).first()[0] or 0):
        here = at.filter(F.size("parts") > i).withColumn("part", F.get("parts", F.lit(i)))
        named = here.join(names, ["node", "part"]).select("path", "parts", F.col("child").alias("node"))
        open_ = here.join(globs.select("node").distinct(), "node", "left_semi")
        fitting = open_.withColumn("start", starts).join(globs, ["node", "start"]).filter(F.expr("part RLIKE pattern")).select("path", "parts", F.col("child").alias("node"))
        stays = here.filter((F.col("node") == "**") | F.col("node").endswith("/**")).select("path", "parts", "node")
        moved = kept(named.union(fitting).union(stays).distinct())
        found.append(moved.filter(F.size("parts") == i + 1).join(ends, "node").select("path", "glob"))
        at = before_span(moved).distinct()
    out = paths.select("path", F.lit("").alias("glob")).limit(0)
    for f in found:
        out = out.union(f)
    return out.distinct()


def prefixes(path: Column) -> Column:
    """All leading runs of components of a path, the whole one last."""
    parts = F.split(F.lower(path), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def overlaps(domains: DataFrame) -> DataFrame:
    """(inner, outer) for distinct domains of which one leads the other; equal ones are one domain."""
    distinct = domains.select(F.lower("path").alias("path")).distinct()
    leads = distinct.select(F.col("path").alias("inner"), F.explode(prefixes(F.col("path"))).alias("outer")).filter("inner <> outer")
    return leads.join(distinct.select(F.col("path").alias("outer")), "outer", "left_semi").select("inner", "outer")


def touching(paths: DataFrame, domains: DataFrame) -> DataFrame:
    """Distinct lower-case paths that overlap a domain in either direction."""
    own = paths.select(F.lower("path").alias("p")).distinct()
    given = domains.select(F.lower("path").alias("d")).distinct()
    inside = own.select("p", F.explode(prefixes(F.col("p"))).alias("d")).join(given, "d", "left_semi").select("p")
    around = given.select(F.explode(prefixes(F.col("d"))).alias("p")).join(own, "p", "left_semi")
    return inside.union(around.select("p")).distinct()


def outside(paths: DataFrame, allowed: DataFrame, protected: DataFrame) -> DataFrame:
    """Paths with the reason they may not change: protected ones first, then those that overlap no allowed domain."""
    flag = lambda domains, name: touching(paths, domains).select("p", F.lit(True).alias(name))
    out = paths.withColumn("p", F.lower("path")).join(flag(protected, "is_protected"), "p", "left").join(flag(allowed, "is_allowed"), "p", "left")
    reason = F.when(F.col("is_protected"), "protected").when(F.col("is_allowed").isNull(), "outside")
    return out.select(*paths.columns, reason.alias("reason")).filter("reason IS NOT NULL")
