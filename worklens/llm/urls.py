"""URL filters: rules by host and path, and for the rest trust and distrust that flow over the links between hosts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklens.llm import common

#: Share of a host's mass that moves on over its links in a round; the rest comes from its own pages.
DAMPING = 0.85
#: Rounds end when less than this share of all mass changes place.
TOLERANCE = 1e-4
#: A host is blocked if the pages' worth of distrust that it holds is more than this share of its pages, and more than its trust.
THRESHOLD = 0.5
#: Rounds between two looks at how much moves.
EVERY = 4
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """What stands after the first :// up to /, ? or #, with A-Z in lower case; empty for null or without ://."""
    return common.ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What stands between host and ? or #; empty for null or without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def apply_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages (host, path, ..) with rule and ruled: the longest rule that fits and its verdict, null where none does.

    rules (host, path, verdict): a rule fits its host and all subdomains if the
    path starts with the rule's; of equally long ones the smallest in order.
    Rules of one host are one array. A page asks for its host's last label, last
    two, and so on up to as many as any rule has; each is an equi join with the
    rules, which Spark broadcasts if they are small, so a long host costs no more
    and pages need no shuffle. Columns __rules and __best are taken.
    """
    deepest = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 0
    whole = F.concat("host", "path")
    by_host = rules.groupBy(F.col("host").alias("__host")).agg(F.sort_array(F.collect_set(F.struct((-F.length(whole)).alias("shorter"), whole.alias("rule"), "path", "verdict"))).alias("__rules"))
    best, out = F.lit(None).cast("struct<shorter:int,rule:string,verdict:string>"), pages
    out = out.withColumn("__best", best)
    for labels in range(1, deepest + 1):
        out = out.join(by_host, F.substring_index(F.col("host"), ".", -labels) == F.col("__host"), "left")
        first = F.get(F.filter("__rules", lambda r: F.col("path").startswith(r["path"])), F.lit(0))
        found = F.when(first.isNotNull(), F.struct(first["shorter"].alias("shorter"), first["rule"].alias("rule"), first["verdict"].alias("verdict")))
        out = out.withColumn("__best", F.least("__best", found)).drop("__rules", "__host")
    return out.withColumns({"rule": F.col("__best.rule"), "ruled": F.col("__best.verdict")}).drop("__best")


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, pages): how many pages of a host link to another, or to their own.

    Links are those of <a href> in html. A link with :// or that begins with //
    leads to its host, one with another scheme (mailto:) nowhere, any other to
    the page's own host. However often a page links to a host, it counts once.
    """
    target = lambda link: (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), host_of(link)).when(link.startswith("//"), host_of(F.concat(F.lit("x:"), link)))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit("")).otherwise(F.col("host"))
    )
    links = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), 1), target))
    ends = pages.filter("host <> ''").select(F.col("host").alias("src"), F.explode(links).alias("dst"))
    return ends.filter("dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("pages"))


def _flows(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(kind, at, to, share): where the mass of a host goes. Trust follows links, distrust goes back to those that link.

    What leaves a host adds up to 1; a host without such links keeps its mass.
    """
    both = links.select(F.lit("trust").alias("kind"), F.col("src").alias("at"), F.col("dst").alias("to"), "pages")
    both = common.staged(both.union(links.select(F.lit("distrust"), "dst", "src", "pages")), "host-links")
    sums = both.groupBy("kind", "at").agg(F.sum("pages").alias("all"), F.count("*").alias("n"))
    shared = common.spread_join(both, sums, ["kind", "at"], both.count())
    shared = shared.select("kind", "at", "to", (F.col("pages") / F.col("all")).alias("share"), "n")
    kinds = nodes.select(F.explode(F.array(F.lit("trust"), F.lit("distrust"))).alias("kind"), F.col("host").alias("at"))
    alone = kinds.join(sums, ["kind", "at"], "left_anti").select("kind", "at", F.col("at").alias("to"), F.lit(1.0).alias("share"), F.lit(1).cast("long").alias("n"))
    return shared.union(alone)


def propagate(nodes: DataFrame, links: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) from nodes (host, trusted, blocked) and links (src, dst, pages).

    Personalised PageRank: trust starts from trusted pages and follows links,
    distrust starts from blocked pages and goes against them. Masses are counted
    in pages and neither grow nor fade, so they can be compared with the pages of
    a host. Both kinds go through one join and one sum a round; hosts with very
    many links meet their scores by broadcast of a bounded number of rows.
    Rounds end when less than tolerance of all mass moves, which takes no more of
    them than the logarithm of tolerance to the base of damping.
    """
    everyone = nodes.select("host").union(links.select("src")).union(links.select("dst")).distinct()
    flows = common.staged(_flows(everyone, links), "host-flows")
    degrees = common.staged(flows.groupBy("kind", "at").agg(F.first("n").alias("n")), "host-degrees")
    seeds = nodes.select(F.explode(F.array(F.struct(F.lit("trust").alias("kind"), F.col("trusted").cast("double").alias("mass")), F.struct(F.lit("distrust").alias("kind"), F.col("blocked").cast("double").alias("mass")))).alias("x"), "host")
    seeds = common.staged(seeds.select("x.kind", F.col("host").alias("at"), "x.mass").filter("mass > 0"), "host-seeds")
    total, edges = seeds.agg(F.sum("mass")).first()[0] or 0.0, flows.count()
    scores, most = seeds, math.ceil(math.log(tolerance) / math.log(damping))
    for done in range(1, most + 1 if total else 1):
        moved = common.spread_join(flows.drop("n"), scores.join(degrees, ["kind", "at"]), ["kind", "at"], edges)
        arrived = moved.select("kind", F.col("to").alias("at"), (F.col("mass") * F.col("share") * damping).alias("mass"))
        last, scores = scores, arrived.union(seeds.select("kind", "at", F.col("mass") * (1 - damping))).groupBy("kind", "at").agg(F.sum("mass").alias("mass"))
        scores = common.staged(scores, "host-scores")
        if done % EVERY == 1:
            change = scores.union(last.select("kind", "at", -F.col("mass"))).groupBy("kind", "at").agg(F.abs(F.sum("mass")).alias("moved")).agg(F.sum("moved")).first()[0]
            if change <= tolerance * total:
                break
        if done > 1:
            common.discard(last)
    pick = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("mass"))), F.lit(0.0)).alias(kind)
    return scores.groupBy(F.col("at").alias("host")).agg(pick("trust"), pick("distrust"))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", html: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """pages with host, path, rule, verdict (allow or block), trust and distrust.

    The verdict is that of the longest rule that fits. Without one it is that of
    the host: block if its distrust, in pages, is more than `threshold` of its
    pages and more than its trust; scores are compared at six decimals, so that
    the order of sums decides nothing. Pages that rules allow or block are the
    seeds of their hosts.

    A null url, or one without ://, has no host: no rule fits it, and it is
    allowed, as nothing speaks against it. Null html has no links. Repeated rows
    count as often as they stand. Without pages there are no rows, without rules
    nothing is blocked. Columns of pages that are named like new ones are replaced.
    """
    new = ["host", "path", "rule", "verdict", "trust", "distrust", "ruled"]
    kept = [c for c in pages.columns if c not in new]
    own = {c: f"__own_{i}" for i, c in enumerate(kept)}  # whatever they are named; those that nobody asks for are pruned
    rows = pages.select(*[F.col(c).alias(name) for c, name in own.items()], host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.col(html).alias("html"))
    ruled = apply_rules(rows.drop("html"), rules)
    hosts = ruled.filter("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("ruled") == "allow").alias("trusted"), F.count_if(F.col("ruled") == "block").alias("blocked"))
    hosts = common.staged(hosts, "hosts")
    links = common.staged(host_links(rows.select("host", "html")), "links")
    scores = propagate(hosts.select("host", "trusted", "blocked"), links)
    scored = hosts.join(scores, "host", "left").select("host", "n", *[F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in ("trust", "distrust")])
    bad = (F.col("distrust") > F.col("n") * threshold) & (F.col("distrust") > F.col("trust"))
    scored = common.staged(scored.withColumn("verdict", F.when(bad, "block").otherwise("allow")), "host-verdicts")
    total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    mine = common.spread_join(ruled.filter("host <> ''"), scored, ["host"], total)
    nowhere = ruled.filter("host = ''").withColumns({"verdict": F.lit("allow"), "trust": F.lit(0.0), "distrust": F.lit(0.0)})
    out = mine.drop("n").unionByName(nowhere)
    return out.select(*[F.col(name).alias(c) for c, name in own.items()], "host", "path", "rule", F.coalesce("ruled", "verdict").alias("verdict"), "trust", "distrust")
