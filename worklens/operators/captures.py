"""Declared captures: what an adapter's output says of session, model, final message and usage, by patterns from a table."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worklens.functions import json_paths
from worklens.functions import predicates as P

#: The logical usage fields, and where a usage capture without a field map has them.
USAGE_FIELDS = ["cacheReadTokens", "cacheWriteTokens", "costUsd", "inputTokens", "inputTokensWithCacheRead", "outputTokens", "reasoningTokens", "totalTokens"]
DEFAULT_PATHS = {"inputTokens": ["input_tokens"], "outputTokens": ["output_tokens"], "totalTokens": ["total_tokens"]}
USAGE = "usage"
#: Captures that must be texts.
TEXTS = ["sessionRef", "model", "finalMessage"]
#: Declarations are configuration; a table of more captures than this is something else.
MOST = 1000

LANE = ["task", "attempt", "lease_epoch", "adapter"]
COUNTS = {"cacheReadTokens": "cache_read_tokens", "cacheWriteTokens": "cache_write_tokens", "outputTokens": "output_tokens", "reasoningTokens": "reasoning_tokens"}


@dataclass(frozen=True)
class Capture:
    """One declared capture: of an adapter's stream, by a pattern in a mode (regex, jsonPath, jsonPathLast), with paths of fields within it."""

    adapter: str
    name: str
    pattern: str
    stream: str = "stdout"
    mode: str = "jsonPath"
    fields: dict[str, list[str]] = field(default_factory=dict)

    def paths(self, logical: str) -> list[str]:
        given = self.fields or (DEFAULT_PATHS if self.name == USAGE else {})
        return given.get(logical, [])


def declarations(table: DataFrame) -> list[Capture]:
    """The captures of a table (adapter, name, pattern, stream, mode, fields map<string, array<string>>), in order; bad patterns raise ValueError."""
    rows = table.limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} captures are declared")
    out = sorted((Capture(r.adapter, r.name, r.pattern, r.stream, r.mode, {k: list(v) for k, v in (r.fields or {}).items()}) for r in rows), key=lambda c: (c.adapter, c.name))
    for c in out:
        if c.mode not in ("regex", "jsonPath", "jsonPathLast") or c.stream not in ("stdout", "stderr") or not c.pattern or "\0" in c.pattern:
            raise ValueError(f"not a capture: {c}")
        if c.mode != "regex":
            json_paths.steps(c.pattern)
    return out


def declared_fields(captures: list[Capture]) -> dict[str, list[str]]:
    """For each adapter the usage fields that its captures promise, in order; a usage capture without a map promises the default three.

    An input that includes cache reads needs these as well, or it could not be
    told from a plain one: ValueError.
    """
    out = defaultdict(set)
    for c in captures:
        out[c.adapter] |= {f for f in (c.fields or (DEFAULT_PATHS if c.name == USAGE else {})) if f in USAGE_FIELDS}
    for adapter, fields in out.items():
        if "inputTokensWithCacheRead" in fields and "cacheReadTokens" not in fields:
            raise ValueError(f"{adapter}: inputTokensWithCacheRead needs cacheReadTokens")
    return {a: sorted(f) for a, f in out.items()}


def scrape(outputs: DataFrame, captures: list[Capture]) -> DataFrame:
    """(task, attempt, lease_epoch, adapter, captures map<string, string>, fault) from outputs (.., stream, body).

    Values are JSON texts; of several matches the last counts. Paths are looked
    up line by line, each by itself (of a path over all lines as one array, its
    first step picks lines), and the last is found by an aggregate; so the lines
    of an output spread like any rows. Regular expressions see the whole body,
    with ^ and $ at its lines; the first group counts if there is one. A line
    that isn't JSON makes the output faulty (`malformed`), save a last one cut
    off after others; so does a session, model or final message that isn't text
    (`not-text`). A faulty output has no captures. Null bodies are empty.
    """
    by_stream = defaultdict(list)
    for c in captures:
        if c.mode != "regex":
            by_stream[c.adapter, c.stream].append((c.name, c.pattern, c.mode == "jsonPathLast"))

    @F.pandas_udf(T.StringType())
    def hits(adapters: pd.Series, streams: pd.Series, positions: pd.Series, lines: pd.Series) -> pd.Series:
        read = {k: [(name, json_paths.steps(p), whole) for name, p, whole in v] for k, v in by_stream.items()}
        return json_paths.hits(read, adapters, streams, positions, lines)

    wanted = F.concat_ws("\n", "adapter", "stream").isin([f"{a}\n{s}" for a, s in by_stream])
    lines = outputs.filter(wanted).select(*LANE, "stream", F.filter(F.split("body", "\n"), lambda x: F.trim(x) != "").alias("lines"))
    lines = lines.select(*LANE, "stream", F.posexplode("lines").alias("at", "raw"))
    found = lines.withColumn("hits", F.from_json(hits("adapter", "stream", "at", "raw"), "map<string,string>"))
    bad = found.groupBy(*LANE, "stream").agg(F.min(F.when(F.col("hits").isNull(), F.col("at"))).alias("bad"), F.max("at").alias("last"))
    bad = bad.filter((F.col("bad") < F.col("last")) | ((F.col("bad") == F.col("last")) & (F.col("last") == 0))).select(*LANE).distinct().withColumn("malformed", F.lit(True))
    values = found.select(*LANE, "at", F.explode("hits").alias("name", "value")).groupBy(*LANE, "name").agg(F.max_by("value", "at").alias("value"))
    for c in captures:
        if c.mode == "regex":
            said = F.regexp_extract_all("body", F.lit("(?md)" + c.pattern), F.lit(int("(" in c.pattern.replace("\\(", "").replace("(?", ""))))
            as_json = F.to_json(F.array(F.get(said, F.size(said) - 1)))
            values = values.union(_last_of(outputs, c, as_json, said))
    lists = values.filter("value IS NOT NULL").groupBy(*LANE).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("captures"))
    out = outputs.select(*LANE).distinct().join(lists, LANE, "left").join(bad, LANE, "left")
    odd = F.exists(F.array(*map(F.lit, TEXTS)), lambda n: F.coalesce(~F.col("captures")[n].startswith('"'), F.lit(False)))
    fault = F.when(F.col("malformed"), "malformed").when(odd, "not-text")
    out = out.withColumn("fault", fault)
    return out.select(*LANE, F.when(F.col("fault").isNull(), F.coalesce("captures", F.create_map().cast("map<string,string>"))).alias("captures"), "fault")


def _last_of(outputs: DataFrame, c: Capture, as_json: Column, said: Column) -> DataFrame:
    """The last match of one regular expression in each output that it is declared for, as a JSON text."""
    rows = outputs.filter((F.col("adapter") == c.adapter) & (F.col("stream") == c.stream))
    return rows.select(*LANE, F.lit(c.name).alias("name"), F.when(F.size(said) > 0, as_json.substr(F.lit(2), F.length(as_json) - 2)).alias("value"))


def _resolved(captures: list[Capture], logical: str) -> Column:
    """For each adapter the first candidate path, in order of captures, that leads to something but null."""
    out = F.lit(None).cast("variant")
    for adapter in sorted({c.adapter for c in captures}):
        candidates = []
        for c in (c for c in captures if c.adapter == adapter):
            for path in c.paths(logical):
                parts = [p for p in path.removeprefix("$").removeprefix(".").split(".") if p]
                there = F.try_variant_get(F.try_parse_json(F.col("captures")[c.name]), "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in parts), "variant")
                candidates.append(F.when(~F.is_variant_null(there), there))
        if candidates:
            out = F.when(F.col("adapter") == adapter, F.coalesce(*candidates)).otherwise(out)
    return out


def observe(scraped: DataFrame, captures: list[Capture]) -> DataFrame:
    """scrape() with declared (fields), state (not-declared, not-reported, reported), shape, the token counts, cost and unreadable (fields).

    A count is a whole number that isn't negative; anything else that a declared
    path leads to makes its field unreadable, never zero. Input that includes
    cache reads loses these; if it can't, it is unreadable. A total that isn't
    stated is the sum of input, cache reads and writes and output.
    """
    promised = declared_fields(captures)
    reports = sorted({c.adapter for c in captures if c.name == USAGE or set(c.fields) & set(USAGE_FIELDS)})
    out = scraped.withColumn("declared", F.coalesce(*[F.when(F.col("adapter") == a, F.array(*map(F.lit, f)).cast("array<string>")) for a, f in promised.items()], F.array().cast("array<string>")))
    out = out.withColumns({f"__{f}": _resolved(captures, f) for f in USAGE_FIELDS})
    number = lambda f: F.when(F.schema_of_variant(F.col(f"__{f}")).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(F.col(f"__{f}"), "$", "decimal(38,18)"))
    wide = lambda f: F.when(F.schema_of_variant(F.col(f"__{f}")).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(F.col(f"__{f}"), "$", "decimal(38,0)"))
    whole = lambda f: F.when((wide(f) >= 0) & (wide(f) <= F.lit("18446744073709551615").cast("decimal(38,0)")) & F.coalesce(F.floor(number(f)) == number(f), F.lit(True)), wide(f).cast("decimal(20,0)"))
    out = out.withColumns({f"__n_{f}": whole(f) if f != "costUsd" else F.when(number(f) >= 0, number(f)) for f in USAGE_FIELDS})
    n = lambda f: F.col(f"__n_{f}")
    reported = F.coalesce(n("inputTokens"), n("inputTokensWithCacheRead"))
    less = n("inputTokensWithCacheRead") - n("cacheReadTokens")
    plain = F.coalesce(n("inputTokens"), P.exclusive_input(n("inputTokensWithCacheRead"), n("cacheReadTokens"))).cast("decimal(20,0)")
    unreadable = F.array_compact(F.array(*[F.when(F.col(f"__{f}").isNotNull() & n(f).isNull(), F.lit(f)) for f in USAGE_FIELDS], F.when(n("inputTokens").isNull() & (less < 0), F.lit("inputTokensWithCacheRead"))))
    parts, lump = [reported, *map(n, COUNTS)], [n("totalTokens"), n("costUsd")]
    has = lambda columns: F.coalesce(*[c.cast("string") for c in columns]).isNotNull()
    nothing = ~has(parts) & ~has(lump) & (F.size(unreadable) == 0) & ~F.coalesce(F.map_contains_key("captures", USAGE), F.lit(False))
    state = F.when(~F.col("adapter").isin(reports), "not-declared").when(F.col("fault").isNotNull() | nothing, "not-reported").otherwise("reported")
    some = [plain, n("cacheReadTokens"), n("cacheWriteTokens"), n("outputTokens")]
    summed = F.when(has(some), sum((F.coalesce(c, F.lit(0).cast("decimal(20,0)")) for c in some[1:]), F.coalesce(some[0], F.lit(0).cast("decimal(20,0)"))).cast("decimal(20,0)"))
    return out.select(
        *scraped.columns, "declared", state.alias("state"), F.when(state == "reported", F.when(has(parts), "components").when(has(lump), "lump").otherwise("unmapped")).alias("shape"), plain.alias("input_tokens"), reported.alias("input_as_reported"),
        *[n(f).alias(c) for f, c in COUNTS.items()], F.coalesce(n("totalTokens"), summed).alias("total_tokens"), F.when(n("totalTokens").isNotNull(), "harness").when(summed.isNotNull(), "derived").alias("total_source"), n("costUsd").alias("cost_usd"), F.array_sort(unreadable).alias("unreadable"),
    )


def latest_scrape(rows: DataFrame, scrapes: DataFrame, facts: list[str]) -> DataFrame:
    """Rows with facts of their latest scrape, by seq, of the same task, adapter, attempt and lease; without one they are null."""
    last = scrapes.groupBy(*LANE).agg(F.max_by(F.struct(*facts), F.struct("seq", "ledger_id")).alias("__last"))
    return rows.join(last, LANE, "left").select(*rows.columns, *[F.col(f"__last.{f}").alias(f) for f in facts])
