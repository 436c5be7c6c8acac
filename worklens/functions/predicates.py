"""Predicates and small functions on ledger columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Verdicts and events of the ledger's contract.
UNCOUNTED = ["clean-exit-no-artifact", "pool-vanished", "preempted", "cancelled", "substituted"]
PASSING = ["pass", "reused", "substituted"]
TERMINAL = ["completed", "failed", "preempted", "witness_emitted"]
EVIDENCE = ["evidence_pass", "evidence_fail"]
JOURNAL_TERMINAL = ["completed", "failed", *EVIDENCE, "witness_emitted"]


#: Names of time units by their seconds.
UNITS = {
    1.0: ["", "s", "sec", "secs", "second", "seconds"], 0.001: ["ms", "msec", "msecs"], 0.000001: ["us", "usec", "usecs"],
    60.0: ["m", "min", "mins", "minute", "minutes"], 3600.0: ["h", "hr", "hrs", "hour", "hours"], 86400.0: ["d", "day", "days"],
    604800.0: ["w", "week", "weeks"], 2629800.0: ["month", "months"], 31557600.0: ["y", "year", "years"],
}


def canonical_gpu(verdict: Column, labor: Column) -> Column:
    """fresh labor whose verdict counts."""
    return (labor == "fresh") & ~verdict.isin(UNCOUNTED)


def passing(verdict: Column) -> Column:
    return verdict.isin(PASSING)


def terminal(event: Column) -> Column:
    """ends an attempt; `cancelled` is a verdict, not an event."""
    return event.isin(TERMINAL)


def journal_terminal(event: Column) -> Column:
    """F14, first version: a journal state that is final there, evidence included."""
    return event.isin(JOURNAL_TERMINAL)


def evidence(event: Column) -> Column:
    """F15."""
    return event.isin(EVIDENCE)


def compatible(a: Column, b: Column) -> Column:
    """null on either side matches."""
    return a.isNull() | b.isNull() | (a == b)


def within(at: Column, since: Column | None, until: Column | None) -> Column:
    """Null fails every bound that is set."""
    out = F.lit(True)
    if since is not None:
        out = out & F.coalesce(at >= since, F.lit(False))
    if until is not None:
        out = out & F.coalesce(at <= until, F.lit(False))
    return out


def in_pool(pools: Column, name: str) -> Column:
    """any of the pools has this name; no pools match nothing."""
    return F.coalesce(F.array_contains(pools, name), F.lit(False))


def from_origin(source: Column, producer: Column, name: str) -> Column:
    """source or producer name; null matches nothing."""
    return F.coalesce(source == name, F.lit(False)) | F.coalesce(producer == name, F.lit(False))


def duration_seconds(text: Column) -> Column:
    """H3: `2h 30min` and the like to seconds, bare numbers as such; null if anything in it is not a number with a known unit or none."""
    table = F.create_map(*[F.lit(x) for seconds, names in UNITS.items() for name in names for x in (name, seconds)])
    part = r"([0-9]+(?:\.[0-9]+)?|\.[0-9]+)\s*([A-Za-z]*)"
    numbers, names = (F.regexp_extract_all(text, F.lit(part), F.lit(g)) for g in (1, 2))
    total = F.aggregate(F.zip_with(numbers, names, lambda n, u: n.cast("double") * F.try_element_at(table, u)), F.lit(0.0), lambda a, x: a + x)
    return F.when(text.rlike(rf"^\s*({part}\s*)+$"), total)


def execution_id(task: Column, attempt: Column, lease: Column) -> Column:
    """H8: a digest of the lane's JSON, members in this order."""
    return F.sha2(F.to_json(F.struct(task.alias("taskUuid"), attempt.alias("attempt"), lease.alias("leaseEpoch"))), 256)


def slug(text: Column, most: int = 48) -> Column:
    """Lower case, other signs to single hyphens, none at the ends."""
    return F.regexp_replace(F.left(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(most)), "-+$", "")


def clipped(text: Column, most: int) -> Column:
    """White space collapsed, cut with dots."""
    flat = F.trim(F.regexp_replace(text, r"[ \t\n\r]+", " "))
    return F.when(F.length(flat) > most, F.concat(F.left(flat, F.lit(most - 3)), F.lit("..."))).otherwise(flat)


def exclusive_input(inclusive: Column, cached: Column) -> Column:
    """Input without its cached part; null where that would be negative."""
    return F.when(inclusive >= cached, inclusive - cached)


def headroom(own: Column, remaining: Column, meter: Column, weekly: Column) -> Column:
    """What a pool allows, from its own used share and a meter's, the greater of them counting, its free slots and the week's share."""
    percent = F.greatest(own, F.coalesce(meter, F.lit(0.0)))
    return F.when((remaining <= 0) | (percent >= 90), "STOP").when((percent >= 70) | (weekly >= 80), "SLOW").otherwise("GO")


def equals(column: str, value) -> Column:
    """A filter that is set: null fails it."""
    return F.coalesce(F.col(column) == value, F.lit(False))


def jobs_filter(*, pool: str | None = None, origin: str | None = None, since: Column | None = None, until: Column | None = None, **fields) -> Column:
    """all filters that are set; fields are live_state, terminal_verdict, executor, adapter, source, parent, session, compared as they are.

    Times bound the later of last_event_at and terminal_at; a run's filter is a
    join with its members (J5).
    """
    unknown = set(fields) - {"live_state", "terminal_verdict", "executor", "adapter", "source", "parent", "session"}
    if unknown:
        raise ValueError(f"no such filter: {sorted(unknown)}")
    out = within(F.greatest("last_event_at", "terminal_at"), since, until)
    for name, value in fields.items():
        out = out if value is None else out & equals(name, value)
    out = out if pool is None else out & in_pool(F.col("pools"), pool)
    return out if origin is None else out & from_origin(F.col("origin_source"), F.col("producer"), origin)


def lifecycle_filter(*, since: Column | None = None, until: Column | None = None, **fields) -> Column:
    """all filters that are set; fields are task, attempt, session, event, journal_scope, projection_scope, source."""
    unknown = set(fields) - {"task", "attempt", "session", "event", "journal_scope", "projection_scope", "source"}
    if unknown:
        raise ValueError(f"no such filter: {sorted(unknown)}")
    out = within(F.col("ts"), since, until)
    for name, value in fields.items():
        out = out if value is None else out & equals(name, value)
    return out


def journal_filter(*, since_us: int | None = None, **fields) -> Column:
    """all filters that are set; fields are task, session, event, journal_scope, projection_scope. A record without a time is never too early."""
    unknown = set(fields) - {"task", "session", "event", "journal_scope", "projection_scope"}
    if unknown:
        raise ValueError(f"no such filter: {sorted(unknown)}")
    out = F.lit(True) if since_us is None else F.coalesce(F.col("us") >= since_us, F.lit(True))
    for name, value in fields.items():
        out = out if value is None else out & equals(name, value)
    return out
