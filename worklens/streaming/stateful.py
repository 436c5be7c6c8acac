"""Streams whose next answer needs the last one: a small state for each key, carried from batch to batch.

Within a batch the records of a key are put in order; across batches they must
come in order, as they do from an append-only log.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from worklens.operators.folds import GENESIS

_OWN_HASH = re.compile(r'"hash":"(sha256:[0-9a-f]{64})"\}$')
_PREVIOUS = re.compile(r'"prevHash":"(sha256:[0-9a-f]{64})"')


def carried(rows: DataFrame, key: str, order: str, out: str, state: str, first: tuple, step: Callable[[tuple, object], tuple[tuple, list[tuple]]]) -> DataFrame:
    """For each record in order what step makes of the key's state and it: (next state, rows of out)."""
    names = [c.split()[0] for c in out.split(", ")]

    def run(_: tuple, chunks: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now, made = held.get if held.exists else first, []
        for r in pd.concat(list(chunks)).sort_values(order).itertuples(index=False):
            now, more = step(now, r)
            made += more
        held.update(now)
        yield pd.DataFrame(made, columns=names)

    return rows.groupBy(key).applyInPandasWithState(run, out, state, "append", GroupStateTimeout.NoTimeout)


def verify_appended(lines: DataFrame, most_held: int = 10_000) -> DataFrame:
    """(ledger_id, line, problem) of newly appended (ledger_id, line, raw, size): only they are hashed.

    size is the number of lines of the ledger as it was read. Lines may come in
    any order: early ones are held in the state until those before are there; if
    more than most_held wait, those missing are taken as gone (`gap` at the first).
    Lines that were verified already are passed over. If a ledger is now shorter
    than what was verified, or its first line has changed, it is verified anew
    from its first line on; a row with line 0 and problem `rebuilt` says that
    what was said of it before no longer counts.
    """
    state = "next long, hash string, first string, lines array<bigint>, raws array<string>"

    def run(key: tuple, chunks: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now, last, first, lines_, raws = held.get if held.exists else (1, GENESIS, None, [], [])
        rows = pd.concat(list(chunks))
        early, made = dict(zip(lines_, raws, strict=True)), []
        begin = rows.loc[rows["line"] == 1, "raw"]
        if rows["size"].min() < now - 1 or (first is not None and len(begin) and begin.iloc[-1] != first):
            now, last, first, early = 1, GENESIS, None, {}
            made.append((key[0], 0, "rebuilt"))
        early |= {int(n): raw for n, raw in zip(rows["line"], rows["raw"], strict=True) if n >= now}
        while now in early or len(early) > most_held:
            if now not in early:
                made.append((key[0], now, "gap"))
                now = min(early)
            raw = early.pop(now)
            first = raw if now == 1 else first
            said, before = _OWN_HASH.search(raw), _PREVIOUS.search(raw)
            if not said:
                made.append((key[0], now, "not-a-record"))
            elif "sha256:" + hashlib.sha256((raw[: said.start()] + '"hash":""}').encode()).hexdigest() != said[1]:
                made.append((key[0], now, "hash-mismatch"))
            else:
                if not before or before[1] != last:
                    made.append((key[0], now, "prev-hash-mismatch"))
                last = said[1]
            now += 1
        held.update((now, last, first, list(early), list(early.values())))
        yield pd.DataFrame(made, columns=["ledger_id", "line", "problem"])

    return lines.groupBy("ledger_id").applyInPandasWithState(run, "ledger_id long, line long, problem string", state, "append", GroupStateTimeout.NoTimeout)


def stalls(events: DataFrame, limit_seconds: int, late: str) -> DataFrame:
    """(task, at, notice, multiple) for lanes of (task, ts) that fall silent: `stall` once for each multiple of the limit, `recovered` when they speak again.

    Time is that of the events: a timer by task goes off when the watermark has
    passed the next multiple, whether or not the task speaks any more. A silence
    that its own next event ends first is noticed then, with its last multiple.
    """
    limit = limit_seconds * 1000

    def run(key: tuple, chunks: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        last, told = held.get if held.exists else (None, 0)
        made = []
        if held.hasTimedOut:
            n = (held.getCurrentWatermarkMs() - last) // limit
            if n > told:
                made.append((key[0], last + n * limit, "stall", n))
                told = n
        else:
            for at in sorted(pd.concat(list(chunks))["ms"].tolist()):
                if last is not None and at > last:
                    n = (at - last) // limit
                    if n > told:
                        made.append((key[0], last + n * limit, "stall", n))
                    if n or told:
                        made.append((key[0], at, "recovered", max(n, told)))
                        told = 0
                last = at if last is None else max(last, at)
        held.update((last, told))
        held.setTimeoutTimestamp(max(last + (told + 1) * limit, held.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(made, columns=["task", "at", "notice", "multiple"])

    # milliseconds, as watermarks are, so that no time zone comes between
    timed = events.select("task", "ts", F.unix_millis("ts").alias("ms")).withWatermark("ts", late)
    out = timed.groupBy("task").applyInPandasWithState(run, "task long, at long, notice string, multiple long", "last long, told long", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("task", F.timestamp_millis("at").alias("at"), "notice", "multiple")


def pressure_levels(samples: DataFrame, high: float, low: float) -> DataFrame:
    """(store, n, used) with the level, which rises at `high` and falls only at `low`, and its episode."""

    def step(now: tuple, r) -> tuple[tuple, list[tuple]]:
        level, episode = now
        is_high = r.used >= high or (level == "high" and r.used > low)
        episode += is_high and level == "ok"
        level = "high" if is_high else "ok"
        return (level, episode), [(r.store, r.n, r.used, level, episode)]

    return carried(samples, "store", "n", "store long, n long, used double, level string, episode long", "level string, episode long", ("ok", 0), step)


def retained(records: DataFrame, since_micros: int) -> DataFrame:
    """(ledger_id, sequence, micros) without the prefix before the first record inside the horizon; from there on everything stays."""

    def step(now: tuple, r) -> tuple[tuple, list[tuple]]:
        keeps = now[0] or r.micros >= since_micros
        return (keeps,), [(r.ledger_id, r.sequence, r.micros)] if keeps else []

    return carried(records, "ledger_id", "sequence", "ledger_id long, sequence long, micros long", "keeps boolean", (False,), step)


def retries(events: DataFrame, most: int) -> DataFrame:
    """(task, sequence, nth, retry) for each failure: the n-th of a task may be retried `most` times, then it is exhausted."""

    def step(now: tuple, r) -> tuple[tuple, list[tuple]]:
        if r.event != "failed":
            return now, []
        nth = now[0] + 1
        return (nth,), [(r.task, r.sequence, nth, "automatic" if nth <= most else "exhausted")]

    return carried(events, "task", "sequence", "task long, sequence long, nth long, retry string", "failures long", (0,), step)


def status_changes(rows: DataFrame) -> DataFrame:
    """(campaign, n, before, status) where the status of (campaign, n, status) differs from the last one."""

    def step(now: tuple, r) -> tuple[tuple, list[tuple]]:
        return (r.status,), [] if now[0] == r.status else [(r.campaign, r.n, now[0], r.status)]

    return carried(rows, "campaign", "n", "campaign long, n long, before string, status string", "status string", (None,), step)


def budgets(debits: DataFrame, window: str, slide: str, lateness: str) -> DataFrame:
    """Per pool the debits of sliding windows of (pool, ts, gpu_seconds); windows end when the watermark passes them, and their state goes."""
    late = debits.withWatermark("ts", lateness)
    return late.groupBy(F.window("ts", window, slide).alias("w"), "pool").agg(F.sum("gpu_seconds").alias("spent"), F.count("*").alias("debits")).select("w.start", "w.end", "pool", "spent", "debits")
