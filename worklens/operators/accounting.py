"""Usage accounting: per-attempt deltas of cumulative counters, chains of predecessors, and what a run's usage covers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worklens.operators import graphs
from worklens.sources import shared

#: Logical fields in order, with the column that holds what was observed of them.
FIELDS = {
    "cacheReadTokens": "cache_read_tokens", "cacheWriteTokens": "cache_write_tokens", "costUsd": "cost_usd", "inputTokens": "input_as_reported", "inputTokensWithCacheRead": "input_as_reported",
    "outputTokens": "output_tokens", "reasoningTokens": "reasoning_tokens", "totalTokens": "stated_total",
}
COMPONENTS = ["cacheReadTokens", "cacheWriteTokens", "inputTokens", "inputTokensWithCacheRead", "outputTokens", "reasoningTokens"]
#: What account() gives, in the same order as it is observed.
ACCOUNTED = ["input_tokens", "input_as_reported", "cache_read_tokens", "cache_write_tokens", "output_tokens", "reasoning_tokens", "stated_total", "cost_usd"]
IDENTITY = ["task", "attempt", "lease_epoch"]
#: What the sums of a run read of an attempt's record.
SUMMED = ["record", "declared", "unreadable", "state", "currency", "accounting", *ACCOUNTED]
#: Where sums stop.
MOST = "18446744073709551615"


def _declares(field: str) -> Column:
    return F.array_contains("declared", field)


def with_predecessors(scrapes: DataFrame) -> DataFrame:
    """scrapes with before, the last earlier scrape (by seq, in its ledger) of the attempt that pred_task, pred_attempt and pred_lease name; null if there is none.

    Scrapes and those that ask for them meet in one window by identity, so an
    attempt that was scraped or named very often costs no more than its rows.
    Without a column pred_task nobody names any, and nothing is dealt out.
    """
    kept = [c for c in scrapes.columns]
    row = F.struct(*kept)
    none = F.lit(None).cast(scrapes.select(row.alias("x")).schema["x"].dataType)
    if "pred_task" not in kept:
        return scrapes.withColumn("before", none)
    key = lambda *columns: F.struct(F.col("ledger_id"), *[F.col(c).alias(n) for c, n in zip(columns, IDENTITY, strict=True)]).alias("key")
    told = scrapes.select(key(*IDENTITY), "seq", F.lit(1).alias("kind"), row.alias("told"), none.alias("asks"))
    asks = scrapes.select(key("pred_task", "pred_attempt", "pred_lease"), "seq", F.lit(0).alias("kind"), none.alias("told"), row.alias("asks"))
    past = Window.partitionBy("key").orderBy("seq", "kind").rowsBetween(Window.unboundedPreceding, -1)
    found = asks.filter("asks.pred_task IS NOT NULL").union(told).withColumn("before", F.last("told", ignorenulls=True).over(past)).filter("kind = 0").select("asks.*", "before")
    return found.unionByName(scrapes.filter("pred_task IS NULL").withColumn("before", none))


def account(scrapes: DataFrame) -> DataFrame:
    """Scrapes with accounting: state (exact, partial, unavailable), basis (fresh, delta), reason, unavailable (fields) and the attempt's own figures.

    scrapes: ledger_id, seq, task, attempt, lease_epoch, adapter, session, scope
    (attempt, session-cumulative), mode (fresh, resume), pred_task, pred_attempt,
    pred_lease (may be missing if no scrape names another), evidence (accounted,
    legacy or null), declared, state, unreadable and the columns ACCOUNTED. Only a resumed session of cumulative counters is
    told apart from its predecessor; a drop, an unread value or a missing
    baseline makes a field unavailable, with the first field's reason. An input
    that includes cache reads keeps its own delta unless these exceed it.
    """
    rows = with_predecessors(scrapes)
    delta, reported = (F.col("scope") == "session-cumulative") & (F.col("mode") == "resume"), F.col("state") == "reported"
    was = lambda c: F.col(f"before.{c}")
    gap = (
        F.when(F.col("before").isNull(), "missing-predecessor").when(was("evidence") == "legacy", "legacy-predecessor").when(was("evidence").isNull(), "missing-predecessor")
        .when(~was("adapter").eqNullSafe(F.col("adapter")) | ~was("scope").eqNullSafe(F.col("scope")) | ~was("declared").eqNullSafe(F.col("declared")), "declaration-mismatch")
        .when(F.col("session").isNull() | ~F.col("session").eqNullSafe(was("session")), "session-mismatch").when(~was("state").eqNullSafe(F.lit("reported")), "missing-predecessor")
    )
    rows = rows.withColumns({"__delta": delta & reported, "__gap": F.when(delta & reported, gap)})
    difference = {f: F.col(c) - was(c) for f, c in FIELDS.items()}
    fault = {f: F.when(F.col(c).isNull(), "unreadable-current").when(was(c).isNull(), "missing-predecessor").when(difference[f] < 0, "counter-underflow") for f, c in FIELDS.items()}
    rows = rows.withColumns({f"__f_{f}": F.when(_declares(f), fault[f]) for f in FIELDS} | {f"__d_{f}": F.when(_declares(f) & fault[f].isNull(), d) for f, d in difference.items()})
    over = F.coalesce(F.col("__d_inputTokensWithCacheRead") < F.col("__d_cacheReadTokens"), F.lit(False)) & F.col("__d_inputTokens").isNull()
    lost = F.array_compact(F.array(*[F.when(F.col(f"__f_{f}").isNotNull() | (over if f == "inputTokensWithCacheRead" else F.lit(False)), F.lit(f)) for f in FIELDS]))
    computed = sum((F.col(f"__d_{f}").isNotNull().cast("int") for f in FIELDS), F.lit(0)) - over.cast("int")
    raw = F.array_sort(F.array_intersect("unreadable", "declared"))
    figure = F.coalesce(*[F.col(c).cast("string") for c in ACCOUNTED[1:]]).isNotNull()
    unavailable = F.when(~F.col("__delta"), F.when(delta, F.array().cast("array<string>")).otherwise(F.when(reported, raw).otherwise(F.array().cast("array<string>")))).when(F.col("__gap").isNotNull(), F.col("declared")).otherwise(lost)
    rows = rows.withColumns({"__lost": unavailable, "__over": over, "__computed": computed})
    clean = F.size("__lost") == 0
    state = F.when(F.col("__gap").isNotNull(), "unavailable").when(clean, "exact").when(F.col("__delta"), F.when(F.col("__computed") == 0, "unavailable").otherwise("partial")).when(figure, "partial").otherwise("unavailable")
    first = F.coalesce(*[F.col(f"__f_{f}") for f in FIELDS])
    reason = F.coalesce("__gap", F.when(F.col("__delta"), F.when(F.col("__over"), "counter-underflow").otherwise(first)).otherwise(F.when(~clean, "unreadable-current")))
    d = lambda f: F.when(F.col("__gap").isNull(), F.col(f"__d_{f}"))
    inclusive = F.when(~F.col("__over"), d("inputTokensWithCacheRead"))
    own = {
        "input_tokens": F.coalesce(d("inputTokens"), inclusive - d("cacheReadTokens")), "input_as_reported": F.when(~F.array_contains("__lost", "inputTokensWithCacheRead"), F.coalesce(d("inputTokens"), inclusive)), "cache_read_tokens": d("cacheReadTokens"),
        "cache_write_tokens": d("cacheWriteTokens"), "output_tokens": d("outputTokens"), "reasoning_tokens": d("reasoningTokens"), "stated_total": d("totalTokens"), "cost_usd": d("costUsd"),
    }
    figures = [F.when(F.col("__delta"), own[c]).otherwise(F.when(reported, F.col(c))).alias(c) for c in ACCOUNTED]
    accounting = F.struct(state.alias("state"), F.when(delta, "delta").otherwise("fresh").alias("basis"), reason.alias("reason"), F.col("__lost").alias("unavailable"), *figures)
    return rows.select(*scrapes.columns, accounting.alias("accounting"))


def bindings(records: DataFrame) -> DataFrame:
    """(ledger_id, seq, bound, counted) for each record of records: does the predecessor it names hold, and do all before that.

    records: ledger_id, seq, hash, task, attempt, lease_epoch, adapter, session,
    scope, declared, derivation (fresh-zero, delta, baseline-missing, attempt),
    contributes, and pred_seq, pred_hash, pred_task, pred_attempt, pred_lease. A
    delta is bound if the record of that number is earlier and has that hash,
    task, attempt, lease, the same adapter, session, scope and declarations, and
    a contribution of its own. It counts if it is bound, and so is the one it
    names, down to one that started from zero: pointers double, so a chain takes
    as many rounds as its length has binary digits. Records are read once: each
    tells at its own number, and asks at the one it names, in one window by ledger
    and number. What comes of it is kept, and only what holds by itself goes on.
    """
    is_delta = F.col("derivation") == "delta"
    asks = F.coalesce(is_delta & (F.col("pred_seq") < F.col("seq")) & (F.col("session") != ""), F.lit(False))  # no other can be bound
    tells = F.coalesce(F.col("derivation").isin("fresh-zero", "delta") & F.col("contributes"), F.lit(False))
    starts = F.col("derivation").isin("fresh-zero", "attempt") & F.col("pred_seq").isNull() & F.coalesce("contributes", F.lit(False))
    says = ["hash", *IDENTITY, "adapter", "session", "scope", "declared"]
    own = F.struct(*says).alias("own")
    named = F.struct(*[F.col(c).alias(n) for c, n in zip(["pred_hash", "pred_task", "pred_attempt", "pred_lease"], says)], *says[4:]).alias("own")
    seen = F.struct(F.col("seq").alias("at"), F.when(tells, own).alias("told"), F.lit(None).cast("long").alias("asker"), F.lit(None).cast(records.select(named).schema["own"].dataType).alias("asked"))
    wanted = F.struct(F.col("pred_seq").alias("at"), F.lit(None).cast(records.select(own).schema["own"].dataType).alias("told"), F.col("seq").alias("asker"), named.alias("asked"))
    rows = records.select("ledger_id", "seq", is_delta.alias("is_delta"), starts.alias("starts"), asks.alias("asks"), F.explode(F.array_compact(F.array(seen, F.when(asks, wanted)))).alias("x"))
    place = Window.partitionBy("ledger_id", "x.at").orderBy(F.col("x.asker").asc_nulls_first())
    p = F.last("x.told", ignorenulls=True).over(place.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.select("ledger_id", "seq", "is_delta", "starts", "asks", "x", p.alias("p")).filter("x.asker IS NOT NULL OR NOT asks")
    equal = [(F.col(f"p.{c}") == F.col(f"x.asked.{c}")) if c in says[:4] else F.col(f"p.{c}").eqNullSafe(F.col(f"x.asked.{c}")) for c in says]
    holds = F.col("p").isNotNull()
    for same in equal:
        holds = holds & same
    bound = F.when(F.col("is_delta"), F.col("asks") & F.coalesce(holds, F.lit(False)))
    rows = rows.select("ledger_id", "seq", bound.alias("bound"), F.when(F.col("is_delta") & bound, F.col("x.at")).alias("to"), F.coalesce(F.when(F.col("is_delta"), bound).otherwise(F.col("starts")), F.lit(False)).alias("good"))
    rows = shared.kept(rows)
    pointers = rows.filter("good").select(F.struct("ledger_id", "seq").alias("node"), F.when(F.col("to").isNotNull(), F.struct("ledger_id", F.col("to").alias("seq"))).alias("to"), "good")
    counted = graphs.follow(pointers).filter("good").select("node.ledger_id", "node.seq", F.lit(True).alias("counted"))
    return rows.select("ledger_id", "seq", "bound").join(counted, ["ledger_id", "seq"], "left").withColumn("counted", F.coalesce("counted", F.lit(False)))


#: What may be incomplete about a run's usage, in order.
CAVEATS = [
    "ledger-unverified", "attempts-missing-attestation", "attempt-counter-unavailable", "duplicate-attempt-leases", "unexpected-attestation", "members-without-attestation", "attempts-without-usage", "reported-without-figures",
    "partial-components", "partial-total", "unreadable-usage-record", "legacy-usage-contract", "declared-surface-unknown", "total-only-attempts", "accounting-unavailable", "cumulative-baseline-missing", "unreadable-fields",
    "mixed-total-authority", "total-component-mismatch", "partial-fresh-input", "partial-cost", "non-usd-cost", "sum-saturated",
]


def expected(roster: DataFrame) -> DataFrame:
    """(run, task, attempt), one row for each expected attempt of roster (run, task, ceiling); a task whose ceiling is unknown or zero has none."""
    return roster.filter("ceiling > 0").select("run", "task", F.explode(F.sequence(F.lit(1), F.col("ceiling").cast("int"))).alias("attempt"))


def missing(roster: DataFrame, attested: DataFrame, most: int = 64) -> DataFrame:
    """(run, missing): the first `most` of a run's expected attempts that nothing attests, by task and attempt, as `task#attempt`.

    Gaps between attested attempts are looked at, not all attempts; each lists
    its first `most`, and Spark keeps as many a run before it shuffles.
    """
    ends = roster.filter("ceiling > 0").select("run", "task", "ceiling", (F.col("ceiling") + 1).alias("attempt"))
    known = roster.filter("ceiling > 0").join(attested.select("task", F.col("attempt").cast("long").alias("attempt")), "task").filter("attempt BETWEEN 1 AND ceiling").select("run", "task", "ceiling", "attempt").distinct()
    before = F.coalesce(F.lag("attempt").over(Window.partitionBy("run", "task").orderBy("attempt")), F.lit(0))
    gaps = known.union(ends).withColumn("before", before).filter("attempt > before + 1")
    ids = gaps.select("run", "task", F.explode(F.sequence(F.col("before") + 1, F.least(F.col("attempt") - 1, F.col("before") + most))).alias("attempt"))
    first = ids.withColumn("at", F.row_number().over(Window.partitionBy("run").orderBy("task", "attempt"))).filter(F.col("at") <= most)
    named = F.transform(F.sort_array(F.collect_list(F.struct("at", F.concat_ws("#", "task", "attempt").alias("id")))), lambda x: x["id"])
    return first.groupBy("run").agg(named.alias("missing"))


def roll_up(roster: DataFrame, scrapes: DataFrame, verified: DataFrame) -> DataFrame:
    """One row for each run of roster (run, task, ceiling): sums with their contributors, coverage, caveats.

    ceiling is the number of attempts expected, null if unknown; scrapes can
    neither add tasks nor raise it. scrapes are account()'s; record says
    `accounted`, `legacy` or null for one without usage. Of an attempt the record
    of the greatest seq counts. Ledgers that aren't verified (ledger_id,
    verified) give nothing, and their runs say so. A figure counts if its field
    was declared, is available and was reported. Sums are wide decimals that stop
    at 2^64 - 1. Tasks are put together before runs, so no list is held.
    """
    tasks = roster.groupBy("run", "task").agg(F.max("ceiling").alias("ceiling"))
    known = scrapes.join(verified, "ledger_id", "left")
    good = known.filter(F.coalesce("verified", F.lit(False)))
    one = tasks.select("task", "ceiling").distinct()
    seen = good.select("task", "attempt", "lease_epoch").join(one, "task")
    expected = (F.col("attempt") >= 1) & (F.col("ceiling").isNull() | (F.col("attempt") <= F.col("ceiling")))
    lanes = seen.groupBy("task", "ceiling", "attempt").agg(F.count_distinct(F.struct("lease_epoch")).alias("leases"))
    by_task = lanes.groupBy("task", "ceiling").agg(
        F.sum("leases").alias("observed"), F.count_if(F.coalesce(expected, F.lit(False))).alias("attested"), F.count_if(~F.coalesce(expected, F.lit(False))).alias("unexpected"),
        F.count_if(F.coalesce(expected, F.lit(False)) & F.col("ceiling").isNotNull() & (F.col("leases") > 1)).alias("twice"),
    ).select("task", F.col("ceiling").alias("__ceiling"), "observed", "attested", "unexpected", "twice")
    bad = known.filter(~F.coalesce("verified", F.lit(False))).select("task", F.lit(True).alias("unverified")).distinct()
    counts = tasks.join(by_task, (tasks.task == by_task.task) & tasks.ceiling.eqNullSafe(F.col("__ceiling")), "left").drop(by_task.task).join(bad, "task", "left")
    n = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    cover = counts.groupBy("run").agg(
        F.count("*").alias("tasks"), n("ceiling").alias("expected"), F.count_if(F.col("ceiling").isNull()).alias("unknown_ceilings"), n("observed").alias("observed"), n("attested").alias("attested"), n("unexpected").alias("unexpected"),
        n("twice").alias("duplicate_leases"), F.sum(F.when(F.col("ceiling").isNotNull(), F.col("ceiling") - F.coalesce("attested", F.lit(0)))).alias("missing_attempts"), F.count_if(F.coalesce("attested", F.lit(0)) == 0).alias("tasks_without_attestation"), F.coalesce(F.max("unverified"), F.lit(False)).alias("unverified"),
    )
    rest = [c for c in good.columns if c in SUMMED]  # what isn't read behind needn't travel
    picked = good.join(one, "task").filter(expected).groupBy("task", "attempt").agg(F.max_by(F.struct(*rest), F.struct("seq", "ledger_id")).alias("x")).select("task", "attempt", "x.*")
    attempts = picked.join(tasks.select("run", "task"), "task")
    return cover.join(_sums(attempts), "run", "left").withColumn("caveats", _caveats()).withColumn("complete", F.size("caveats") == 0)


def _sums(attempts: DataFrame) -> DataFrame:
    a = lambda c: F.col(f"accounting.{c}")
    accounted = F.col("record").eqNullSafe(F.lit("accounted"))
    reported = accounted & (F.col("state") == "reported")
    lost = lambda f: F.array_contains(a("unavailable"), f)
    value = {f: a(c) for f, c in FIELDS.items()}
    has = {f: accounted & _declares(f) & ~lost(f) & value[f].isNotNull() & (F.col("state") == "reported") for f in FIELDS}
    plain, inclusive = has["inputTokens"], has["inputTokensWithCacheRead"] & has["cacheReadTokens"]
    own = {"input_tokens": F.when(plain | inclusive, a("input_tokens"))} | {FIELDS[f]: F.when(has[f], value[f]) for f in ("cacheReadTokens", "cacheWriteTokens", "outputTokens", "reasoningTokens")}
    wide = lambda c: c.cast("decimal(38,0)")
    zero, parts = F.lit(0).cast("decimal(38,0)"), [own[c] for c in ("input_tokens", "cache_read_tokens", "cache_write_tokens", "output_tokens")]
    derived = F.when(F.coalesce(*parts).isNotNull(), sum((F.coalesce(wide(p), zero) for p in parts[1:]), F.coalesce(wide(parts[0]), zero)))
    stated = F.when(has["totalTokens"], value["totalTokens"])
    total = F.coalesce(wide(stated), derived)
    declares = {k: _declares(f) for k, f in (("plain", "inputTokens"), ("inclusive", "inputTokensWithCacheRead"), ("write", "cacheWriteTokens"))}
    formula = reported & (declares["plain"] | declares["inclusive"] | declares["write"])
    whole = (~declares["plain"] | plain) & (~declares["inclusive"] | inclusive) & (~declares["write"] | has["cacheWriteTokens"])
    some = plain | has["inputTokensWithCacheRead"] | has["cacheWriteTokens"]
    fresh = F.when(formula, F.coalesce(wide(own["input_tokens"]), zero) + F.coalesce(wide(own["cache_write_tokens"]), zero))
    usd = F.coalesce(F.col("currency"), F.lit("USD")) == "USD"
    legacy = F.col("record").eqNullSafe(F.lit("legacy"))
    parts_said = F.coalesce(*[F.col(FIELDS[f]).cast("string") for f in COMPONENTS]).isNotNull()
    sums = {c: F.sum(wide(v)) for c, v in own.items()} | {"fresh_input": F.sum(fresh), "total_tokens": F.sum(total)}
    most = F.lit(MOST).cast("decimal(38,0)")
    over = F.greatest(*[F.coalesce(s > most, F.lit(False)) for s in sums.values()])
    any_ = lambda c: F.coalesce(F.max(c), F.lit(False))
    figure = F.array_contains(F.array(*has.values()), True)
    out = attempts.groupBy("run").agg(
        *[F.when(s.isNotNull(), F.least(s, most)).cast("decimal(20,0)").alias(c) for c, s in sums.items()], *[F.count(v).alias(f"n_{c}") for c, v in own.items()],
        F.count(total).alias("n_total_tokens"), F.count_if(formula & whole).alias("fresh_complete"), F.count_if(formula & ~whole & some).alias("fresh_partial"),
        F.when(any_(stated.isNotNull()) & any_(stated.isNull() & derived.isNotNull()), "mixed").when(any_(stated.isNotNull()), "harness").when(any_(derived.isNotNull()), "derived").alias("total_source"),
        F.sum(F.when(has["costUsd"] & usd, value["costUsd"])).cast("double").alias("cost_usd"), F.count_if(has["costUsd"] & usd).alias("n_cost_usd"), over.alias("saturated"),
        F.count_if(reported).alias("reported"), F.count_if(accounted & (F.col("state") == "not-reported")).alias("not_reported"), F.count_if(accounted & (F.col("state") == "not-declared")).alias("not_declared"),
        F.count_if(reported & ~figure).alias("without_figures"), F.count_if(~accounted & ~legacy).alias("without_record"), F.count_if(legacy).alias("legacy"), F.count_if(accounted & (a("state") != "exact")).alias("not_exact"),
        any_(accounted & (a("basis") == "delta") & F.coalesce(a("reason").isin("missing-predecessor", "legacy-predecessor"), F.lit(False))).alias("no_baseline"),
        any_(has["costUsd"] & ~usd).alias("other_currency"), any_(has["totalTokens"] & derived.isNotNull() & (wide(stated) != derived)).alias("mismatch"),
        (any_(legacy & ~parts_said & F.col("stated_total").isNotNull()) & any_((legacy | reported) & parts_said)).alias("total_only"),
        *[F.count_if(accounted & _declares(f)).alias(f"declared_{f}") for f in FIELDS], *[F.count_if(h).alias(f"reported_{f}") for f, h in has.items()],
        *[F.count_if(accounted & _declares(f) & F.array_contains("unreadable", f)).alias(f"unreadable_{f}") for f in FIELDS], *[F.count_if(accounted & _declares(f) & lost(f)).alias(f"unavailable_{f}") for f in FIELDS],
    )
    entry = lambda f: F.struct(F.lit(f).alias("field"), *[F.col(f"{k}_{f}").alias(k) for k in ("declared", "reported", "unreadable", "unavailable")])
    fields = F.filter(F.array(*map(entry, FIELDS)), lambda x: x["declared"] > 0)
    drop = [f"{k}_{f}" for k in ("declared", "reported", "unreadable", "unavailable") for f in FIELDS]
    return out.withColumn("fields", fields).drop(*drop).withColumn("missing_fields", F.transform(F.filter("fields", lambda x: x["reported"] < x["declared"]), lambda x: x["field"]))


def _caveats() -> Column:
    """The caveats that hold, in order; columns of the roll-up that are null count as nothing found."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    is_ = lambda c: F.coalesce(F.col(c), F.lit(False))
    partial = lambda *fields: F.coalesce(F.arrays_overlap("missing_fields", F.array(*map(F.lit, fields))), F.lit(False))
    unread = F.coalesce(F.exists("fields", lambda x: x["unreadable"] > 0), F.lit(False))
    holds = [
        is_("unverified"), n("missing_attempts"), n("unknown_ceilings"), n("duplicate_leases"), n("unexpected"), n("tasks_without_attestation"), n("not_reported") | n("not_declared"), n("without_figures"),
        partial(*COMPONENTS), partial("totalTokens"), n("without_record"), n("legacy"), n("legacy"), is_("total_only"), n("not_exact"), is_("no_baseline"), unread,
        F.coalesce(F.col("total_source") == "mixed", F.lit(False)), is_("mismatch"), n("fresh_partial"), partial("costUsd"), is_("other_currency"), is_("saturated"),
    ]
    return F.array_compact(F.array(*[F.when(h, F.lit(name)) for name, h in zip(CAVEATS, holds, strict=True)]))
