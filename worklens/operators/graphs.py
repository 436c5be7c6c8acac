"""Lineage and closures. Along chains rounds double the distance covered; over branching graphs they go from frontier to frontier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklens.sources.shared import gone as _gone
from worklens.sources.shared import kept as _kept


#: How many times the edges, or the pairs found, ways of double length may be.
GROWTH = 4
#: Nodes of a piece of an unbranched chain.
PIECE = 1024


def follow(pointers: DataFrame) -> DataFrame:
    """(node, good) from pointers (node, to, good), one for each node: whether it and all that its pointers lead to are good.

    Pointers double: each round a node points where its target pointed, until
    all have come to an end. One that leads to no node is bad, and so are nodes
    on a cycle or that lead to one: when no more come to an end in a round, none
    of those left ever will.
    """
    state, left = _kept(pointers.select("node", "to", "good")), None
    while True:
        open_ = F.col("to").isNotNull() & F.col("good")
        now = state.filter(open_).count()
        if now in (0, left):
            return state.select("node", (F.col("good") & F.col("to").isNull()).alias("good"))
        ahead = state.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("good").alias("met"))
        moved = state.filter(open_).join(ahead, "to", "left").select("node", F.col("next").alias("to"), F.coalesce("met", F.lit(False)).alias("good"))
        before, left = state, now
        state = _kept(state.filter(~open_).union(moved))
        _gone(before)


def _doubled(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of edges (run, successor): the ends (run, head, steps) of runs whose chain ends, and the rest (run, to, low): to lies on a cycle, low is the least of it.

    One successor a run, the least, so a run has one row whatever the edges are.
    A run points twice as far each round, with the number of steps and the least
    run on the way. Runs that come to an end rest there. The others are done when
    neither their targets grow fewer nor anything less is found in a round: then
    all targets lie on cycles, and each way has gone around its own.
    """
    first = edges.groupBy("run").agg(F.min("successor").alias("to"))
    state, seen = _kept(first.select("run", "to", F.lit(1).cast("long").alias("steps"), F.col("run").alias("low"), F.lit(False).alias("ended"))), None
    while True:
        ahead = state.select(F.col("run").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"), F.col("low").alias("lower"), F.lit(True).alias("there"), F.col("ended").alias("over"))
        moved = state.filter(~F.col("ended")).join(ahead, "to", "left").select(
            "run", F.coalesce("next", "to").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.least("low", "lower").alias("low"), (F.col("there").isNull() | F.col("over")).alias("ended")
        )
        before = state
        state = _kept(state.filter("ended").union(moved))
        _gone(before)
        open_ = state.filter(~F.col("ended"))
        mark = open_.agg(F.count("*"), F.count_distinct("to"), F.sum(F.xxhash64("run", "low").cast("decimal(38,0)"))).first()
        if not mark[0] or mark == seen:
            return state.filter("ended").select("run", F.col("to").alias("head"), "steps"), open_.select("run", "to", "low")
        seen = mark


def heads(edges: DataFrame) -> DataFrame:
    """(run, head, steps), one row for each run with a successor: the last of its chain and how far it is.

    A run on a cycle, or that leads to one, has no head: null. Of several
    successors the least counts; conflicts() reports them.
    """
    ends, endless = _doubled(edges)
    return ends.union(endless.select("run", F.lit(None).cast(ends.schema["head"].dataType), F.lit(None).cast("long")))


def cycles(edges: DataFrame) -> DataFrame:
    """(run, cycle) for each run that lies on a cycle, which is named by its least run."""
    _, endless = _doubled(edges)
    on = endless.select(F.col("to").alias("run")).distinct()
    return endless.join(on, "run", "left_semi").select("run", F.col("low").alias("cycle"))


def conflicts(edges: DataFrame) -> DataFrame:
    """(run, problem): second successors, second predecessors, edges to oneself and members of cycles."""
    several = lambda side, name: edges.groupBy(F.col(side).alias("run")).agg(F.count("*").alias("n")).filter("n > 1").select("run", F.lit(name).alias("problem"))
    own = edges.filter("run = successor").select("run", F.lit("self-edge").alias("problem"))
    return several("run", "second-successor").union(several("successor", "second-predecessor")).union(own).union(cycles(edges).select("run", F.lit("cycle")))


def _closure(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, node) from (name, node) and edges (node, to): all that each name reaches from its nodes, these included; every pair found is written.

    Along chains the step doubles each round, so a long one takes as many rounds
    as its length has binary digits. Where it branches, ways of double length
    may be far more than edges; they are counted before they are made, and if
    there are more than GROWTH times as many as edges or pairs found, the step
    stays as it is, and from there only what a round found new goes on, from
    frontier to frontier. Sets, so cycles end, at the first round without
    anything new.
    """
    step = _kept(edges.select("node", "to").distinct())
    found = _kept(starts.select("name", "node").distinct())
    fresh, n_edges, n_found, doubles, changed = found, step.count(), found.count(), True, True
    while True:
        onward = (found if changed else fresh).join(step, "node").select("name", F.col("to").alias("node")).distinct()
        new = _kept(onward.join(found, ["name", "node"], "left_anti"))
        n = new.count()
        if not n:
            return found
        whole = _kept(found.union(new))
        _gone(found, *([fresh] if fresh is not found else []))
        found, fresh, n_found, changed = whole, new, n_found + n, False
        if doubles:
            degrees = step.select(F.col("node").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("in")).union(step.select("to", F.lit(0), F.lit(1))).groupBy("x").agg(F.sum("out").alias("out"), F.sum("in").alias("in"))
            ways = degrees.agg(F.coalesce(F.sum(F.col("out") * F.col("in")), F.lit(0))).first()[0]
            doubles = ways <= GROWTH * max(n_edges, n_found)
        if doubles:
            longer = _kept(step.join(step.select(F.col("node").alias("to"), F.col("to").alias("far")), "to").select("node", F.col("far").alias("to")).distinct())
            _gone(step)
            step, changed = longer, True


def _pieces(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of edges (node, to): places (node, piece, place), one row a node, and steps (node, to) between pieces.

    An edge is plain if it is the only one from its node and the only one to its
    target. Plain edges form chains, or rings, which are cut before their least
    node; chains are cut in pieces of PIECE nodes. So all other edges lead from
    the last node of a piece to the first of one: who enters a piece meets all of
    it, and who stands in it all that is behind, and all that the piece leads to.
    """
    edges = _kept(edges.select("node", "to").distinct())
    single = edges.groupBy("node").agg(F.min("to").alias("to"), F.count("*").alias("n")).filter("n = 1 AND node <> to").select("node", "to")
    plain = _kept(single.join(edges.groupBy("to").agg(F.count("*").alias("n")).filter("n = 1").select("to"), "to").select(F.col("to").alias("run"), F.col("node").alias("successor")))
    ends, endless = _doubled(plain)
    if not endless.isEmpty():
        ends = ends.union(_doubled(plain.join(endless.filter("run <> low").select("run"), "run", "left_semi"))[0])
    nodes = edges.select("node").union(edges.select("to")).distinct().join(ends.withColumnRenamed("run", "node"), "node", "left")
    place = F.coalesce("steps", F.lit(0).cast("long"))
    places = _kept(nodes.select("node", F.struct(F.coalesce("head", "node").alias("head"), F.floor(place / PIECE).alias("part")).alias("piece"), place.alias("place")))
    to = places.select(F.col("node").alias("to"), F.col("piece").alias("piece_to"), F.col("place").alias("place_to"))
    between = edges.join(places, "node").join(to, "to").filter((F.col("piece") != F.col("piece_to")) | (F.col("place_to") != F.col("place") + 1))
    return places, _kept(between.select(F.col("piece").alias("node"), F.col("piece_to").alias("to")).distinct())


def _ahead(pieces: DataFrame, steps: DataFrame) -> DataFrame:
    """(piece, far): what each of pieces (piece) leads to by one step or more, itself only if it lies on a cycle."""
    first = pieces.select(F.col("piece").alias("node")).distinct().join(steps, "node")
    return _closure(first.select(F.col("node").alias("name"), F.col("to").alias("node")), steps).select(F.col("name").alias("piece"), F.col("node").alias("far"))


def reach(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, node) from (name, node) and edges (node, to): all that each name reaches from its nodes, these included.

    Unbranched chains are taken in pieces: what is searched and written are pairs
    of pieces, and of names with pieces. The pairs of names and nodes, which may be
    as many as the square of a chain, come from a last join by piece, each once;
    they are neither written nor sorted here.
    """
    places, steps = _pieces(edges)
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, so that few rows that become many aren't put into one task
    dealt = places.repartition(n, "piece")
    at = _kept(starts.select("name", "node").distinct().join(places, "node", "left"))
    lone = at.filter("piece IS NULL").select("name", "node")
    first = at.filter("piece IS NOT NULL").groupBy("name", "piece").agg(F.min("place").alias("since"))
    far = first.join(_ahead(first, steps), "piece").select("name", F.col("far").alias("piece")).distinct()
    entered = first.join(far, ["name", "piece"], "left_anti").union(far.withColumn("since", F.lit(0).cast("long")))
    met = entered.repartition(n, "piece").join(dealt, "piece").filter("place >= since")
    return lone.union(met.select("name", "node"))


def blocked_by(dependencies: DataFrame, blocked: DataFrame) -> DataFrame:
    """(task, root) for every blocked task that a task depends on, near or far."""
    back = dependencies.select(F.col("needs").alias("node"), F.col("task").alias("to"))
    starts = back.join(blocked.select(F.col("task").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("name"), F.col("to").alias("node"))
    return reach(starts, back).select(F.col("node").alias("task"), F.col("name").alias("root"))


def deferrals(dependencies: DataFrame, checkpoints: DataFrame, open_tasks: DataFrame) -> DataFrame:
    """(checkpoint, task) for open work that a checkpoint waits for though neither depends on the other, near or far.

    checkpoints (checkpoint, campaign) and open_tasks (task, campaign): each
    checkpoint waits for the open tasks of its campaign. Only these pairs are
    looked up: two tasks in one piece of a chain are related, others are if one's
    piece leads to the other's. Nobody's related tasks are listed.
    """
    places, steps = _pieces(dependencies.select(F.col("needs").alias("node"), F.col("task").alias("to")))
    at = lambda name: places.select(F.col("node").alias(name), F.col("piece").alias(f"__{name}"))
    waits = checkpoints.join(at("checkpoint"), "checkpoint", "left").join(open_tasks.join(at("task"), "task", "left"), "campaign")
    waits = _kept(waits.filter("checkpoint <> task AND (__checkpoint <> __task OR __checkpoint IS NULL OR __task IS NULL)").select("checkpoint", "task", "__checkpoint", "__task"))
    own = waits.select(F.col("__checkpoint").alias("piece")).filter("piece IS NOT NULL").distinct()
    related = _ahead(own, steps).union(_ahead(own, steps.select(F.col("to").alias("node"), F.col("node").alias("to"))))
    return waits.join(related.select(F.col("piece").alias("__checkpoint"), F.col("far").alias("__task")).distinct(), ["__checkpoint", "__task"], "left_anti").select("checkpoint", "task")


def ready(tasks: DataFrame, needs: DataFrame) -> DataFrame:
    """(task, status, wave, blocked_by, open_needs) for tasks (task, done, blocked) and needs (task, needs).

    Done stays done. A task that is blocked itself, or needs such a one, near or
    far, is blocked, with the roots. Of the others those without open needs are
    ready, wave 0; wave n are those that become so when all before are done,
    found by peeling the frontier round by round. Tasks that never do, as they
    wait for a cycle or for a task that isn't there, are `stuck`.
    """
    known = _kept(tasks.groupBy("task").agg(F.max("done").alias("done"), F.max("blocked").alias("blocked")))
    edges = _kept(needs.join(known.filter("done").select(F.col("task").alias("needs")), "needs", "left_anti").select("task", "needs").distinct())
    roots = blocked_by(edges, known.filter("blocked AND NOT done").select("task")).groupBy("task").agg(F.sort_array(F.collect_set("root")).alias("blocked_by"))
    roots = _kept(known.join(roots, "task", "left").select("task", "done", (F.col("blocked") | F.col("blocked_by").isNotNull()).alias("blocked"), "blocked_by"))
    waiting = _kept(roots.filter("NOT done AND NOT blocked").select("task"))
    open_ = _kept(edges.join(waiting, "task", "left_semi"))
    waves, n = [], 0
    while True:
        free = _kept(waiting.join(open_.select("task"), "task", "left_anti").select("task", F.lit(n).alias("wave")))
        if free.isEmpty():
            break
        waves.append(free)
        last = (waiting, open_)
        waiting = _kept(waiting.join(free, "task", "left_anti"))
        open_ = _kept(open_.join(free.select(F.col("task").alias("needs")), "needs", "left_anti").select("task", "needs"))
        _gone(*last)
        n += 1
    when = None
    for w in waves:
        when = w if when is None else when.union(w)
    out = roots.join(when, "task", "left") if when is not None else roots.withColumn("wave", F.lit(None).cast("int"))
    counts = edges.groupBy("task").agg(F.count("*").alias("open_needs"))
    status = F.when(F.col("done"), "done").when(F.col("blocked"), "blocked").when(F.col("wave") == 0, "ready").when(F.col("wave").isNotNull(), "waiting").otherwise("stuck")
    return out.join(counts, "task", "left").select("task", status.alias("status"), "wave", "blocked_by", F.coalesce("open_needs", F.lit(0)).alias("open_needs"))


def settled(states: DataFrame, members: DataFrame, running: DataFrame) -> DataFrame:
    """(campaign, done, ready, complete, quiescent) from ready() and members (campaign, task).

    complete: all tasks are done. quiescent: nothing is ready, nothing of running
    (task) goes on, and not all is done, so that nothing will move by itself.
    """
    rows = members.join(states, "task").join(running.select("task", F.lit(True).alias("runs")).distinct(), "task", "left")
    counts = rows.groupBy("campaign").agg(F.count("*").alias("tasks"), F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "ready").alias("ready"), F.count_if(F.coalesce("runs", F.lit(False))).alias("running"))
    complete = F.col("done") == F.col("tasks")
    return counts.select("campaign", "done", "ready", complete.alias("complete"), (~complete & (F.col("ready") == 0) & (F.col("running") == 0)).alias("quiescent"))
