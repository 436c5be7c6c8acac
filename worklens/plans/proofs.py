"""Queries for proofs, claims, paths and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worklens.operators import ledger, paths, proofs, usage
from worklens.plans import longs, register, table
from worklens.plans.sql import EVENTS, LIVE, MEMBERS, PATHS, TASKS, USAGE, WITNESS, with_
from worklens.sources import bridge

_PROOFS = """,
given AS (SELECT task, attempt, CASE WHEN seq % 7 <> 0 THEN lease_epoch END AS lease_epoch FROM attestations WHERE task % 3 <> 0),
lanes AS (SELECT DISTINCT task, attempt, lease_epoch FROM witness),
n AS (SELECT task, attempt, count(*) AS n_attested FROM (
  SELECT g.task, g.attempt FROM given g JOIN lanes l ON g.task = l.task AND g.attempt = l.attempt AND g.lease_epoch = l.lease_epoch
  UNION ALL SELECT g.task, g.attempt FROM given g SEMI JOIN lanes l ON g.task = l.task AND g.attempt = l.attempt WHERE g.lease_epoch IS NULL) GROUP BY ALL),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task, attempt ORDER BY lease_epoch DESC, seq DESC) AS i FROM witness) WHERE i = 1),
proofs AS (SELECT task, attempt, verdict, seq, coalesce(n_attested, 0) AS n_attested, CASE WHEN verdict <> 'pass' THEN 'not-passing' WHEN n_attested > 0 THEN 'attested' ELSE 'witness-only' END AS status
           FROM last LEFT JOIN n USING (task, attempt))
"""


def _proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = bridge.attestations(spark, sf_dir).filter("task % 3 <> 0").withColumn("lease_epoch", F.when(F.col("seq") % 7 != 0, F.col("lease_epoch")))
    return proofs.proofs(bridge.witness(spark, sf_dir), given)


@register("proofs", with_(WITNESS, USAGE) + _PROOFS + "SELECT * FROM proofs")
def all_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J10, J12."""
    return _proofs(spark, sf_dir)


@register("run_proofs", with_(WITNESS, USAGE, TASKS, MEMBERS) + _PROOFS + """
SELECT run, task, ordinal, attempt, coalesce(status, 'no-witness') AS status FROM (SELECT run, task, min(line) AS ordinal FROM membership GROUP BY ALL) LEFT JOIN proofs USING (task)""")
def run_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J11."""
    return proofs.run_proofs(bridge.membership(spark, sf_dir), _proofs(spark, sf_dir))


@register("dedup_verdicts", with_(WITNESS) + """,
hit AS (SELECT dedup_key, arg_max(lease_epoch, (seq, ledger_id)) AS lease_epoch, arg_max(attempt, (seq, ledger_id)) AS attempt FROM witness WHERE verdict = 'pass' GROUP BY dedup_key)
SELECT p_partkey AS dedup_key,
       CASE WHEN p_partkey % 11 = 0 THEN 'no-key'
            WHEN h.dedup_key IS NULL THEN 'no-prior-pass'
            WHEN p_partkey % 13 = 0 THEN 'no-artifact-evidence'
            WHEN p_partkey % 5 = 0 AND p_partkey % 3 <> p_partkey % 7 THEN 'declared-hash-mismatch'
            WHEN lease_epoch % 3 <> p_partkey % 3 THEN 'witness-hash-mismatch'
            WHEN p_partkey % 2 = 0 AND attempt % 2 <> 0 THEN 'store-paths-mismatch' END AS miss
FROM part LEFT JOIN hit h ON p_partkey = h.dedup_key""")
def dedup_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J9."""
    hash_of = lambda c, n: F.concat(F.lit("sha256:"), F.col(c) % n)
    hit = bridge.witness(spark, sf_dir).filter("verdict = 'pass'").groupBy("dedup_key").agg(F.max_by(F.struct("lease_epoch", "attempt"), F.struct("seq", "ledger_id")).alias("h"))
    keys = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("dedup_key")).join(hit, "dedup_key", "left")
    keys = keys.withColumns({
        "current": hash_of("dedup_key", 3), "declared": F.when(F.col("dedup_key") % 5 == 0, hash_of("dedup_key", 7)), "witnessed": hash_of("h.lease_epoch", 3),
        "paths": F.when(F.col("dedup_key") % 2 == 0, F.array(F.lit("/b"), F.lit("/a"), F.lit("/b"))), "witnessed_paths": F.when(F.col("h.attempt") % 2 == 0, F.array(F.lit("/a"), F.lit("/b"))),
    })
    key = F.when(F.col("dedup_key") % 11 != 0, F.col("dedup_key").cast("string"))
    miss = proofs.dedup_verdict(key, F.col("h").isNotNull(), F.col("dedup_key") % 13 != 0, F.col("current"), F.col("declared"), F.col("witnessed"), F.col("paths"), F.col("witnessed_paths"))
    return keys.select("dedup_key", miss.alias("miss"))


@register("usage_caveats", with_(WITNESS, USAGE, TASKS) + """,
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task, attempt ORDER BY seq DESC, ledger_id DESC) AS n FROM attestations) WHERE n = 1),
r AS (SELECT run, count(*) AS n, count(input_tokens) AS n_in, count(output_tokens) AS n_out, count(*) FILTER (WHERE currency <> 'USD') AS other FROM last JOIN task_rows USING (task) GROUP BY run),
c AS (SELECT run, concat_ws(',', CASE WHEN n_in < n THEN 'input-partial' END, CASE WHEN n_out < n THEN 'output-partial' END, CASE WHEN other > 0 THEN 'other-currency' END) AS caveats FROM r)
SELECT run, caveats, caveats = '' AS complete FROM c""")
def usage_caveats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9."""
    rolled = longs(usage.roll_up(usage.last_attestation(bridge.attestations(spark, sf_dir)).join(bridge.task_rows(spark, sf_dir).select("task", "run"), "task"), "run"))
    rules = {"input-partial": F.col("n_input_tokens") < F.col("attempts"), "output-partial": F.col("n_output_tokens") < F.col("attempts"), "other-currency": F.col("n_other_currency") > 0}
    return proofs.caveats(rolled, rules).select("run", F.array_join("caveats", ",").alias("caveats"), "complete")


@register("compare_summary", with_(WITNESS) + """,
a AS (SELECT task, attempt, max(seq) AS seq FROM witness WHERE task % 10 <> 3 GROUP BY ALL),
b AS (SELECT task, attempt, max(seq) FILTER (WHERE lease_epoch <> 5) AS seq FROM witness WHERE task % 10 <> 4 GROUP BY ALL),
s AS (SELECT CASE WHEN b.task IS NULL THEN 'missing' WHEN a.task IS NULL THEN 'orphan' WHEN a.seq IS DISTINCT FROM b.seq THEN 'differs' ELSE 'agrees' END AS status FROM a FULL JOIN b ON a.task = b.task AND a.attempt = b.attempt),
n AS (SELECT count(*) FILTER (WHERE status = 'agrees') AS agrees, count(*) FILTER (WHERE status = 'differs') AS differs, count(*) FILTER (WHERE status = 'missing') AS missing, count(*) FILTER (WHERE status = 'orphan') AS orphan FROM s)
SELECT *, agrees > 0 AND differs + missing + orphan = 0 AS strict FROM n""")
def compare_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A24."""
    rows = bridge.witness(spark, sf_dir)
    ours = rows.filter("task % 10 <> 3").groupBy("task", "attempt").agg(F.max("seq").alias("seq"))
    theirs = rows.filter("task % 10 <> 4").groupBy("task", "attempt").agg(F.max(F.when(F.col("lease_epoch") != 5, F.col("seq"))).alias("seq"))
    return proofs.compare_summary(ledger.compare_ledgers(ours, theirs, ["task", "attempt"], ["seq"]))


_TRACES = """,
claims AS (SELECT p_partkey AS claim FROM part WHERE p_partkey % 10 <> 0),
traces AS (SELECT dedup_key AS claim, task, task * 1000 + seq AS seq, verdict AS evidence, CASE verdict WHEN 'pass' THEN 'release' WHEN 'failed' THEN 'sitting' ELSE 'note' END AS kind FROM witness WHERE dedup_key % 7 <> 0)
"""


def _traces(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    kind = F.when(F.col("verdict") == "pass", "release").when(F.col("verdict") == "failed", "sitting").otherwise("note")
    rows = bridge.witness(spark, sf_dir).filter("dedup_key % 7 <> 0")
    traces = rows.select(F.col("dedup_key").alias("claim"), "task", (F.col("task") * 1000 + F.col("seq")).alias("seq"), F.col("verdict").alias("evidence"), kind.alias("kind"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("claim")).filter("claim % 10 <> 0"), traces


@register("claim_coverage", with_(WITNESS) + _TRACES + """
SELECT claim, count(task) AS n_rows, string_agg(DISTINCT task::VARCHAR, ',' ORDER BY task::VARCHAR) AS tasks, string_agg(DISTINCT evidence, ',' ORDER BY evidence) AS evidence, count(task) > 0 AS traced
FROM claims LEFT JOIN traces USING (claim) GROUP BY claim""")
def claim_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J31."""
    claims, traces = _traces(spark, sf_dir)
    out = proofs.coverage(claims, traces.withColumn("task", F.col("task").cast("string")))
    return out.withColumns({"tasks": F.array_join("tasks", ","), "evidence": F.array_join("evidence", ",")})


@register("binding_census", with_(WITNESS) + _TRACES + """,
b AS (SELECT claim, CASE task % 3 WHEN 0 THEN 'gate' WHEN 1 THEN 'check' ELSE 'human' END AS kind, CASE task % 3 WHEN 0 THEN 'g' || task % 5 WHEN 1 THEN 'c' || task END AS value FROM traces WHERE task % 40 = 1 OR task % 57 = 0),
r AS (SELECT claim, kind, CASE kind WHEN 'gate' THEN value || ': ' || CASE WHEN value <> 'g3' THEN 'run ' || value ELSE 'unresolved' END WHEN 'check' THEN value END AS says, CASE WHEN kind = 'human' THEN 'HUMAN-ATTENDED' ELSE kind || ': ' || value END AS listed, kind = 'gate' AND value = 'g3' AS lost FROM b),
n AS (SELECT claim, count(*) AS n, min(kind) AS kind, max(says) AS says, string_agg(listed, '; ' ORDER BY listed) AS list, bool_or(lost) AS lost FROM r GROUP BY claim)
SELECT claim, CASE WHEN n IS NULL THEN 'none' WHEN n = 1 THEN kind ELSE n || ' bindings' END AS bound, CASE WHEN n = 1 THEN says WHEN n > 1 THEN list END AS oracle, CASE WHEN n IS NULL THEN 'no-oracle' WHEN n > 1 THEN 'several-oracles' WHEN lost THEN 'unknown-gate' END AS fault FROM claims LEFT JOIN n USING (claim)""")
def binding_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks, gates (one of five isn't declared) and humans."""
    claims, traces = _traces(spark, sf_dir)
    task = F.col("task")
    bindings = traces.filter("task % 40 = 1 OR task % 57 = 0").select("claim", F.when(task % 3 == 0, "gate").when(task % 3 == 1, "check").otherwise("human").alias("kind"), F.when(task % 3 == 0, F.concat(F.lit("g"), task % 5)).when(task % 3 == 1, F.concat(F.lit("c"), task)).alias("value"))
    gates = bindings.filter("kind = 'gate' AND value <> 'g3'").select(F.col("value").alias("gate"), F.concat(F.lit("run "), "value").alias("command")).distinct()
    return proofs.census(claims, bindings, gates)


@register("trace_faults", with_(WITNESS, TASKS) + _TRACES + """,
sat AS (SELECT *, min(seq) FILTER (WHERE kind = 'sitting') OVER (PARTITION BY claim, task) AS sat FROM traces),
ok AS (SELECT task FROM task_rows WHERE run % 6 <> 0),
c AS (SELECT seq, claim, task, unnest(['a' || seq % 3, 'b' || seq % 4]) AS acceptance FROM traces SEMI JOIN ok USING (task))
SELECT 'unknown-claim' AS rule, seq, claim, NULL AS cited FROM traces ANTI JOIN claims USING (claim)
UNION ALL SELECT 'unknown-task', seq, claim, NULL FROM traces ANTI JOIN ok USING (task)
UNION ALL SELECT 'unknown-acceptance', seq, claim, acceptance FROM c WHERE NOT (acceptance = 'a' || task % 3 OR acceptance IN ('b0', 'b1', 'b2'))
UNION ALL SELECT 'missing-evidence', seq, claim, 'f' || claim || '#F' || seq % 5 FROM traces WHERE claim % 11 = 0
UNION ALL SELECT 'missing-anchor', seq, claim, 'f' || claim || '#F' || seq % 5 FROM traces WHERE claim % 11 <> 0 AND seq % 5 = 4
UNION ALL SELECT 'release-without-sitting', seq, claim, NULL FROM sat WHERE kind = 'release' AND NOT coalesce(sat < seq, FALSE)
UNION ALL SELECT 'never-traced', NULL, claim, NULL FROM claims ANTI JOIN traces USING (claim) WHERE claim % 4 <> 1""")
def trace_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row cites two acceptance ids and one finding of a file; a quarter of the claims belongs to an unauthored stage."""
    claims, traces = _traces(spark, sf_dir)
    seq, claim = F.col("seq"), F.col("claim")
    traces = traces.withColumns({"acceptance": F.array(F.concat(F.lit("a"), seq % 3), F.concat(F.lit("b"), seq % 4)), "evidence": F.array(F.concat(F.lit("f"), claim, F.lit("#F"), seq % 5))})
    tasks = bridge.task_rows(spark, sf_dir).filter("run % 6 <> 0").select("task")
    criteria = tasks.select("task", F.explode(F.array(F.concat(F.lit("a"), F.col("task") % 3), F.lit("b0"), F.lit("b1"), F.lit("b2"))).alias("acceptance"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("claim"))
    files = parts.filter("claim % 11 <> 0").select(F.concat(F.lit("f"), "claim").alias("path"), F.lit("F0 F1 F2 F3").alias("body"))
    staged = claims.withColumn("stage", F.concat(F.lit("s"), claim % 4))
    return proofs.trace_faults(staged, tasks, traces, criteria, files, spark.createDataFrame([("s1",)], "stage string"))


_PAIRS = """,
a AS (SELECT task AS key, count(*) AS n, count(DISTINCT lease_epoch % 2) AS kinds FROM witness WHERE task % 9 <> 0 GROUP BY task),
b AS (SELECT task AS key, count(*) AS n, count(DISTINCT verdict) AS kinds FROM witness WHERE task % 8 <> 0 AND attempt < 3 GROUP BY task),
pairs AS (SELECT key, CASE WHEN a.n IS NULL THEN 'brief-missing' WHEN b.n IS NULL THEN 'verdict-missing' WHEN a.kinds > 1 THEN 'briefs-differ' WHEN b.kinds > 1 THEN 'verdicts-differ' ELSE 'paired' END AS outcome FROM a FULL JOIN b USING (key))
"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bridge.witness(spark, sf_dir)
    briefs = rows.filter("task % 9 <> 0").select(F.col("task").alias("key"), (F.col("lease_epoch") % 2).alias("digest"))
    return proofs.paired(briefs, rows.filter("task % 8 <> 0 AND attempt < 3").select(F.col("task").alias("key"), "verdict"))


@register("brief_pairs", with_(WITNESS) + _PAIRS + "SELECT key, outcome FROM pairs")
def brief_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J34."""
    return _pairs(spark, sf_dir)


@register("disagreement_table", with_(WITNESS) + _PAIRS + """,
n AS (SELECT outcome, count(*) AS n FROM pairs GROUP BY outcome), t AS (SELECT *, (SELECT sum(n) FROM n)::BIGINT AS total FROM n),
h AS (SELECT outcome, n, (n * 10000 + total // 2) // total AS h FROM t)
SELECT outcome, n, (h // 100) || '.' || lpad((h % 100)::VARCHAR, 2, '0') || '%' AS rate FROM h""")
def disagreement_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes are few, so their totals are one small partition."""
    n = _pairs(spark, sf_dir).groupBy("outcome").agg(F.count("*").alias("n"))
    from_all = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(from_all).select("outcome", "n", proofs.percent_text(F.col("n"), F.col("total")).alias("rate"))  # one row


@register("trace_lanes", with_(WITNESS, USAGE) + """
SELECT task, attempt, arg_max(input_tokens, seq) FILTER (WHERE input_tokens IS NOT NULL) AS input_tokens, arg_max(output_tokens, seq) FILTER (WHERE output_tokens IS NOT NULL) AS output_tokens,
       arg_max(declared_total, seq) FILTER (WHERE declared_total IS NOT NULL) AS declared_total FROM attestations GROUP BY task, attempt""")
def trace_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J24."""
    return proofs.last_known(bridge.attestations(spark, sf_dir), ["task", "attempt"], "seq", ["input_tokens", "output_tokens", "declared_total"])


@register("trace_availability", with_(WITNESS) + """,
files AS (SELECT task, attempt, max(lease_epoch % 4) * 100 AS n_bytes FROM witness WHERE task % 3 = 0 GROUP BY ALL)
SELECT task, attempt, n_bytes, CASE WHEN n_bytes IS NULL THEN 'no-capture' WHEN n_bytes = 0 THEN 'empty' ELSE 'available' END AS availability
FROM (SELECT DISTINCT task, attempt FROM witness) LEFT JOIN files USING (task, attempt)""")
def trace_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J25."""
    rows = bridge.witness(spark, sf_dir)
    files = rows.filter("task % 3 = 0").groupBy("task", "attempt").agg((F.max(F.col("lease_epoch") % 4) * 100).alias("n_bytes"))
    return proofs.availability(rows, files, ["task", "attempt"])


@register("rebuilt_rows", with_(WITNESS, TASKS, EVENTS, LIVE) + """,
w AS (SELECT task, arg_max(attempt, (attempt, lease_epoch, seq)) AS attempt, arg_max(verdict, (attempt, lease_epoch, seq)) AS verdict FROM witness GROUP BY task),
e AS (SELECT task, arg_max(attempt, (attempt, sequence)) AS attempt, arg_max(event, (attempt, sequence)) AS event FROM lifecycle GROUP BY task)
SELECT task, greatest(w.attempt, e.attempt) AS attempt, coalesce(live.state, verdict, e.event) AS state, CASE WHEN live.task IS NOT NULL THEN 'live' WHEN w.task IS NOT NULL THEN 'witness' ELSE 'lifecycle' END AS source
FROM w FULL JOIN e USING (task) LEFT JOIN live USING (task) WHERE task NOT IN (SELECT task FROM task_rows WHERE run % 4 <> 0)""")
def rebuilt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J35."""
    kept = bridge.task_rows(spark, sf_dir).filter("run % 4 <> 0")
    return proofs.rebuilt_rows(bridge.witness(spark, sf_dir), bridge.lifecycle(spark, sf_dir), bridge.live(spark, sf_dir), kept)


#: Fixed policy of the query: patterns that no task may touch.
FORBIDDEN = ["es/1?", "fr/**", "[a-d]*/*[02468]", "7"]


@register("forbidden_paths", with_(PATHS) + """,
g("glob", re) AS (VALUES ('es/1?', 'es/1[^/]'), ('fr/**', 'fr/.*'), ('[a-d]*/*[02468]', '[a-d][^/]*/[^/]*[02468]'), ('7', '(.*/)?7(/.*)?'))
SELECT page_id, path, "glob" FROM paths, g WHERE regexp_full_match(lower(path), re)""")
def forbidden_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J28, H35."""
    return paths.forbidden(bridge.paths(spark, sf_dir), FORBIDDEN)


_PREFIXES = "list_transform(range(1, len(string_split({0}, '/')) + 1), lambda n: array_to_string(string_split({0}, '/')[1:n], '/'))"


@register("domain_overlaps", with_(PATHS) + f""",
d AS (SELECT DISTINCT lower(path) AS path FROM paths UNION SELECT DISTINCT string_split(lower(path), '/')[1] FROM paths WHERE page_id % 2 = 0)
SELECT a.path AS inner, p AS outer FROM (SELECT path, unnest({_PREFIXES.format("path")}) AS p FROM d) a SEMI JOIN d ON d.path = a.p WHERE a.path <> p""".replace("AS inner", 'AS "inner"').replace("AS outer", 'AS "outer"'))
def domain_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J29."""
    rows = bridge.paths(spark, sf_dir)
    first = rows.filter("page_id % 2 = 0").select(F.split("path", "/")[0].alias("path"))
    return paths.overlaps(rows.select("path").union(first))


@register("outside_domains", with_(PATHS) + f""",
own AS (SELECT page_id, path, lower(path) AS p FROM paths),
allowed AS (SELECT DISTINCT p AS d FROM own WHERE page_id % 3 = 0), protected AS (SELECT DISTINCT string_split(p, '/')[1] AS d FROM own WHERE page_id % 50 = 7),
pre AS (SELECT DISTINCT p, unnest({_PREFIXES.format("p")}) AS d FROM own),
ok AS (SELECT p FROM pre SEMI JOIN allowed USING (d) UNION SELECT unnest({_PREFIXES.format("d")}) FROM allowed),
no AS (SELECT p FROM pre SEMI JOIN protected USING (d) UNION SELECT d FROM protected)
SELECT page_id, path, CASE WHEN p IN (SELECT p FROM no) THEN 'protected' ELSE 'outside' END AS reason FROM own WHERE p IN (SELECT p FROM no) OR p NOT IN (SELECT p FROM ok)""")
def outside_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J30."""
    rows = bridge.paths(spark, sf_dir)
    protected = rows.filter("page_id % 50 = 7").select(F.split("path", "/")[0].alias("path"))
    return paths.outside(rows, rows.filter("page_id % 3 = 0").select("path"), protected)
