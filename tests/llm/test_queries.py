"""The registered queries and the pipeline: whole tables, contract columns, SQL twins, brute-force versions."""

import math
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from worklens.llm import language, queries, sharding, simhash

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_cross_polytope_neighbours": "query_id:bigint rank:int vec_id:bigint score:double",
    "op2_token_counts": "doc_id:bigint n_bytes:bigint n_tokens:bigint over_limit:boolean",
    "op3_context_mixing_scores": "doc_id:bigint held_out:boolean n_tokens:bigint n_known:bigint train_tokens:bigint base_score:double score:double",
    "op4_prefix_free_parsing": "doc_id:bigint n_bytes:bigint n_removed:bigint n_spans:bigint kept_sha256:string",
    "op5_ring_shards": "doc_id:bigint size:bigint text_crc32:bigint law:string shard:int slot:bigint grown_shard:int",
    "op6_source_mix": "doc_id:bigint size:bigint source_size:bigint target:double taken:bigint",
    "op7_language_bitmask_filters": "doc_id:bigint held_out:boolean lang_pred:string score:double",
    "op8_gray_order_simhash": "doc_id:bigint fingerprint:string component_id:bigint",
    "op9_suffix_automaton_decontamination": "doc_id:bigint n_words:bigint n_hit:bigint n_items:bigint items_sha256:string contaminated:boolean",
    "op10_line_dedup": "doc_id:bigint n_lines:bigint n_dropped:bigint kept_sha256:string",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in "documents embeddings benchmark pages conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", list(COLUMNS))
def test_query_keeps_its_contract(spark, duck, name):
    out = queries.QUERIES[name](spark, SF)
    types = dict(out.dtypes)
    for column in COLUMNS[name].split():
        c, kind = column.split(":")
        assert types[c] == kind, (name, c, types[c])
    rows = out.collect()
    if name.startswith("op1_"):
        vectors = {i: np.array(v, float) for i, v in duck.execute("SELECT vec_id, embedding FROM embeddings").fetchall()}
        ids = sorted(vectors)
        x = np.array([vectors[i] for i in ids])
        found = 0
        for q in (i for i in ids if i % 20 == 0):
            score = {i: s for i, s in zip(ids, (x @ vectors[q]).tolist()) if i != q}
            mine = sorted((r.rank, r.vec_id, r.score) for r in rows if r.query_id == q)
            assert [m[0] for m in mine] == list(range(1, 21)) and all(abs(s - score[v]) < 1e-9 for _, v, s in mine)
            found += len({v for _, v, _ in mine} & set(sorted(score, key=lambda i: (-score[i], i))[:20]))
        assert found >= 0.9 * len(rows)
    else:
        want = sorted(r[0] for r in duck.execute("SELECT doc_id FROM documents").fetchall())
        assert sorted(r.doc_id for r in rows) == want


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_its_sql(spark, duck, name):
    cursor = duck.execute(queries.ORACLES[name])
    names = [c[0] for c in cursor.description]
    plain = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    want = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cursor.fetchall()), key=str)
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted((tuple(plain(r[c]) for c in sorted(names)) for r in got.collect()), key=str) == want


def slow_ring(rows, nodes_at, shards, slack):
    """rows (key, at, salt, size) to shards: clockwise from its cell each row goes to the first shard with room."""
    cells = sharding.CELLS
    load = [0] * cells
    for _, at, _, size in rows:
        load[(at % (1 << 64)) >> (64 - sharding.CELL_BITS)] += size
    order = []
    for c in range(cells):
        met = sorted((min((n - c) % cells for n, s in nodes_at if s == shard), shard) for shard in range(shards))
        order.append([s for _, s in met])
    most = math.ceil(sum(load) * (1 + slack) / shards)
    full, left, stretches = [0] * shards, list(load), [[] for _ in range(cells)]
    for r in range(shards):
        for c in range(cells):
            s = order[c][r]
            take = min(left[c], most - full[s])
            if take > 0:
                begin = load[c] - left[c]
                stretches[c].append((begin, begin + take, s))
                full[s] += take
                left[c] -= take
    out, done = {}, [0] * cells
    for key, at, _, size in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        c = (at % (1 << 64)) >> (64 - sharding.CELL_BITS)
        middle = done[c] + size / 2
        out[key] = next(s for a, b, s in stretches[c] if a <= middle < b)
        done[c] += size
    return out


def test_ring_against_one_row_after_the_other(spark):
    rows = [(i, f"text {i // 3} " + "x" * (i * 37 % 90)) for i in range(900)] + [(2000 + i, "hot " * 20) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keys = docs.select("doc_id", F.xxhash64("text"), F.pmod(F.xxhash64(F.lit("salt"), "doc_id"), F.lit(64)).cast("int"), F.octet_length("text") + 1).collect()
    shard = F.floor(F.col("id") / 64).cast("int")
    nodes = spark.range(5 * 64).select(F.pmod(F.xxhash64(F.lit("node"), shard, F.col("id") % 64), F.lit(sharding.CELLS)), shard).collect()
    got = {r.doc_id: r.shard for r in sharding.shard(docs, shards=5).collect()}
    want = slow_ring([tuple(r) for r in keys], [tuple(r) for r in nodes], 5, 0.001)
    assert got == want
    size = {i: len(x) + 1 for i, x in rows}
    total, loads = sum(size.values()), [sum(size[i] for i, s in got.items() if s == k) for k in range(5)]
    assert max(loads) <= 1.001 * total / 5 + max(size.values())
    grown = {r.doc_id: r.shard for r in sharding.shard(docs, shards=6).collect()}
    stayed = sum(size[i] for i in got if got[i] == grown[i])
    assert stayed > 0.5 * total  # tight loads push on; a plain hash modulo the shards would leave a sixth


def test_languages_against_exact_sets(spark, duck):
    rows = duck.execute("SELECT doc_id, text, lang FROM documents").fetchall()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learn = df.filter(~queries.held_out(5))
    filters = language.learn(learn)

    def grams(text):
        codes = language._codes([text.replace("\x00", " ")])[0].tolist()
        return [tuple(codes[i : i + 4]) for i in range(len(codes) - 3) if all(codes[i + 1 : i + 3]) and (codes[i] or codes[i + 3])]

    held, texts = {}, {}
    for r in learn.select("lang", "text").distinct().collect():
        if r.lang is not None and r.text is not None:
            texts[r.lang] = texts.get(r.lang, 0) + 1
            for g in set(grams(r.text)):
                held[r.lang, g] = held.get((r.lang, g), 0) + 1
    exact = {k for k, n in held.items() if n >= max(1, 0.02 * texts[k[0]])}
    assert filters.languages == sorted(texts)
    sure = right = 0
    for (i, text, _), r in zip(rows, language.identify(df, filters).collect()):
        hits = sorted(((sum((x, g) in exact for g in grams(text or "")), x) for x in texts), reverse=True)
        if hits[0][0] > 1.1 * hits[1][0] + 3:  # else false positives may decide
            sure, right = sure + 1, right + (r.lang_pred == hits[0][1])
    assert sure > 150 and right == sure


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())


def test_pipeline_stage_by_stage(spark, duck):
    docs = queries.documents(spark, SF)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_copies", "benchmark", "mix", "shards"]
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(stage(spark, tables[-1], SF).cache())
        if name != "shards":
            assert tables[-1].columns == docs.columns
    given, spoken, alone, clean, mixed, placed = [t.collect() for t in tables]
    pred = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, language.learn(docs.filter(~queries.held_out(5)))).collect()}
    least = corpus_pipeline.LEAST_LIFT / len(language.learn(docs.filter(~queries.held_out(5))).languages)
    few = lambda x: sum(map(str.isalpha, x or "")) < corpus_pipeline.FEW_LETTERS
    assert sorted(r.doc_id for r in spoken) == sorted(r.doc_id for r in given if pred[r.doc_id][0] != language.UNKNOWN and (pred[r.doc_id][1] >= least or few(r.text)))
    assert len(spoken) > 0.95 * len(given)
    # near copies: the groups of exact pairwise distances of the fingerprints
    codes = {r.text: np.frombuffer(simhash.wide_fingerprint((r.text or "").encode(), 5), np.uint64) for r in spoken}
    each = list(codes)
    near = np.bitwise_count(np.array([codes[x] for x in each])[:, None] ^ np.array([codes[x] for x in each])[None]).sum(axis=2) <= int(0.168 * 512)
    group = simhash._join(np.arange(len(each)), *np.nonzero(near))
    first = {}
    for r in spoken:
        g = group[each.index(r.text)]
        first[g] = min(r.doc_id, first.get(g, r.doc_id))
    assert sorted(r.doc_id for r in alone) == sorted(first.values())
    # benchmark: what stays holds no window of any item, and only passages went
    split = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = set()
    for (text,) in duck.execute("SELECT text FROM benchmark").fetchall():
        w = split(text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(0, len(w) - 9))} or ({tuple(w)} if w else set())
    sizes = {len(w) for w in windows}
    before = {r.doc_id: r.text for r in alone}
    for r in clean:
        w = split(before[r.doc_id])
        hit = [False] * len(w)
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit[i : i + n] = [True] * n
        assert split(r.text) == [x for x, h in zip(w, hit) if not h] or any(hit)
        assert len(split(r.text)) == hit.count(False) and sum(hit) <= corpus_pipeline.MOST_CONTAMINATED * len(w)
    gone = set(before) - {r.doc_id for r in clean}
    assert len(gone) < 0.1 * len(before)
    # mix: words of each source near its target, rows as they were
    had = {r.doc_id: r for r in clean}
    assert all(r == had[r.doc_id] for r in mixed)
    total, source = sum(len(words(r.text)) for r in clean), {}
    for r in clean:
        source[r.source] = source.get(r.source, 0) + len(words(r.text))
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(source))}
    stopped, target = set(), {}
    while True:
        rest, free = total - sum(3 * source[s] for s in stopped), [s for s in source if s not in stopped]
        target = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free} | {s: 3.0 * source[s] for s in stopped}
        above = {s for s in free if target[s] > 3 * source[s]}
        if not above:
            break
        stopped |= above
    for s in source:
        assert abs(sum(len(words(r.text)) for r in mixed if r.source == s) - target[s]) <= 2 * max(len(words(r.text)) for r in clean if r.source == s) + 3
    # shards: every row of the mix once, gapless
    assert sorted(r.doc_id for r in placed) == sorted(r.doc_id for r in mixed)
    for s in range(8):
        assert sorted(r.slot for r in placed if r.shard == s) == list(range(sum(r.shard == s for r in placed)))


def test_pipeline_of_odd_rows(spark):
    """Nulls in any column, empty and long texts, repeats and an empty table pass each stage without a crash."""
    odd = "doc_id long, text string, lang string, source string, n_chars int, score string"
    rows = [(1, None, None, None, None, "x"), (None, "some words of a text", "en", None, 1, None), (2, "", "en", "a", 0, ""), (3, "long " * 20_000, None, "a", 5, ""), (4, "same text in here", "en", "b", 1, ""), (4, "same text in here", "en", "b", 1, ""), (5, "\n \t", "de", "b", 3, "")]
    for df in (spark.createDataFrame(rows, odd), spark.createDataFrame([], odd)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, SF)
            assert out.count() <= 3 * df.count()
            if name != "shards":
                assert out.columns == df.columns
