"""URL filters, the prefix trie and whitening against brute force, and with odd inputs."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from worklens.llm import queries, trie, urls, whitening

SF = "/root/testdata/sf0.001"
RULES = [("good.org", "/", "allow"), ("bad.org", "/", "block"), ("bad.org", "/ok/", "allow"), ("sub.bad.org", "/ok/no", "block")]


def rules(spark, rows=RULES):
    return spark.createDataFrame(rows, "host string, path string, verdict string")


def pages(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")


def test_hosts_and_paths(spark):
    given = ["http://A.Com/x/?q", "https://b.org?q=1/2", "x://h#a/b", "nothing", None, "", "a://b://c/d", "http:///p", "q?u=http://z.net/a"]
    got = spark.createDataFrame([(i, u) for i, u in enumerate(given)], "i int, u string").select("i", urls.host_of(F.col("u")).alias("h"), urls.path_of(F.col("u")).alias("p")).collect()
    assert [(r.h, r.p) for r in sorted(got)] == [("a.com", "/x/"), ("b.org", ""), ("h", ""), ("", ""), ("", ""), ("", ""), ("b:", "//c/d"), ("", "/p"), ("z.net", "/a")]


def test_longest_rule_wins(spark):
    hosts = ["bad.org", "sub.bad.org", "a.sub.bad.org", "notbad.org", "org", "x.good.org"]
    paths = ["", "/", "/ok", "/ok/", "/ok/no", "/ok/nope"]
    rows = [(f"http://{h}{p}", None) for h in hosts for p in paths]
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(pages(spark, rows), rules(spark)).collect()}
    for i, (url, _) in enumerate(rows):
        host, _, path = url[7:].partition("/")
        path = url[7 + len(host) :]
        fit = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert got[i][0] == (max(fit)[1] if fit else None)
        if fit:
            assert got[i][1] == max(fit)[2]


def brute_scores(nodes, links, damping, rounds=300):
    out, back = defaultdict(dict), defaultdict(dict)
    for (a, b), w in links.items():
        out[a][b] = w
        back[b][a] = w
    hosts = set(nodes) | set(out) | set(back)
    result = []
    for start, flow in (({h: v[0] for h, v in nodes.items()}, out), ({h: v[1] for h, v in nodes.items()}, back)):
        mass = {h: float(start.get(h, 0)) for h in hosts}
        for _ in range(rounds):
            new = {h: (1 - damping) * start.get(h, 0) for h in hosts}
            for h, m in mass.items():
                to = flow.get(h) or {h: 1}
                for t, w in to.items():
                    new[t] += damping * m * w / sum(to.values())
            mass = new
        result.append(mass)
    return result


def test_trust_and_distrust_flow_over_links(spark):
    rng = random.Random(5)
    names = [f"h{i}" for i in range(40)]
    links = {(rng.choice(names), rng.choice(names)): rng.randint(1, 9) for _ in range(120)}
    links |= {("hub", n): 1 for n in names}  # one host links to all
    nodes = {n: (rng.choice([0, 0, 3]), rng.choice([0, 0, 2])) for n in names[:25]}
    trust, distrust = brute_scores(nodes, links, 0.85)
    got = urls.propagate(
        spark.createDataFrame([(h, *v) for h, v in nodes.items()], "host string, trusted long, blocked long"), spark.createDataFrame([(*k, w) for k, w in links.items()], "src string, dst string, pages long"), tolerance=1e-5
    ).collect()
    assert sum(r.trust for r in got) == pytest.approx(sum(v[0] for v in nodes.values()))
    total = sum(sum(v) for v in nodes.values())
    assert all(abs(r.trust - trust[r.host]) < 1e-3 * total and abs(r.distrust - distrust[r.host]) < 1e-3 * total for r in got)
    assert {h for h in trust if trust[h] > 1e-3 * total or distrust[h] > 1e-3 * total} <= {r.host for r in got}


def test_a_farm_that_links_to_blocked_hosts_is_blocked(spark):
    spam = '<A class="x" HREF=http://bad.org/a>x</a><a href="//bad.org/b">y</a><a href="mailto:a@good.org">m</a>'
    kind = '<a href="https://news.net/1"><a href="/own">'
    rows = [(f"http://farm.net/{i}", spam) for i in range(3)] + [(f"http://bad.org/{i}", "") for i in range(40)]
    rows += [(f"http://good.org/{i}", kind) for i in range(20)] + [("http://news.net/1", None), ("http://lone.net/", "<a href='#top'>"), (None, spam), ("no scheme", None)]
    rows += [("http://mixed.net/", spam + '<a href="http://good.org/">')] + [(f"http://mixed.net/{i}", "<a href='/x'>") for i in range(60)]
    df = pages(spark, rows).withColumns({"verdict": F.lit("mine"), "rule": F.lit(1), "n": F.lit("n"), "kind": F.lit("k")})
    out = urls.judge(df, rules(spark))
    assert out.columns == ["page_id", "url", "html", "n", "kind", "host", "path", "rule", "verdict", "trust", "distrust"]
    got = {rows[r.page_id][0]: r for r in out.collect()}
    assert len(got) == len(rows)
    assert got["http://farm.net/0"].verdict == "block" and got["http://farm.net/0"].rule is None
    assert got["http://news.net/1"].verdict == "allow" and got["http://news.net/1"].trust > 0
    assert got["http://lone.net/"].verdict == "allow" and got["http://mixed.net/3"].verdict == "allow"
    assert got[None].verdict == got["no scheme"].verdict == "allow" and got[None].host == ""


def test_urls_without_pages_rules_or_links(spark):
    assert urls.judge(pages(spark, []), rules(spark)).count() == 0
    some = pages(spark, [("http://bad.org/", None)] * 3 + [("http://" + "a." * 5000 + "bad.org/", "<a href=x>" * 20000)])
    assert {r.verdict for r in urls.judge(some, rules(spark)).collect()} == {"block"}
    assert {(r.verdict, r.rule) for r in urls.judge(some, rules(spark, [])).collect()} == {("allow", None)}


def brute_trie(convs):
    """convs: {conv_id: [(role, text), ..]}"""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = {}
    for node, own in members.items():
        under = [n for n in members if n[: len(node)] == node]
        kids = lambda n: sum(len(m) == len(n) + 1 and m[: len(n)] == n for m in members)
        ends = ",".join(map(str, sorted(c for c in own if len(convs[c]) == len(node))))
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in under if n)
        parent = min(members[node[:-1]]) if node else None
        out[node] = (min(own), len(node), parent, len(own), kids(node), sum(not kids(n) for n in under), saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(map(repr, out.values()))


def turns_of(spark, convs, shuffle=True):
    rows = [(c, i, role, text) for c, turns in convs.items() for i, (role, text) in enumerate(turns)]
    random.Random(3).shuffle(rows) if shuffle else None
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def nodes_of(df):
    return sorted(repr(tuple(r)) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


@pytest.mark.parametrize("shard", [300, 2000, 1 << 24])
def test_trie_equals_brute_force(spark, monkeypatch, shard):
    rng = random.Random(shard)
    said = [("user", "a"), ("user", "bé"), ("bot", "a"), ("bot", ""), ("", "bot")]
    convs = {rng.randint(-50, 10**6): [rng.choice(said) for _ in range(rng.randint(1, 6))] for _ in range(120)}
    convs |= {10**7 + i: [said[0], said[1], said[1]] for i in range(90)}  # copies, more than a shard holds
    convs[7] = [said[i % 3] for i in range(60)]
    convs[8] = convs[7][:50] + [said[4]]
    monkeypatch.setattr(trie, "SHARD", shard)
    monkeypatch.setattr(trie, "PIECE", 100)
    assert nodes_of(trie.prefix_trie(trie.conversations(turns_of(spark, convs)))) == brute_trie(convs)


def test_trie_of_odd_conversations(spark):
    rows = [(1, None, "u", "first"), (1, 5, None, None), (1, 5, None, None), (1, 5, "", "x"), (None, 1, "u", "lost"), (2, 1, "u", "first"), (3, 9, "", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"node": F.lit(1), "shard": F.lit(2), "path": F.lit("p")})
    want = {1: [("u", "first"), ("", ""), ("", ""), ("", "x")], 2: [("u", "first")], 3: [("", "")]}
    assert nodes_of(trie.prefix_trie(trie.conversations(df))) == brute_trie(want)
    assert trie.prefix_trie(trie.conversations(df.limit(0))).count() == 0
    long = {1: [("u", "x" * 3_000_000)] + [("u", str(i)) for i in range(3000)], 2: [("u", "x" * 3_000_000)]}
    got = trie.prefix_trie(trie.conversations(turns_of(spark, long))).filter("depth <= 1").orderBy("depth").collect()
    assert [(r.n_convs, r.n_leaves, r.saved_tokens) for r in got] == [(2, 1, 3_000_000)] * 2


def test_trie_query_rebuilds_conversations(spark, tmp_path):
    rng = random.Random(1)
    convs = {c: [(rng.choice("ab"), rng.choice("xyz")) for _ in range(rng.randint(1, 7))] for c in [*range(100, 180), *range(230, 290), 0, 5, -3, -170]}
    turns_of(spark, convs).write.parquet(f"{tmp_path}/conversations.parquet")
    rebuilt = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = convs.get(int(math.trunc(c / 100)) * 100, [])[:h] + own[h:]
    assert any(not v for v in rebuilt.values())
    name = "op12_conversation_prefix_trie"
    got = nodes_of(queries.QUERIES[name](spark, str(tmp_path)))
    assert got == brute_trie(rebuilt)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    cursor = con.execute(f"SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM ({queries.ORACLES[name]})")
    assert sorted(map(repr, cursor.fetchall())) == got


def vectors(spark, rows, kind="array<float>"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"vec_id long, embedding {kind}")


def whitened(df, count=4):
    out = defaultdict(dict)
    for r in df.collect():
        assert r.component not in out[r.vec_id]
        out[r.vec_id][r.component] = r
    return out


def check_whitening(got, given, count=4):
    x = {i: np.floor(np.array(v, np.float32).astype(float) * 256).astype(int) for i, v in given.items()}
    fit = np.unique(np.array(list(x.values())), axis=0)
    n, mean = len(fit), fit.sum(axis=0) / len(fit)
    values, basis = np.linalg.eigh((fit - mean).T @ (fit - mean) / n)
    values, basis = values[::-1][:count], basis[:, ::-1][:, :count]
    assert set(got) == set(x)
    for k in range(len(values)):
        ref = {i: float((v - mean) @ basis[:, k] / math.sqrt(values[k])) for i, v in x.items()}
        sign = math.copysign(1, sum(ref[i] * got[i][k + 1].whitened for i in x))
        for i, v in x.items():
            r = got[i][k + 1]
            assert r.n == n and r.deviation == sum((n * int(e) - int(s)) ** 2 for e, s in zip(v, fit.sum(axis=0)))
            assert r.whitened == pytest.approx(sign * ref[i], abs=1e-8)
            assert r.explained == pytest.approx(values[k] / np.trace((fit - mean).T @ (fit - mean) / n), rel=1e-9)
            assert r.identity_error < 1e-9


@pytest.mark.parametrize("dims,noise", [(64, 0.2), (24, 0.01), (40, 1.0), (5, 0.5)])
def test_whitening_equals_eigendecomposition(spark, dims, noise):
    rng = np.random.default_rng(dims)
    data = rng.normal(size=(300, 3)) @ rng.normal(size=(3, dims)) + noise * rng.normal(size=(300, dims)) + 3
    given = {i: v.tolist() for i, v in enumerate(data)} | {300 + i: data[0].tolist() for i in range(200)}  # copies weigh nothing
    check_whitening(whitened(whitening.whiten(vectors(spark, list(given.values())))), given)


def test_components_by_few_products():
    for seed in range(5):
        rng = np.random.default_rng(seed)
        basis = np.linalg.qr(rng.normal(size=(200, 200)))[0]
        values = np.sort(rng.uniform(0.5, 1.0, 200))[::-1] * 1000
        values[:4] *= [2, 1.6, 1.5, 1.4] if seed % 2 else 1
        matrix = basis * values @ basis.T
        used = []
        got, vec = whitening.top_components(lambda q, m=matrix, u=used: u.append(1) or m @ q, 200, 4)
        assert np.allclose(got, values[:4], rtol=1e-12) and len(used) < 600
        assert np.allclose(np.abs((vec * basis[:, :4]).sum(axis=0)), 1, atol=1e-12)


def test_whitening_of_odd_vectors(spark):
    rows = [[1.0, 2.0], None, [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [], [1.0], [1.0, 2.0], [-0.0, 0.5], [3.0, -1.0]]
    df = vectors(spark, rows).withColumns({"x": F.lit("mine"), "n": F.lit("mine"), "label": F.col("vec_id") * 2})
    out = whitening.whiten(df)
    assert out.columns == ["vec_id", "label", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = whitened(out)
    check_whitening(got, {i: rows[i] for i in (0, 7, 8, 9)}, 2)
    same = whitened(whitening.whiten(vectors(spark, [[1.0, 2.0, 3.0]] * 3)))
    assert {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for v in same.values() for r in v.values()} == {(1, 0, None, None, None)} and len(same[2]) == 3
    pair = whitened(whitening.whiten(vectors(spark, [[1.0, 2.0, 3.0], [2.0, 2.0, 3.0]])))
    assert sorted((r.component, r.whitened and round(abs(r.whitened), 9)) for r in pair[0].values()) == [(1, 1.0), (2, None), (3, None)]
    assert whitening.whiten(vectors(spark, [])).count() == 0
    huge = whitened(whitening.whiten(vectors(spark, [[1e12, 0.0], [-1e12, 1.0]], "array<double>")))
    assert huge[0][1].deviation is None and abs(huge[0][1].whitened) == pytest.approx(1)


@pytest.mark.parametrize("name", ["op11_link_propagated_urls", "op12_conversation_prefix_trie", "op13_chebyshev_whitening"])
def test_new_queries_keep_their_contracts(spark, name):
    out = queries.QUERIES[name](spark, SF)
    want = {
        "op11": "page_id:bigint host:string path:string rule:string verdict:string", "op12": "conv_id:bigint depth:bigint parent_conv_id:bigint n_convs:bigint n_children:bigint n_leaves:bigint saved_tokens:bigint ends_sha256:string",
        "op13": "vec_id:bigint component:int n:bigint deviation:bigint whitened:double explained:double identity_error:double",
    }[name[:4]]
    assert [f"{c}:{t}" for c, t in out.dtypes] == want.split()
    con = duckdb.connect()
    for t in ("pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    if name in queries.ORACLES:
        cursor = con.execute(f"SELECT {', '.join(out.columns)} FROM ({queries.ORACLES[name]})")
        assert sorted(map(repr, cursor.fetchall())) == sorted(repr(tuple(r)) for r in out.collect())
    else:
        check_whitening(whitened(out), dict(con.execute("SELECT vec_id, embedding FROM embeddings").fetchall()))
