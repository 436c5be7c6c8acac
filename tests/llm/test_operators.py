"""The operators against brute force on small tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from worklens.llm import common, components, contamination, language, lines, mixing, neighbours, overlap, sharding, simhash, tokens

DOCS = "doc_id long, text string, lang string, source string, n_lines int"
ODD = [
    (7, None, "en", "b", 1), (8, "", None, "b", 1), (9, "\n\n", "en", None, 1), (10, "Same line\nother  \n\tSAME LINE", "fr", "a", 1),
    (10, "Same line\nother  \n\tSAME LINE", "fr", "a", 1), (None, "Same line", "de", "c", 1), (11, "ÄÖ same\nsame line" + " long" * 5000, "de", "c", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    words = ["alpha", "beta", "Gamma", "delta,", "the", "of"]
    rows = [(100 + i, "\n".join(" ".join(rng.choices(words, k=rng.randint(0, 9))) for _ in range(rng.randint(1, 5))), rng.choice(["en", "de"]), rng.choice("aaab"), i) for i in range(120)]
    rows += [(1000 + i, "hot text\nsame line", "en", "a", i) for i in range(60)]
    return spark.createDataFrame(ODD + rows, DOCS).repartition(5).cache()


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_lines(spark, docs):
    out = lines.drop_common_lines(docs, min_docs=10)
    rows = docs.collect()
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(common.BLANKS))
    seen = {}
    for r in rows:
        for k in {key(x) for x in (r.text or "").split("\n")}:
            seen[k] = seen.get(k, 0) + 1
    want = []
    for r in rows:
        all_lines = (r.text or "").split("\n")
        kept = [x for x in all_lines if not key(x) or seen[key(x)] < 10]
        want.append((r.doc_id, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    order = lambda x: tuple(map(str, x))
    assert sorted([(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in out.collect()], key=order) == sorted(want, key=order)
    assert lines.drop_common_lines(empty(spark)).count() == 0


def test_mix(spark, docs):
    sized = docs.withColumns({"size": common.word_count(F.col("text")), "tie": F.xxhash64("text"), "target": F.lit("clash")})
    out = mixing.systematic_mix(sized).collect()
    assert len(out) == docs.count()
    total = sum(r.size for r in out)
    names = sorted({r.source for r in out if r.source is not None}) + [None]
    size = {s: sum(r.size for r in out if r.source == s) for s in names}
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    stopped = set()
    while True:  # share the excess again until none is above
        rest = total - sum(3 * size[s] for s in stopped)
        free = [s for s in names if s not in stopped]
        target = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free} | {s: 3.0 * size[s] for s in stopped}
        above = {s for s in free if target[s] > 3 * size[s]}
        if not above:
            break
        stopped |= above
    for s in names:
        mine = [r for r in out if r.source == s]
        assert all(r.target == pytest.approx(target[s]) and r.source_size == size[s] and 0 <= r.copies <= 3 for r in mine)
        assert abs(sum(r.copies * r.size for r in mine) - target[s]) <= 2 * max(r.size for r in mine) + 3
    again = mixing.systematic_mix(sized.repartition(3)).collect()
    pick = lambda rows: sorted((str(r.doc_id), r.size, r.copies) for r in rows)
    assert pick(again) == pick(out)
    assert mixing.systematic_mix(empty(spark).withColumns({"size": F.lit(1), "tie": F.lit(1)})).count() == 0


def test_shards(spark, docs):
    out = sharding.shard(docs.filter("doc_id <> 11"), shards=4).collect()
    assert len(out) == docs.count() - 2
    loads = [sum(r.size for r in out if r.shard == s) for s in range(4)]
    assert max(loads) - min(loads) <= 2 * max(r.size for r in out) + 0.01 * sum(loads)
    for s in range(4):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert all(r.size == len((r.text or "").encode()) + 1 for r in out)
    assert sharding.shard(empty(spark)).count() == 0
    assert {r.shard for r in sharding.shard(docs, keep_text=False).collect()} == set(range(8))


def test_shards_keep_equal_texts_together(spark):
    rows = [(i, f"text {i // 4} " + "x" * (i // 4 % 50)) for i in range(4000)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    homes = {}
    for r in out:
        homes.setdefault(r.text, set()).add(r.shard)
    assert sum(len(x) > 1 for x in homes.values()) <= 40


def test_tokens(spark, docs, tmp_path):
    import public_tokenizers
    import sentencepiece

    model = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
    piece = sentencepiece.SentencePieceProcessor(model_proto=model)
    cache = f"file://{tmp_path}/cache"
    out = tokens.count_tokens(docs, model, "sentencepiece", cache)
    assert out.count() == docs.count()
    for r in out.collect():
        assert (r.n_bytes, r.n_tokens) == (len((r.text or "").encode()), len(piece.encode(r.text or "")))
        assert r.over_limit == (r.n_tokens > 4096)
    stored = tokens.read_cache(spark, cache)
    assert stored.count() == len({r.text or "" for r in docs.collect()})
    more = docs.union(spark.createDataFrame([(5000, "<s> never seen </s>", "en", "a", 1)], DOCS))
    assert tokens.count_tokens(more, model, "sentencepiece", cache).filter("n_tokens is null").count() == 0
    assert tokens.read_cache(spark, cache).count() == stored.count() + 1
    assert tokens.read_cache(spark, cache).groupBy("digest").count().filter("count > 1").count() == 0
    json = open(public_tokenizers.path("byte_bpe_50k.json"), "rb").read()
    assert tokens.count_tokens(docs, json, "tokenizers", cache).filter("n_tokens is null").count() == 0  # another version
    assert tokens.count_tokens(empty(spark), model, "sentencepiece", cache).count() == 0


def test_languages(spark):
    rng = random.Random(2)
    parts = {"aa": ["tion", "the", "wh"], "bb": ["sch", "ung", "ei"], "cc": ["çon", "é", "aux"]}
    text = lambda x, n: " ".join("".join(rng.choices(parts[x], k=3)) for _ in range(n))
    rows = [(i, text(x, rng.randint(3, 60)), x) for i, x in enumerate(rng.choices(list(parts), k=600))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = language.learn(df.filter("doc_id % 5 <> 0"), bits=1 << 16)
    assert filters.languages == sorted(parts)
    odd = spark.createDataFrame([(-1, None, None), (-2, "12 % ²", None), (-3, "", "aa"), (-4, "\x00", None)], df.schema)
    out = language.identify(df.union(odd).withColumn("score", F.lit("clash")), filters).collect()
    assert np.mean([r.lang_pred == r.lang for r in out if r.doc_id >= 0 and r.doc_id % 5 == 0]) > 0.97
    assert all(r.lang_pred == "und" and r.score == 0 for r in out if r.doc_id < 0)
    assert all(0 <= r.score <= 1 for r in out)
    nothing = language.learn(df.limit(0))
    assert {r.lang_pred for r in language.identify(df.limit(3), nothing).collect()} == {"und"}
    many = language.Filters([f"l{i}" for i in range(70)], np.zeros((64, 2), np.uint64), 2, 4)
    grams = language.ngrams(language._codes(["hello"])[0], 4)
    for at in language.places(grams[grams > 0], 2, 64):
        many.slots[at, 1] |= np.uint64(1) << np.uint64(5)
    assert many.predict(["hello"])[0][0] == "l69"


def test_languages_are_learned_from_distinct_texts(spark):
    """Copies of one text, many or few, leave the sample of a language as it is."""
    texts = [(f"{'tion the wh' if i % 2 else 'schung ei'}{chr(97 + i // 26)}{chr(97 + i % 26)} more", "aa" if i % 2 else "bb") for i in range(120)]
    once = spark.createDataFrame(texts, "text string, lang string")
    copies = spark.range(20000).select(F.lit(texts[1][0]).alias("text"), F.lit("aa").alias("lang"))
    want, got = (language.learn(df, per_language=40, bits=1 << 12) for df in (once, once.union(copies)))
    assert got.languages == want.languages == ["aa", "bb"] and (got.slots == want.slots).all()


def test_bloom_holds_all(spark):
    grams = np.random.default_rng(1).integers(1, 2**63, 1000).astype(np.uint64)
    f = language.Filters(["a", "b"], np.zeros((1 << 14, 1), np.uint64), 3, 4)
    for at in language.places(grams[:500], 3, 1 << 14):
        np.bitwise_or.at(f.slots[:, 0], at, np.uint64(2))
    assert (f.holders(grams[:500])[:, 0] == 2).all()
    assert (f.holders(grams[500:])[:, 0] == 2).mean() < 0.01


def slow_windows(words, items, window):
    hit, found = set(), set()
    for name, item in items:
        n = min(window, len(item))
        for w in {tuple(item[i : i + n]) for i in range(len(item) - n + 1)} if n else ():
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) == w:
                    hit.update(range(i, i + n))
                    found.add(name)
    return hit, sorted(found)


@pytest.mark.parametrize("most", [10**6, 30])
def test_windows(spark, most):
    rng = random.Random(3)
    make = lambda n: " ".join(rng.choices(["a", "B", "cé", "d9"], k=n))
    items = [(i, make(rng.choice([1, 2, 4, 5, 8, 12]))) for i in range(14) if i != 3] + [(3, None), (50, "..."), (51, "a a a a a a"), (None, "d9 d9 d9 d9 a a")]
    rows = [(i, make(rng.randint(0, 60)) + rng.choice(["", " zz ", "\na.b"])) for i in range(80)] + [(200, None), (201, ""), (201, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("items", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda x: pattern.findall((x or "").translate({c: c + 32 for c in range(65, 91)}))
    named = [("null" if i is None else str(i), split(x)) for i, x in items]
    for r in contamination.find_windows(docs, bench, window=5, most_words=most).collect():
        words = split(r.text)
        hit, found = slow_windows(words, named, 5)
        assert r.n_words == len(words) and r["items"] == found
        assert {i for s in r.spans for i in range(s.start, s.stop)} == hit
    assert contamination.find_windows(docs, bench.limit(0)).filter("size(spans) > 0").count() == 0
    assert contamination.find_windows(docs.limit(0), bench).count() == 0


def test_decontaminate(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, "keep é this. " + passage.upper() + "! and that, it is long enough to stay here with us"), (2, passage + " x"), (3, "clean"), (4, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    got = {r.doc_id: r.text for r in contamination.decontaminate(docs, bench).collect()}
    assert got == {1: "keep é this. ! and that, it is long enough to stay here with us", 3: "clean", 4: None}


def slow_fingerprint(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(codes, distance):
    root = {c: c for c in codes}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    for i, a in enumerate(codes):
        for b in codes[:i]:
            if bin(a ^ b).count("1") <= distance:
                root[find(a)] = find(b)
    return {c: find(c) for c in codes}


def test_simhash(spark, docs):
    rows = docs.collect()
    out = simhash.near_groups(docs).collect()
    code = {(r.doc_id, r.text): slow_fingerprint(r.text, 4) for r in rows}
    group = groups_of(sorted(set(code.values())), 4)
    least = {}
    for (i, _), c in code.items():
        if i is not None:
            least[group[c]] = min(i, least.get(group[c], i))
    want = sorted((str(r.doc_id), code[r.doc_id, r.text], least.get(group[code[r.doc_id, r.text]])) for r in rows)
    assert sorted((str(r.doc_id), r.code % (1 << 64), r.component_id) for r in out) == want
    kept = simhash.keep_one(docs, simhash.near_groups(docs)).collect()
    lone = len(set(group.values())) - len(least)  # groups without any doc_id keep a row too
    assert sorted(str(r.doc_id) for r in kept) == sorted([*map(str, least.values()), *["None"] * lone]) and kept[0].asDict().keys() == rows[0].asDict().keys()
    assert simhash.near_groups(empty(spark)).count() == 0 and simhash.keep_one(empty(spark), simhash.similar_groups(empty(spark))).count() == 0


@pytest.mark.parametrize("most", [4096, 8])
def test_near_links(spark, most):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(40)]
    codes = set(base)
    for _ in range(600):
        c = rng.choice(base)
        for b in rng.sample(range(64), rng.randint(1, 6)):
            c ^= 1 << b
        codes.add(c)
    codes = sorted(codes)
    df = spark.createDataFrame([(simhash._signed(c),) for c in codes], "code long")
    got = {r.node: r.root for r in components.connected_components(simhash.near_links(df, most=most)).collect()}
    want = groups_of(codes, 4)
    sides = lambda m: {frozenset(c for c in codes if m(c) == r) for r in {m(c) for c in codes}}
    assert sides(lambda c: got.get(simhash._signed(c), simhash._signed(c))) == sides(want.get)


def test_similar_groups(spark, docs):
    """Copies with few changed words join their original, unlike texts and halves don't, odd rows have groups."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(3000)]
    rows, of = [], {}
    for i in range(60):
        base = rng.choices(words, k=rng.choice([120, 400, 1500]))
        for j in range(6):
            mine = list(base)
            for at in rng.sample(range(len(mine)), len(mine) // 90 if j else 0):  # about 5 % of the shingles: similarity 0.9
                mine[at] = rng.choice(words)
            of[100 * i + j] = 100 * i
            rows.append((100 * i + j, " ".join(mine), "en", "a", 1))
        of[100 * i + 9] = 100 * i + 9
        rows.append((100 * i + 9, " ".join(base[: len(base) // 2]), "en", "a", 1))
    found = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, DOCS)).collect()}
    assert found == of
    odd = simhash.similar_groups(docs).collect()
    assert sorted(str(r.doc_id) for r in odd) == sorted(str(r.doc_id) for r in docs.select("doc_id").collect())
    assert {r.component_id for r in odd if r.doc_id in (7, 8, 9)} == {7} and {r.component_id for r in odd if (r.doc_id or 0) >= 1000} == {1000}


def test_similar_groups_are_whole(spark):
    """Every pair alike by 0.8 or more is in one group, also those that differ in more bits than link; a changed block moves a fingerprint more than spread words."""
    rng = random.Random(17)
    words, rows = [f"w{i}" for i in range(3000)], []
    licence = rng.choices(words, k=60)
    for i in range(250):
        base = rng.choices(words, k=rng.choice([4, 5, 6, 9, 24, 60, 300]))
        if i % 5 == 0:
            base = licence[: rng.randint(40, 60)] + base[: rng.randint(2, 20)]  # frequent shingles
        cut = len(base) - max(1, len(base) // 9)
        rows += [(10 * i, " ".join(base)), (10 * i + 1, " ".join(base[:cut] + rng.choices(words, k=len(base) // 9 - rng.randint(0, 2)))), (10 * i + 2, " ".join(base + base[: len(base) // 5])), (10 * i + 3, " ".join(base[:cut]))]
    sets = {i: set(simhash.shingle_hashes(x.encode(), 5).tolist()) for i, x in rows}
    found = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    codes = {i: np.frombuffer(simhash.wide_fingerprint(x.encode(), 5), np.uint64) for i, x in rows}
    pairs = [(a, b) for n, a in enumerate(sets) for b in list(sets)[:n] if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))]
    assert sum(np.bitwise_count(codes[a] ^ codes[b]).sum() > 86 for a, b in pairs) > 5
    assert all(found[a] == found[b] for a, b in pairs)
    near = [(a, b) for n, a in enumerate(sets) for b in list(sets)[:n] if np.bitwise_count(codes[a] ^ codes[b]).sum() <= 86]
    place = {i: n for n, i in enumerate(sets)}
    parent = simhash._join(np.arange(len(place)), *np.array([(place[a], place[b]) for a, b in pairs + near]).T)
    assert all(found[i] == list(sets)[parent[n]] for i, n in place.items())  # and nothing else is


@pytest.mark.parametrize("part", [2048, 3])
def test_missed_pairs_hold_all_that_are_alike(spark, monkeypatch, part):
    monkeypatch.setattr(overlap, "PART", part)
    rng = np.random.default_rng(18)
    base = [rng.integers(0, 1 << 40, n).astype(np.uint64) for n in rng.integers(1, 40, 60)]
    sets = [np.unique(np.concatenate([b[rng.random(len(b)) < 0.95], rng.integers(0, 50, rng.integers(0, 4)).astype(np.uint64)])) for b in base for _ in range(5)]
    hot = np.arange(40, dtype=np.int64)[::-1]
    rows = [(i, n, prefix.tolist(), i) for i, (_, n, prefix) in enumerate(map(overlap.Prefixes(hot).of, sets))]
    df = spark.createDataFrame(rows, "sid long, n int, prefix array<long>, root long")
    found = {tuple(r) for r in overlap.missed_pairs(df.select("sid", "prefix"), df.select("sid", "n", "root")).collect()}
    want = {(a, b) for b in range(len(sets)) for a in range(b) if 9 * len(np.intersect1d(sets[a], sets[b])) >= 4 * (len(sets[a]) + len(sets[b])) > 0}
    assert len(want) > 50 and want <= found and len(found) < 2 * len(want)


@pytest.mark.parametrize("most", [4096, 150])
def test_wide_links(spark, most):
    """One crowded group: what the bands and finer bands find connects all that pairs within the distance connect."""
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, (40, simhash.WORDS)).astype(np.uint64)
    codes = base[np.minimum(39, rng.integers(0, 80, 1200))].copy()
    for row in codes:
        for b in rng.integers(0, 64 * simhash.WORDS, 20):
            row[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    df = spark.createDataFrame([(i, bytearray(c.tobytes())) for i, c in enumerate(codes)], "node long, wide binary")
    got = {r.node: r.root for r in components.connected_components(simhash.wide_links(df, 86, most=most)).collect()}
    apart = np.bitwise_count(codes[:, None] ^ codes[None]).sum(axis=2) <= 86
    parent = simhash._join(np.arange(len(codes)), *np.nonzero(apart))
    assert [got.get(i, i) for i in range(len(codes))] == parent.tolist()


@pytest.mark.parametrize("most", [4096, 1])
def test_wide_links_find_lone_pairs_in_any_bucket(spark, most):
    rng = np.random.default_rng(10)
    first = rng.integers(0, 1 << 63, (600, simhash.WORDS)).astype(np.uint64)
    second = first.copy()
    for row in second:
        for b in rng.choice(64 * simhash.WORDS, 77, replace=False):  # 15.1 %: similarity 0.8
            row[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    df = spark.createDataFrame([(i, bytearray(c.tobytes())) for i, c in enumerate(np.concatenate([first, second]))], "node long, wide binary")
    found = {(min(r), max(r)) for r in simhash.wide_links(df, 86, most=most).collect()}
    assert len(found & {(i, 600 + i) for i in range(600)}) / 600 >= 0.97 and all(b - a == 600 for a, b in found)


@pytest.mark.parametrize("count", [10**4, 10**7, 10**9])
def test_bands_find_pairs_for_any_number_of_codes(count):
    rng = np.random.default_rng(12)
    bands = simhash._bands(count)
    differs = np.stack([np.isin(np.arange(512), rng.choice(512, 77, replace=False)) for _ in range(4000)]).reshape(4000, 128, 4).any(axis=2)
    assert np.mean(np.any([~differs[:, at].any(axis=1) for at in bands], axis=0)) >= 0.98 and count / 16 ** len(bands[0]) <= 1000


@pytest.mark.parametrize("count", [None, 10**7, 10**9])
def test_wide_links_do_not_depend_on_the_number_of_codes(spark, monkeypatch, count):
    """Pairs at the very limit: those that agree in a band are linked, and no others, however many codes there are."""
    rng = np.random.default_rng(14)
    first = rng.integers(0, 1 << 63, (500, simhash.WORDS)).astype(np.uint64)
    second = first.copy()
    for row in second:
        for b in rng.choice(64 * simhash.WORDS, 86, replace=False):
            row[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    df = spark.createDataFrame([(i, bytearray(c.tobytes())) for i, c in enumerate(np.concatenate([first, second]))], "node long, wide binary")
    differs = np.array([[x != y for x, y in zip(a.tobytes().hex(), b.tobytes().hex())] for a, b in zip(first, second)])
    meet = np.any([~differs[:, at].any(axis=1) for at in simhash._bands(10**4)], axis=0)
    if count:
        monkeypatch.setattr(type(df), "count", lambda self: count)
    found = {(min(r), max(r)) for r in simhash.wide_links(df, 86).collect()}
    assert found == {(i, 500 + i) for i in np.flatnonzero(meet).tolist()} and meet.mean() >= 0.99


def test_wide_bucket_connects_what_pairs_connect():
    rng = np.random.default_rng(13)
    codes = rng.integers(0, 1 << 63, (30, simhash.WORDS)).astype(np.uint64)[rng.integers(0, 30, 900)]
    for row in codes:
        for b in rng.integers(0, 512, rng.integers(40, 75)):
            row[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    near = np.nonzero(np.bitwise_count(codes[:, None] ^ codes[None]).sum(axis=2) <= 86)
    want = simhash._join(np.arange(900), *near)
    got = simhash._join(np.arange(900), *simhash._wide_bucket_links(codes, 86))
    assert (got == want).all() and 30 < len(set(want.tolist())) < 900


def test_gray_index():
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 1 << 20, 1500).astype(np.uint64)  # crowded
    rank = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    codes = np.unique(codes[np.argsort(rank)])
    for d in (0, 1, 2):
        a, b = simhash.bucket_links(codes, d)
        parent = dict(zip(a.tolist(), b.tolist()))
        want = groups_of(codes.tolist(), d)
        assert len({(parent.get(c, c), want[c]) for c in codes.tolist()}) == len(set(want.values())) == len({parent.get(c, c) for c in codes.tolist()})


def test_components(spark):
    rng = random.Random(6)
    pairs = [(i, i + 1) for i in range(60)] + [(1000, 2000 + i) for i in range(50)] + [(5, 5)] + [(rng.randint(3000, 3100), rng.randint(3000, 3100)) for _ in range(60)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {x: x for p in pairs for x in p}
    for _ in range(80):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if any(x in p and p[0] != p[1] for p in pairs)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("unit", [True, False])
def test_neighbours(spark, unit):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1500, 24))
    x = x / np.linalg.norm(x, axis=1, keepdims=True) if unit else x
    x[700:900] = x[40]
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(x.astype(np.float32))]
    bad = [(5000, None, ""), (5020, [0.0] * 24, ""), (5040, [float("nan")] * 24, ""), (5060, [1.0] * 3, ""), (5080, [None] + [1.0] * 23, ""), (None, [1.0] * 24, ""), (5100, [], "")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, score string")
    out = neighbours.nearest(df, tables=8, leaf=16, chunk=400).collect()
    x = x.astype(np.float32).astype(float)
    score = x @ x.T
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 1500, 20))
    right = 0
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, 21)) and all(v != q and abs(s - score[q, v]) < 1e-9 for _, v, s in found)
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        best = sorted((-round(score[q, v], 9), v) for v in range(1500) if v != q)[:20]
        right += len({v for _, v in best} & {v for _, v, _ in found})
    assert right / (20 * len(got)) >= 0.9
    assert [v for _, v, _ in got[40]] == list(range(700, 720)) and [v for _, v, _ in got[720]][:3] == [40, 700, 701]
    assert neighbours.nearest(df.limit(0)).count() == 0


@pytest.mark.parametrize("size, dims, spread", [(4000, 64, 0.5), (4000, 256, 0.0), (3000, 128, 0.5)])
def test_neighbours_of_uneven_norms_and_many_dimensions(spark, size, dims, spread):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(size, dims))
    x = x / np.linalg.norm(x, axis=1, keepdims=True) * rng.lognormal(0, spread, (size, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    score = x @ x.T
    np.fill_diagonal(score, -np.inf)
    want = {q: set(np.argsort(-score[q])[:20].tolist()) for q in range(0, size, 20)}
    assert np.mean([len(want[q] & got.get(q, set())) / 20 for q in want]) >= 0.9


@pytest.mark.parametrize("worth", [0.0, 0.8])
def test_neighbours_of_equal_scores_go_to_the_smaller_id(spark, monkeypatch, worth):
    monkeypatch.setattr(neighbours, "WORTH", worth)  # at 0 all is compared whole
    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, (900, 8)).astype(float)
    ids = rng.permutation(5000)[: len(x)]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df, leaf=4, chunk=300).collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    zero = ~x.any(axis=1)
    total = right = 0
    for i, v in zip(ids, x):
        if i % 20 == 0 and v.any():
            want = sorted((-float(s), int(j)) for j, s, z in zip(ids, x @ v, zero) if j != i and not z)[:20]
            mine = sorted(got[int(i)])
            assert got[int(i)] == mine and len(mine) == 20  # nearest first, ties to the smaller id
            total, right = total + 20, right + len(set(mine) & set(want))
            assert worth or mine == want
    assert right >= 0.9 * total


def test_neighbours_choose_tables_and_slack_by_band(spark):
    """Groups of like directions in two bands of norms: small parts of each band find nearly all."""
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(60, 128)), 30, axis=0) + rng.normal(size=(1800, 128)) * 0.3
    x = x / np.linalg.norm(x, axis=1, keepdims=True) * np.repeat(np.where(np.arange(60) % 2, 1.0, 5.0), 30)[:, None]
    classes = spark.createDataFrame([(i, v.tolist(), i % 20 == 0) for i, v in enumerate(x)], "class long, v array<double>, asks boolean")
    q, i, near = neighbours._sampled_pairs(classes, 20)
    assert len(q) == 90 and (np.bincount(i) == 20).all()
    score = x @ x.T
    np.fill_diagonal(score, -np.inf)
    best = np.sort(score, axis=1)[:, ::-1][:, :20]
    at = [int(np.flatnonzero((np.abs(x - v) < 1e-12).all(axis=1))[0]) for v in q]
    assert all(np.allclose(np.sort(near[i == n] @ q[n])[::-1], best[at[n]]) for n in range(90))
    high = np.linalg.norm(x, axis=1).max()
    bands = neighbours._bands(near, high, neighbours.BANDS)
    assert set(bands.tolist()) <= {0, 4, 5}
    h = neighbours.hash_for(len(x), 128, 8, 7)
    assert (h.full, h.groups, h.axes) == (0, 225, 256)
    plan = neighbours._plans(h, q, i, near, bands, x, neighbours._bands(x, high, neighbours.BANDS), 8)
    assert not plan[0].whole and 1 <= plan[0].tables <= 8
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df, leaf=8, chunk=200).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = {n: set(np.argsort(-score[n])[:20].tolist()) for n in range(0, 1800, 20)}
    assert np.mean([len(want[n] & got[n]) / 20 for n in want]) >= 0.9


def test_cells_and_probes_agree():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 10))
    for full, groups in ((0, 1), (0, 5), (1, 1), (2, 3)):
        h = neighbours.Hash(10, full, groups, 7)
        assert h.axes == 32 and h.polytopes == full + (groups > 1) and h.cells == 32**full * groups
        cell = h.cell(x, 3)
        assert ((cell >= 0) & (cell < h.cells)).all() and np.allclose(h.shortfall(x, cell[:, None], 3), 0)
        row, probed = h.probes(x[:20], 3, 0.4)
        assert (h.shortfall(x[:20][row], probed[:, None], 3) <= 0.4 + 1e-9).all()
        every = h.shortfall(x[:20], np.broadcast_to(cell, (20, 200)), 3) <= 0.4
        assert {(int(r), int(c)) for r, j in zip(*np.nonzero(every)) for c in [cell[j]]} <= set(zip(row.tolist(), probed.tolist()))
    assert [(neighbours.hash_for(n, 64, 256, 7).full, neighbours.hash_for(n, 64, 256, 7).groups) for n in (10, 51200, 10**7, 10**10)] == [(0, 1), (1, 1), (2, 2), (3, 18)]


def test_crc_matches_zlib(spark):
    got = spark.sql("select crc32('é') c").first().c
    assert got == zlib.crc32("é".encode()) and hashlib.sha256(b"").hexdigest().startswith("e3b0")


def slow_repeats(rows, length):
    seen, out = set(), []
    for _, raw in rows:
        gone = [False] * len(raw)
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            if s in seen:
                gone[i : i + length] = [True] * length
            seen.add(s)
        out.append(gone)
    return out


def test_repeats(spark):
    from worklens.llm import substrings

    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdé ", k=rng.randint(1, 7)))
    make = lambda n: " ".join(word() for _ in range(n))
    passages = [make(40) for _ in range(6)] + ["a" * 500, "xy" * 90, "z" * 99, make(25) * 3, "0123456789" * 13]
    rows = [(None, passages[0]), (None, None)]
    for i in range(150):
        parts = [make(rng.randint(0, 30)) + (rng.choice(passages) if rng.random() < 0.6 else "") for _ in range(rng.randint(0, 4))]
        rows.append((1000 - i, "".join(parts)))
    rows += [(2000 + i, passages[1] + make(9)) for i in range(40)] + [(7, passages[2]), (7, passages[2]), (8, ""), (9, passages[3][:100]), (10, passages[3][1:])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("raw", F.lit(1)).repartition(4)
    out = substrings.remove_repeats(df, batch_bytes=6000).collect()
    order = sorted([(-1 if i is None else i, (x or "").encode()) for i, x in rows])
    want = []
    for (i, raw), gone in zip(order, slow_repeats(order, 100)):
        edges = [k for k in range(len(raw) + 1) if (k < len(raw) and gone[k]) != (k > 0 and gone[k - 1])]
        want.append((i, len(raw), list(zip(edges[::2], edges[1::2])), bytes(b for b, g in zip(raw, gone) if not g)))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, [(s.start, s.stop) for s in r.spans], bytes(r.kept)) for r in out)
    assert got == sorted(want) and sum(map(len, (w[2] for w in want))) > 100
    assert substrings.remove_repeats(df.limit(0)).count() == 0
    whole = {(i, n, tuple(s)) for i, n, s, _ in got}
    again = substrings.remove_repeats(df, batch_bytes=1 << 20).collect()
    assert {(-1 if r.doc_id is None else r.doc_id, r.n_bytes, tuple((s.start, s.stop) for s in r.spans)) for r in again} == whole


def test_repeats_of_a_hot_passage(spark):
    """A passage of most documents, with other bytes at its edges in each, and hot triggers from two occurrences on."""
    from worklens.llm import substrings

    rng = random.Random(12)
    make = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    hot = make(300)
    rows = [(i, make(rng.randint(0, 150)) + (hot[: rng.choice([300, 120, 99])] if i % 3 else "") + make(rng.randint(0, 150))) for i in range(150)]
    rows += [(500 + i, rows[i][1][20:] + "tail") for i in range(0, 150, 10)]
    want = [(i, len(x), sum(g)) for (i, x), g in zip(rows, slow_repeats([(i, x.encode()) for i, x in rows], 100))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot_from in (1, 50, 4096):
        out = substrings.remove_repeats(df, batch_bytes=4000, hot=hot_from).collect()
        assert sorted((r.doc_id, r.n_bytes, sum(s.stop - s.start for s in r.spans)) for r in out) == want


def test_suffix_array_sorts_bytes():
    from worklens.llm import substrings

    rng = random.Random(13)
    raw = bytes(rng.choices(b"ab\xff", k=60)) * 6 + bytes(rng.choices(b"ab", k=200))
    for length in (8, 9, 64, 100, 130):
        at = np.arange(0, len(raw) - length + 1, 3)
        order, same = substrings.suffix_array(np.frombuffer(raw, np.uint8), at, length)
        strings = [raw[i : i + length] for i in at[order].tolist()]
        assert strings == sorted(strings) and same.tolist() == [False] + [x == y for x, y in zip(strings, strings[1:])]
        assert all(order[i] > order[i - 1] for i in np.flatnonzero(same))


def test_rolling_hash_is_of_content():
    from worklens.llm import substrings

    raw = np.frombuffer(bytes(random.Random(1).choices(range(256), k=400)) * 2, np.uint8)
    for n in (1, 3, 32, 100, 101):
        h = substrings.rolling(raw, n)
        assert len(h) == 801 - n and (h[: 401 - n] == h[400:]).all() and len(set(h[:400].tolist())) > 390 - (n == 1) * 300
    x = np.random.default_rng(1).integers(0, 99, 300)
    for w in (1, 2, 5, 69):
        assert substrings._sliding(x, w, np.minimum).tolist() == [x[i : i + w].min() for i in range(301 - w)]


def test_scores(spark):
    from worklens.llm import mixing_model

    rng = random.Random(9)
    syllables = [["the", "on", "er", "ti", "wh", "oud"], ["schl", "ß", "ung", "ein", "ch", "är"]]
    word = lambda i: "".join(rng.choices(syllables[i % 2], k=rng.choice([1, 1, 2, 2, 3])))
    rows = [(i, " ".join(word(i).title() if rng.random() < 0.1 else word(i) for _ in range(rng.randint(1, 80))) + rng.choice([".", "!\n", ""])) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1001, ""), (1002, " \n "), (None, "the " * 3000), (1003, "qqqqq" * 2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit(0), "kind": F.concat(F.lit("kind"), F.col("doc_id") % 2)}).repartition(3)
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0
    out = mixing_model.score_texts(df, held, label="kind", batch_bytes=4000).collect()
    assert len(out) == len(rows)
    held_out = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in rows}
    split = lambda x: re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x or "")) + ["\n"]
    counts = {}
    for i, x in rows:
        for w in split(x) if not held_out[i] else ():
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), held_out[i], len(split(x)), sum(w in counts for w in split(x)), n, round(sum(np.log10((counts.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in split(x)), 6)) for i, x in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
    assert all(r.score < 0 and np.isfinite(r.score) for r in out)
    better = [r.score > r.base_score for r in out if r.held_out and r.n_tokens > 5]
    assert np.mean(better) > 0.8
    assert mixing_model.score_texts(df.limit(0), held).count() == 0
    assert all(r.score < 0 for r in mixing_model.score_texts(df.limit(5), F.lit(True)).collect())


def trained_model():
    from worklens.llm import mixing_model as m

    keys = [m.state_bytes(s) + k for s in (0, 1) for k in (b"Wthe", b"Wthen", b"B", b".on", b"Wonon", b"Wotherwise")]
    counts, sizes = np.arange(1, len(keys) + 1) * 3, (10,) * m.ORDERS
    zeros, ones = np.zeros(m.ORDERS << 10, np.int64), np.zeros(m.ORDERS << 10, np.int64)
    for some, owner in m.chunks(keys):
        d = m.decisions(some, sizes)
        for k in range(m.ORDERS):
            for x, bit in ((zeros, 0), (ones, 1)):
                np.add.at(x, d.slots[k][d.bits == bit], (counts if k >= m.BY_TOKEN else np.ones_like(counts))[owner[d.owner]][d.bits == bit])
    table = np.stack([m.quantised(zeros), m.quantised(ones)], axis=1).copy().view(np.uint16).ravel()
    found = m.learn(table, sizes, keys, counts)
    return m.finished(m.Model(sizes, table), found.weights, found.histories, found.cells)


def test_model_is_a_distribution():
    from worklens.llm import mixing_model as m

    model = trained_model()
    # all bytes after "W", as first symbols: what their decisions say adds up to one
    d = m.decisions([m.state_bytes(1) + bytes([87, b]) for b in range(256) if b != 32] + [m.state_bytes(1) + b"W"], model.slots_of)
    p = model.ones(d)
    right = np.where(d.bits == 1, p, 1 - p)
    first = np.array([right[np.flatnonzero(d.owner == i)[:8]].prod() for i in range(256)])
    assert abs(first.sum() - 1) < 1e-6
    head = m.state_bytes(1) + b"W"
    scores = model.log10([head + b"the", head + b"zzz", head + b"x" * 1000, head + b"x" * m.LONG, head + b"x" * (1000 - 3 * m.LONG)])
    assert scores[0] > -2 > scores[1] and scores[2] == pytest.approx(3 * scores[3] + scores[4])


def test_model_is_broadcast_packed():
    """A full-sized table of mostly empty slots takes a small part of its 38 MB on its way, and scores the same."""
    import pickle

    from worklens.llm import mixing_model as m

    model = trained_model()
    keys = [m.state_bytes(1) + b"Wthe", m.state_bytes(0) + b"Wzzz"]
    again = pickle.loads(pickle.dumps(model))
    assert again.table.dtype == np.uint16 and (again.table == model.table).all() and again.log10(keys).tolist() == model.log10(keys).tolist()
    wide = m.Model(m.MOST_SLOTS, np.zeros(sum(1 << s for s in m.MOST_SLOTS), np.uint16))
    wide.table[::50] = np.random.default_rng(3).integers(1, 1 << 16, len(wide.table[::50]))
    sent = pickle.dumps(wide)
    assert len(sent) < wide.table.nbytes / 8 and (pickle.loads(sent).table == wide.table).all()


def slow_spelling(model, head, word):
    """The mixed bits of one word, one after the other; slots and tables are the model's."""
    from worklens.llm import mixing_model as m

    out = 0.0
    for at in range(0, max(1, len(word)), m.LONG):
        piece = word[at : at + m.LONG]
        d = m.decisions([head + piece], model.slots_of)
        for i, byte in enumerate(piece + b" "):
            for b in range(8):
                j, bit = 8 * i + b, byte >> (7 - b) & 1
                assert d.bits[j] == bit
                pairs = [(int(model.table[d.slots[k][j]]) & 255, int(model.table[d.slots[k][j]]) >> 8) for k in range(m.ORDERS)]
                number = lambda code: 2 ** (code / 8) - 1
                sure = [min(m.CONFIDENCE - 1, int(np.log2(1 + number(z) + number(o)))) for z, o in pairs]
                step = lambda n: sum(n > x for x in m._STEPS)
                history = [step(number(z)) * 16 + step(number(o)) for z, o in pairs]
                gate = (min(i, m.PLACES - 1) * m.CONFIDENCE + sure[m.WORD]) * 8 + b
                total = sum(float(model.weights[k, gate, sure[k]]) * float(model.maps[k, history[k] + (sure[m.WORD] > 0) * m.HISTORIES]) for k in range(m.ORDERS))
                cell = min(max(total, -11.99), 11.99) * 4 / 3 + 16
                low, part = int(cell), cell - int(cell)
                p = (1 / (1 + np.exp(-min(max(total, -14), 14))) + model.refine[gate, low] * (1 - part) + model.refine[gate, low + 1] * part) / 2
                p = min(max(p, 1e-6), 1 - 1e-6)
                out += np.log10(p if bit else 1 - p)
    return out


def test_scores_equal_those_of_one_token_after_the_other(spark):
    from worklens.llm import mixing_model as m

    rng = random.Random(10)
    words = {"aa": "alpha beta of the gamma, ab.".split(), "bb": "delta der und die zeta! ab.".split()}
    rows = [(i, " ".join(rng.choices(words["aa" if i % 2 else "bb"], k=rng.randint(0, 12))), "aa" if i % 2 else "bb") for i in range(40)]
    rows += [(100 + i, "of der the first story told twice in other words and again, as it is long, with a word or two of the gamma at its end " + str(i // 2), None) for i in range(6)] + [(200, None, "aa"), (201, "A" * 700 + " of", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    fitted = []
    held = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    out = {r.doc_id: r for r in m.score_texts(df, held, label="lang", batch_bytes=2000, most_slots=(10, 10, 12, 12, 14, 14, 14, 14), fitted=fitted).collect()}
    f = fitted[0]
    held_out = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _, _ in rows}
    split = {i: [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", (x or "").lower())] + [b""] for i, x, _ in rows}
    assert f.voters.get(b"of") == 1 and f.voters.get(b"der") == 2 and b"ab." not in f.voters
    from worklens.llm.mixing_model import pa

    def runs(toks):
        """Runs by their first token, with the two words before."""
        t = m.tokens(pa.array([b" ".join(toks[:-1]).decode()]))
        first = t.runs()[0].tolist()
        return {a: (tuple(toks[a - 2 : a]), tuple(toks[a:z])) for a, z in zip(first, [*first[1:], len(toks)])}

    every = {i: runs(toks) for i, toks in split.items()}
    assert sum(map(len, every.values())) > 20 and all(a >= 2 for x in every.values() for a in x)
    foreseen = 0
    for i, toks in split.items():
        score, seen, before, until = 0.0, {True: [1.8, 0.2], False: [0.2, 1.8]}, False, 0
        for t, w in enumerate(toks):
            votes = [f.voters[x] for x in toks[:t] if x in f.voters]
            state = min(set(votes), key=lambda c: (-votes.count(c), c)) if votes else 0
            kind = m.START if t == 0 else m.KINDS[toks[t - 1][-1]]
            if t in every[i]:
                came, (two, run) = False, every[i][t]
                known = [(j, r) for j, x in every.items() if not held_out[j] for w2, r in x.values() if w2 == two]
                if len({r for _, r in known}) == 1 and any(j != i for j, _ in known):
                    foreseen += 1
                    came = known[0][1] == run
                    yes, no = seen[before]
                    score += np.log10((yes if came else no) / (yes + no))
                    seen[before][0 if came else 1] += 1
                before, until = came, t + len(run) if came else 0
            score += 0 if t < until else slow_spelling(f.model, m.state_bytes(state) + kind, w)
        assert out[i].score == pytest.approx(score, rel=1e-4), i
    assert foreseen > 3


def test_scores_of_an_endless_word(spark):
    from worklens.llm import mixing_model as m

    df = spark.createDataFrame([(i, f"some words {i}") for i in range(20)], "doc_id long, text string").union(spark.range(1).select("id", F.repeat(F.lit("qx"), 1_000_000)))
    out = m.score_texts(df, F.lit(False)).collect()
    assert max(r.n_bytes for r in out) == 2_000_002 and all(np.isfinite(r.score) for r in out)
