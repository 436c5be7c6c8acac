"""The registered queries of the operators, with production parameters, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worklens.llm import common, contamination, language, lines, mixing, mixing_model, neighbours, sharding, simhash, substrings, tokens, trie, urls, whitening

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(every: int):
    """Rows that no model may learn from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % every == 0


#: Where the public tokenizers are; their library gives the place of each.
TOKENIZER, TOKENIZER_LIBRARY = "piece_bpe_32k.model", "sentencepiece"


@query("op1_cross_polytope_neighbours")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query("op2_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path(TOKENIZER), "rb") as f:
        model = f.read()
    docs = documents(spark, sf_dir).select("doc_id", "text")
    # a cache of its own, so that each run encodes what it is given
    out = tokens.count_tokens(docs, model, TOKENIZER_LIBRARY, common.scratch(spark, "token-cache"))
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query("op3_context_mixing_scores")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    return mixing_model.score_texts(docs, held_out(10), label="lang").withColumn("bits_per_byte", -F.col("score") * F.log2(F.lit(10.0)) / F.col("n_bytes"))


@query("op4_prefix_free_parsing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    removed = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"]), F.lit(0).cast("long"))
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op5_ring_shards")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    sized = docs.withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit(""))))
    out = sharding.shard(sized, keep_text=False)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query(
    "op6_source_mix",
    r"""
    WITH rows AS (
      SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
    sources AS (
      SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM rows GROUP BY source),
    levels AS (
      SELECT *, source_size * 3.0::DOUBLE / weight AS stop_at,
             (sum(source_size) OVER ()::DOUBLE - coalesce(sum(source_size * 3) OVER up, 0)::DOUBLE)
             / (sum(weight) OVER ()::DOUBLE - coalesce(sum(weight) OVER up, 0)::DOUBLE) AS level
      FROM sources WINDOW up AS (ORDER BY source_size * 3.0::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    found AS (SELECT arg_min(level, (stop_at, weight, coalesce(source, ''))) FILTER (WHERE stop_at >= level) AS level FROM levels),
    targets AS (
      SELECT s.source, s.source_size, least(s.weight * coalesce(f.level, 0), s.source_size * 3.0::DOUBLE) AS target,
             ('0x' || substr(md5('0|' || CASE WHEN s.source IS NULL THEN '' ELSE '=' || s.source END), 1, 5))::BIGINT / 1048576.0::DOUBLE AS unit
      FROM sources s, found f),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 2), doc_id)::DOUBLE AS at FROM rows)
    SELECT r.doc_id, r.size, t.source_size, t.target,
           (CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size * r.at + t.unit) - floor(t.target / t.source_size * (r.at - 1) + t.unit) ELSE 0 END)::BIGINT * r.size AS taken
    FROM ranked r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
    """,
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", common.word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"))
    out = mixing.systematic_mix(docs)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query("op7_language_bitmask_filters")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    filters = language.learn(docs.filter(~held_out(5)))
    return language.identify(docs.select("doc_id", "text"), filters).select("doc_id", held_out(5).alias("held_out"), "lang_pred", "score")


@query("op8_gray_order_simhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_groups(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"), "component_id")


@query("op9_suffix_automaton_decontamination")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.find_windows(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit, items = contamination.hit_words(), F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), (hit > 0).alias("contaminated"))


@query(
    "op10_line_dedup",
    r"""
    WITH split AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents),
    lines AS (SELECT r, doc_id, unnest(range(len(p))) AS i, unnest(p) AS line FROM split),
    keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
    frequent AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
    SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
    FROM keyed k LEFT JOIN frequent f ON k.key = f.key GROUP BY r, doc_id
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_common_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


#: Rules of the URL filter: host, path, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


@query(
    "op11_link_propagated_urls",
    r"""
    WITH RECURSIVE rules(rh, rp, rv) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
    p AS (
      SELECT row_number() OVER () AS r, page_id, html, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    ruled AS (
      SELECT * FROM (
        SELECT p.r, page_id, html, host, path, rh || rp AS rule, rv, row_number() OVER (PARTITION BY p.r ORDER BY length(rh || rp) DESC NULLS LAST) AS k
        FROM p LEFT JOIN rules ON (host = rh OR suffix(host, '.' || rh)) AND starts_with(path, rp)) WHERE k = 1),
    hosts AS (SELECT host, count(*) AS n, count(*) FILTER (WHERE rv = 'allow') AS trusted, count(*) FILTER (WHERE rv = 'block') AS blocked FROM ruled WHERE host <> '' GROUP BY host),
    ends AS (
      SELECT DISTINCT r, host AS src, CASE WHEN regexp_matches(l, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN translate(regexp_extract(l, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') WHEN starts_with(l, '//') THEN translate(regexp_extract(l, '^//([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
             WHEN regexp_matches(l, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN '' ELSE host END AS dst
      FROM (SELECT r, host, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']?([^"''\s>]+)', 1)) AS l FROM p WHERE host <> '')),
    links AS (SELECT src, dst, count(*) AS w FROM ends WHERE dst <> '' GROUP BY ALL),
    linked AS (SELECT 'trust' AS kind, src AS spot, dst AS goes, w FROM links UNION ALL SELECT 'distrust', dst, src, w FROM links),
    everyone AS (SELECT host FROM hosts UNION SELECT src FROM links UNION SELECT dst FROM links),
    flows AS (
      SELECT kind, spot, goes, w / sum(w) OVER (PARTITION BY kind, spot) AS share FROM linked
      UNION ALL SELECT kind, host, host, 1.0 FROM everyone, (VALUES ('trust'), ('distrust')) k(kind) WHERE NOT EXISTS (FROM linked x WHERE x.kind = k.kind AND x.spot = everyone.host)),
    seeds AS (SELECT 'trust' AS kind, host AS spot, trusted::DOUBLE AS mass FROM hosts UNION ALL SELECT 'distrust', host, blocked FROM hosts),
    scores AS (
      SELECT 0 AS round, kind, spot, mass FROM seeds
      UNION ALL
      SELECT round + 1, kind, spot, sum(mass) FROM (
        SELECT s.round, f.kind, f.goes AS spot, 0.85 * s.mass * f.share AS mass FROM scores s JOIN flows f ON f.kind = s.kind AND f.spot = s.spot WHERE s.round < 60
        UNION ALL SELECT x.round, s.kind, s.spot, 0.15 * s.mass FROM seeds s, (SELECT DISTINCT round FROM scores WHERE round < 60) x) GROUP BY round, kind, spot),
    last AS (SELECT spot AS host, round(coalesce(sum(mass) FILTER (WHERE kind = 'trust'), 0), 6) AS trust, round(coalesce(sum(mass) FILTER (WHERE kind = 'distrust'), 0), 6) AS distrust FROM scores WHERE round = 60 GROUP BY spot)
    SELECT page_id, r.host, path, rule, coalesce(rv, CASE WHEN distrust > 0.5 * n AND distrust > trust THEN 'block' ELSE 'allow' END) AS verdict
    FROM ruled r LEFT JOIN hosts h ON h.host = r.host LEFT JOIN last l ON l.host = r.host
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    out = urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), rules)
    return out.select("page_id", "host", "path", "rule", "verdict")


#: Conversations of a block share the first turns of its first one.
BLOCK, MOST_SHARED = 100, 5


@query(
    "op12_conversation_prefix_trie",
    """
    WITH t AS (
      SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
    k AS (  -- CRC-32 bit by bit: a byte is xored in, then come eight shifts (-1)
      SELECT c, c - c % 100 AS b, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: [ascii(x), -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 6 AS h FROM (SELECT DISTINCT c FROM t)),
    turns AS (
      SELECT k.c, t.i, role, text FROM k JOIN t ON t.c = k.b AND t.i <= k.h
      UNION ALL SELECT k.c, t.i, role, text FROM k JOIN t ON t.c = k.c AND t.i > k.h),
    numbered AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY i) AS d, sha256(length(role) || ':' || role || text) AS x, length(text) AS size FROM turns),
    paths AS (
      SELECT c, d, sha256(string_agg(x, '') OVER (PARTITION BY c ORDER BY d)) AS node, size FROM numbered
      UNION ALL SELECT c, 0, 'root', 0 FROM k),
    nodes AS (SELECT node, any_value(d) AS d, min(c) AS c, count(*) AS n, any_value(size) AS size FROM paths GROUP BY node),
    above AS (SELECT n.node, p.node AS parent FROM nodes n JOIN paths p ON p.c = n.c AND p.d = n.d - 1),
    children AS (SELECT parent, count(*) AS n FROM above GROUP BY parent),
    under AS (SELECT p.node AS top, n.node, (n.n - 1) * n.size AS saved, h.n IS NULL AS leaf FROM nodes n JOIN paths p ON p.c = n.c AND p.d <= n.d LEFT JOIN children h ON h.parent = n.node),
    sums AS (SELECT top, count(*) FILTER (WHERE leaf) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM under GROUP BY top),
    ends AS (SELECT node, string_agg(c, ',' ORDER BY c) AS ids FROM (SELECT c, arg_max(node, d) AS node FROM paths GROUP BY c) GROUP BY node)
    SELECT n.c AS conv_id, n.d AS depth, p.c AS parent_conv_id, n.n AS n_convs, coalesce(h.n, 0) AS n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
    FROM nodes n LEFT JOIN above a USING (node) LEFT JOIN nodes p ON p.node = a.parent LEFT JOIN children h ON h.parent = n.node JOIN sums ON top = n.node LEFT JOIN ends e ON e.node = n.node
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    convs = trie.conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"), together=conv - conv % BLOCK)
    shared = (F.crc32(conv.cast("string")) % (MOST_SHARED + 1)).cast("int")
    return trie.prefix_trie(trie.with_heads(convs, shared, MOST_SHARED))


@query("op13_chebyshev_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
