"""Declared captures against real shapes of provider output, invented values."""

import json

import pytest
from pyspark.sql import functions as F

from worklens.functions import json_paths
from worklens.operators import captures
from worklens.operators.captures import Capture

OUTPUT = "task long, attempt int, lease_epoch long, adapter string, stream string, body string"
DECLARED = [
    Capture("threads", "sessionRef", "$..thread_id"), Capture("threads", "model", "$..model"), Capture("threads", "finalMessage", "$[?@.type == 'item.completed' && @.item.type == 'agent_message'].item.text", mode="jsonPathLast"),
    Capture("threads", "usage", "$..usage", fields={"inputTokensWithCacheRead": ["input_tokens"], "cacheReadTokens": ["cached_input_tokens"], "cacheWriteTokens": ["cache_write_input_tokens"], "outputTokens": ["output_tokens"], "reasoningTokens": ["reasoning_output_tokens"]}),
    Capture("messages", "usage", "$[?@.type == 'assistant'].message.usage", mode="jsonPathLast", fields={"inputTokens": ["input_tokens"], "outputTokens": ["output_tokens"], "cacheWriteTokens": ["missing", "cache.0.write"]}),
    Capture("messages", "cost", "$[?@.type == 'result'].total_cost_usd", mode="jsonPathLast", fields={"costUsd": ["$"]}), Capture("messages", "window", "$[?@.type == 'result'].modelUsage.*.contextWindow", mode="jsonPathLast"),
    Capture("shell", "branch", "(?m)^branch=(.+)$", mode="regex"), Capture("shell", "twice", "a\\nb", stream="stderr", mode="regex"), Capture("shell", "finalMessage", "$.n"),
]
THREAD = ['{"type":"thread.started","thread_id":"t-1"}', '{"type":"turn.started"}', '{"type":"item.completed","item":{"type":"agent_message","text":"first"}}', '{"type":"item.completed","item":{"type":"agent_message","text":"die \\"letzte\\" é"}}',
          '{"type":"turn.completed","usage":{"input_tokens":16204,"cached_input_tokens":11008,"cache_write_input_tokens":0,"output_tokens":5,"reasoning_output_tokens":0}}']


@pytest.mark.parametrize("pattern, document, want", [
    ("$.a.b", {"a": {"b": 1}}, [1]), ("$..x", {"x": [{"x": 2}], "y": {"x": None}}, [[{"x": 2}], 2, None]), ("$.a[1]", {"a": [5, 6]}, [6]), ("$['a b'].*", {"a b": {"c": 1, "d": 2}}, [1, 2]), ("$.a[*].t", {"a": [{"t": 1}, 3, {"t": 2}]}, [1, 2]),
    ("$.c[?@.type == 'text'].text", {"c": [{"type": "text", "text": "x"}, {"type": "tool", "text": "y"}]}, ["x"]), ("$.c[?@.t != 'a' && @.k]", {"c": [{"k": 0}, {"t": "a", "k": 1}, {"t": "b"}]}, [{"k": 0}]), ("$[?!@.a || @.a == 1]", [{"a": 1}, {"a": True}, {"b": 2}], [{"a": 1}, {"b": 2}]),
    ("$.c[?@.t == '] && \\'x']", {"c": [{"t": "] && 'x"}]}, [{"t": "] && 'x"}]), ("$.a", 5, []),
])
def test_paths(pattern, document, want):
    assert list(json_paths.matches(json_paths.steps(pattern), document)) == want


@pytest.mark.parametrize("pattern", ["a", "$.", "$[", "$[?(@.a)]", "$.a[-1]", "$x", "$[1:2]"])
def test_unknown_paths_are_refused(pattern):
    with pytest.raises(ValueError):
        json_paths.steps(pattern)


def outputs(spark, *rows):
    return spark.createDataFrame([(i, 1, 1, *r) for i, r in enumerate(rows)], OUTPUT)


def test_captures_of_three_modes(spark):
    spoken = [json.dumps(x) for x in ({"type": "assistant", "message": {"usage": {"input_tokens": 3, "output_tokens": 2.0, "cache": [{"write": 7}]}}}, {"type": "user", "message": {"usage": {"input_tokens": 99}}}, {"type": "result", "total_cost_usd": 0.1234567890123, "modelUsage": {"m": {"contextWindow": 5}}})]
    df = outputs(
        spark, ("threads", "stdout", "\n".join(THREAD)), ("messages", "stdout", "\n".join(spoken)), ("shell", "stdout", "branch=one\nx branch=no\nbranch=two\r\n"), ("threads", "stdout", "\n".join(THREAD[:2]) + '\n{"type":"turn.comp'), ("threads", "stdout", "oops"),
        ("threads", "stdout", THREAD[0] + "\noops\n" + THREAD[1]), ("threads", "stdout", '{"thread_id":5}'), ("threads", "stdout", None), ("other", "stdout", "x"), ("shell", "stderr", "a\nb"),
    )
    got = {r.task: (r.captures, r.fault) for r in captures.scrape(df, DECLARED).collect()}
    usage = json.dumps(json.loads(THREAD[4])["usage"], separators=(",", ":"))
    assert got[0] == ({"sessionRef": '"t-1"', "finalMessage": '"die \\"letzte\\" é"', "usage": usage}, None)
    assert got[1][0]["window"] == "5" and json.loads(got[1][0]["usage"])["input_tokens"] == 3 and got[1][0]["cost"] == "0.1234567890123"
    assert got[2] == (None, "malformed")  # a shell's output is no JSON, and this adapter declares a path over it
    assert got[3] == ({"sessionRef": '"t-1"'}, None) and got[4] == got[5] == (None, "malformed") and got[6] == (None, "not-text") and got[7] == got[8] == ({}, None) and got[9] == ({"twice": '"a\\nb"'}, None)
    only = captures.scrape(df, [c for c in DECLARED if c.adapter == "shell" and c.mode == "regex"]).filter("task = 2").collect()
    assert only[0].captures == {"branch": '"two\\r"'}


def test_usage_by_field_map(spark):
    spoken = {"type": "assistant", "message": {"usage": {"input_tokens": 3, "output_tokens": 2.0, "cache": [{"write": 7}]}}}
    under = THREAD[4].replace("11008", "16205")
    df = outputs(spark, ("threads", "stdout", "\n".join(THREAD)), ("messages", "stdout", json.dumps(spoken)), ("messages", "stdout", json.dumps(spoken).replace("2.0", '"2"').replace("3", "-3")), ("threads", "stdout", under), ("threads", "stdout", THREAD[0]), ("shell", "stdout", ""), ("threads", "stdout", '{"usage":{}}'))
    got = {r.task: r for r in captures.observe(captures.scrape(df, DECLARED), DECLARED).collect()}
    r = got[0]
    assert (r.state, r.shape, r.input_tokens, r.input_as_reported, r.cache_read_tokens, r.cache_write_tokens, r.output_tokens, r.reasoning_tokens, r.total_tokens, r.total_source, r.unreadable) == ("reported", "components", 5196, 16204, 11008, 0, 5, 0, 16209, "derived", [])
    assert r.declared == ["cacheReadTokens", "cacheWriteTokens", "inputTokensWithCacheRead", "outputTokens", "reasoningTokens"]
    assert (got[1].input_tokens, got[1].output_tokens, got[1].cache_write_tokens, got[1].unreadable) == (3, 2, 7, [])
    assert (got[2].input_tokens, got[2].output_tokens, got[2].unreadable) == (None, None, ["inputTokens", "outputTokens"])
    assert (got[3].input_tokens, got[3].input_as_reported, got[3].unreadable) == (None, 16204, ["inputTokensWithCacheRead"])
    assert [got[i].state for i in (4, 5, 6)] == ["not-reported", "not-declared", "reported"] and got[6].shape == "unmapped"


def test_declarations(spark):
    rows = [("a", "usage", "$.u", "stdout", "jsonPath", None)]
    schema = "adapter string, name string, pattern string, stream string, mode string, fields map<string,array<string>>"
    assert captures.declared_fields(captures.declarations(spark.createDataFrame(rows, schema))) == {"a": ["inputTokens", "outputTokens", "totalTokens"]}
    for bad in (("a", "x", "$.u", "stdout", "xpath", None), ("a", "x", "u", "stdout", "jsonPath", None), ("a", "x", "", "stdout", "regex", None)):
        with pytest.raises(ValueError):
            captures.declarations(spark.createDataFrame([bad], schema))
    with pytest.raises(ValueError):
        captures.declared_fields([Capture("a", "usage", "$.u", fields={"inputTokensWithCacheRead": ["x"]})])
    many = spark.range(captures.MOST + 1).select(F.lit("a").alias("adapter"), F.col("id").cast("string").alias("name"), F.lit("x").alias("pattern"), F.lit("stdout").alias("stream"), F.lit("regex").alias("mode"), F.lit(None).cast("map<string,array<string>>").alias("fields"))
    with pytest.raises(ValueError):
        captures.declarations(many)
