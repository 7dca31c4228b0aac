"""Scanned streams: what goes out, what is found, and the verdicts."""

import json

import pytest
from pyspark.sql import functions as F

from palisade.functions import text
from palisade.streaming import scan

RULES = """
permit(principal, action, resource);
@id("f") @enforcement("flag") forbid(principal, action == X::Action::"llm.response", resource) when { context.pii_detected };
@id("b") @enforcement("block") forbid(principal, action == X::Action::"llm.response", resource) when { context.model == "bad" };
@id("h") @enforcement("hold") @hold_message("wait") forbid(principal, action == X::Action::"llm.response", resource) when { context.model == "slow" };
@id("t") @enforcement("block") forbid(principal, action == X::Action::"tool.call", resource) when { context.tool_count > 1 };
"""


def flushed(spark, rows, rules=RULES):
    df = spark.createDataFrame(rows, "stream_id long, flush_seq int, text string, model string")
    return {(r.stream_id, r.flush_seq): r for r in scan.enforce_flushes(df, rules).collect()}


def content(sse):
    return json.loads(sse.split("\n\n")[0].removeprefix("data: "))["choices"][0]["delta"]["content"]


def test_enforced_flushes(spark):
    got = flushed(spark, [(1, 0, "mail me at joe@example.com now", "ok"), (1, 1, "fine here", "bad"), (1, 2, "after it", "ok"), (1, 3, "again", "slow"), (2, 0, "hold on", "slow"), (3, 0, None, "ok")])
    first = got[1, 0]
    assert first.verdict == "flag" and "joe@" not in content(first.output)
    assert [(f.pattern, f.location) for f in first.findings] == [("email", "streaming_response"), ("f", "streaming_response_policy")]
    assert not got[1, 1].sent and "error" in json.loads(got[1, 1].output.removeprefix("data: "))
    assert [got[1, i].output for i in (2, 3)] == [None, None]
    assert not got[2, 0].sent and content(got[2, 0].output) == "wait"
    assert got[3, 0].sent and content(got[3, 0].output) == ""


def test_transform_replaces(spark):
    rules = 'permit(principal, action, resource);\n@id("t") @enforcement("transform") @transform_pattern("red") @transform_replace("blue") permit(principal, action, resource);'
    got = flushed(spark, [(1, 0, "a red car, a red door", "ok")], rules)
    assert content(got[1, 0].output) == "a blue car, a blue door" and got[1, 0].sent


def test_stream_verdicts(spark):
    df = spark.createDataFrame([(1, 0, "to joe@example.com", "ok"), (1, 1, "x", "bad"), (1, 2, "to ann@example.com", "ok"), (2, 0, "x", "ok"), (3, 0, "to joe@example.com", "ok"), (3, 1, "x", "ok")], "stream_id long, flush_seq int, text string, model string")
    assert {r.stream_id: r.verdict for r in scan.stream_verdicts(scan.enforce_flushes(df, RULES)).collect()} == {1: "block", 2: "allow", 3: "flag"}


def said(x):
    return json.dumps({"choices": [{"delta": {"content": x}}]})


def called(i, name=None, args=None):
    return json.dumps({"choices": [{"delta": {"tool_calls": [{"index": i, "function": {k: v for k, v in (("name", name), ("arguments", args)) if v is not None}}]}}]})


def test_observed_streams(spark):
    rows = [
        (1, 0, said("write joe@example.com or joe@ex"), False),
        (1, 1, said("ample.com, twice"), False),
        (1, 2, called(0, "a", '{"to":"ann@'), False),
        (1, 3, called(0, None, 'example.com"}'), False),
        (1, 4, called(1, "b", "{}"), False),
        (1, 5, "[DONE]", True),
        (2, 0, called(0, "a", "ann@example.com"), False),
        (2, 1, called(1, "b", ""), False),
        (3, 0, "not json", False),
        (3, 1, "[DONE]", True),
    ]
    df = spark.createDataFrame([(*r, False) for r in rows], "k long, seq int, data string, is_done boolean, is_error boolean")
    seen = {r.k: r for r in scan.observe(df, ["k"]).collect()}
    assert [(f.pattern, f["count"], f.location) for f in seen[1].findings] == [("email", 1, "streaming_response"), ("email", 1, "streaming_tool_args")]
    assert seen[1].tools == ["a", "b"] and seen[1].verdict == "flag"
    assert seen[2].findings == [] and seen[2].verdict == "allow" and not seen[2].done  # never ended: its arguments are not judged
    assert seen[3].findings == [] and seen[3].tools == [] and seen[3].verdict == "allow"
    end = {r.k: r for r in scan.tools_at_end(scan.observe(df, ["k"]), RULES).collect()}
    assert end[1].verdict == "block" and (end[1].findings[-1].pattern, end[1].findings[-1]["count"], end[1].findings[-1].location) == ("t", 2, "streaming_response_tool_calls")
    assert end[2].verdict == "allow" and end[3].verdict == "allow"


@pytest.mark.parametrize("body", ["nope", "[1, 2]", '"s"', "", None, '{"a":1,"a":2}'])
def test_bodies_kept(spark, body):
    assert spark.createDataFrame([(body,)], "b string").select(text.rewrite_model(F.col("b"), F.lit("m")).alias("b")).first().b == body


def test_model_rewritten(spark):
    body = {"z": 1, "model": "old", "n": None, "deep": [{"model": "old"}], "s": 'q"ü', "f": 1.5}
    got = spark.createDataFrame([(json.dumps(body),), ("{}",)], "b string").select(text.rewrite_model(F.col("b"), F.lit('new"x')).alias("b")).collect()
    assert json.loads(got[0].b) == body | {"model": 'new"x'} and json.loads(got[1].b) == {"model": 'new"x'}
