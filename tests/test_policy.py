"""The policy language, decisions and analyses."""

import pytest
from pyspark.sql import functions as F

from palisade.plans import default_policies
from palisade.plans import policy as pol

PERMIT = "permit(principal, action, resource);"


def rule(body, effect="forbid", action="", **notes):
    scope = f'action == X::Action::"{action}"' if action else "action"
    return "".join(f'@{k}("{v}")\n' for k, v in notes.items()) + f"{effect}(principal, {scope}, resource)" + (f" when {{ {body} }};" if body else ";")


def decide(spark, text, **facts):
    return pol.evaluate(text, spark.createDataFrame([tuple(facts.values())], list(facts))).select("decision.*").first()


@pytest.mark.parametrize(
    ("text", "facts", "action", "rule_id"),
    [
        (PERMIT, {"tool_count": 1}, "allow", "policy0"),
        ("", {"tool_count": 1}, "allow", "policy0"),
        (rule("context.tool_count > 5"), {"tool_count": 1}, "block", None),
        (PERMIT + rule("context.tool_count > 5", id="t"), {"tool_count": 9}, "block", "t"),
        (PERMIT + rule("context.tool_count > 5", id="t", enforcement="flag"), {"tool_count": 9}, "flag", "t"),
        (PERMIT + rule("", id="a", enforcement="flag") + rule("", id="b", enforcement="hold") + rule("", id="c", enforcement="hold"), {"tool_count": 9}, "hold", "b"),
        (PERMIT + rule("", "permit", id="p", enforcement="transform", transform_pattern="x"), {"tool_count": 0}, "transform", "p"),
        (PERMIT + rule("", "permit", id="p", enforcement="transform") + rule("", id="f", enforcement="flag"), {"tool_count": 0}, "flag", "f"),
        (PERMIT + rule("", id="f", action="llm.response"), {"action": "llm.request"}, "allow", "policy0"),
        (PERMIT + rule("", id="f", enforcement="nonsense"), {"tool_count": 0}, "block", "f"),
        (PERMIT + rule('context.model like "gpt*" && !(context.tool_count >= 3 || false)', id="f"), {"model": "gpt-4o"}, "block", "f"),
        (PERMIT + rule('context.requested_tools.containsAll(["a", "b"])', id="f"), {"requested_tools": ["b", "a", "c"]}, "block", "f"),
        (PERMIT + rule('context has requested_tools && context.requested_tools.contains("d")', id="f"), {"requested_tools": ["d"]}, "block", "f"),
        (PERMIT + rule("context.agent_integrity.injection_detected", id="f"), {"injection_detected": True}, "block", "f"),
        (PERMIT + rule('["a"].contains(context.model)', id="f").replace(";", " unless { context.streaming };"), {"model": "a"}, "block", "f"),
    ],
)
def test_decision(spark, text, facts, action, rule_id):
    d = decide(spark, text, **facts)
    assert (d["action"], d["rule_id"]) == (action, rule_id)


def test_matched_rules_and_mapping(spark):
    d = decide(spark, PERMIT + rule("", id="a", category="c", enforcement="flag", regulatory_mapping="X, Y") + rule(""), tool_count=0)
    assert d["action"] == "block" and d["rule_id"] == "policy2" and [(m["rule_id"], m["action"]) for m in d["matched_rules"]] == [("a", "flag")]


@pytest.mark.parametrize("text", ["forbid(", "forbid(principal, action, resource) when { context.nothing == 1 };", "forbid(principal, action, resource) when { context.model.size() };", 'permit(principal, action, resource) when { 1 + 1 };'])
def test_errors(spark, text):
    with pytest.raises(pol.PolicyError):
        pol.validate(pol.parse(text))
    df = spark.createDataFrame([(1,)], "tool_count long")
    assert pol.evaluate(text, df).select("decision.action").first()[0] == "allow"
    assert pol.evaluate(text, df, on_error="block").select("decision.action").first()[0] == "block"


def test_observation():
    text = PERMIT + "\n" + rule("", id="a", enforcement="block") + "\n" + rule("") + "\n" + rule("", id="t", enforcement="transform")
    assert [p.enforcement for p in pol.observe(pol.parse(text))] == ["allow", "flag", "flag", "transform"]
    assert [p.enforcement for p in pol.parse(pol.observe_text(text))] == ["allow", "flag", "flag", "transform"]
    assert pol.for_mode(pol.parse(text), "enforce")[1].enforcement == "block"


def test_promotion_of_the_baseline():
    p = pol.promotion(default_policies.policies())
    assert p.pii and p.detectors == {"pii", "exfiltration"} and p.response


def test_baseline_never_blocks_when_observed(spark):
    df = spark.createDataFrame([(0, ["jwt"], "prohibited")], "budget_remaining_cents long, pii_findings array<string>, risk_level string")
    assert pol.evaluate(default_policies.policies(), df).select("decision.action").first()[0] == "block"
    assert pol.evaluate(pol.observe(default_policies.policies()), df).select("decision.action").first()[0] == "flag"


def test_missing_patterns(spark):
    compiled = spark.createDataFrame([("email",)], "pattern_name string")
    text = rule('context.pii_findings.containsAny(["email", "ssn", "ssn"])', id="a") + rule('context.pii_findings.containsAny(["jwt"])')
    got = {tuple(r) for r in pol.missing_patterns(spark, pol.parse(text), compiled).collect()}
    assert got == {("a", "ssn"), ("", "jwt")}


def test_rank_helpers(spark):
    row = spark.createDataFrame([("flag", "transform")], "a string, b string").select(pol.resolve(F.col("a"), F.col("b")).alias("x"), pol.final_action(F.col("b"), F.col("a")).alias("y"), pol.final_action(F.col("a"), F.col("b")).alias("z")).first()
    assert tuple(row) == ("flag", "flag", "flag")
