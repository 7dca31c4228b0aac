"""Policies of many tenants against one evaluation for each."""

import random

import pytest
from pyspark.sql import functions as F

from palisade.plans import default_policies, tenants
from palisade.plans import policy as pol

CONDITIONS = [
    "context.pii_detected",
    "!context.pii_detected && context.model == \"m1\"",
    "context.tool_count > 2 || !(context.model == \"m2\" && context.streaming)",
    "context.pii_findings.containsAny([\"email\", \"ssn\"])",
    "!(context.tool_count > 2 || context.model == \"m1\") && !(context.streaming && context.pii_detected)",
    "context.model == \"m1\" && context.model == \"m1\"",
    "context.pii_detected && !context.pii_detected",
    "true",
]


def policies(rnd):
    out = []
    for i in range(rnd.randint(0, 7)):
        kind = rnd.choice(["when", "unless"])
        scope = rnd.choice(["action", 'action == X::Action::"llm.request"', 'action == X::Action::"llm.response"'])
        notes = rnd.choice([f'@id("p{i}")', ""]) + rnd.choice(['@enforcement("flag")', '@enforcement("hold") @hold_message("w")', '@enforcement("transform") @transform_pattern("a")', ""]) + '@regulatory_mapping("A, B")'
        out.append(f"{notes} {rnd.choice(['forbid', 'forbid', 'permit'])}(principal, {scope}, resource) {kind} {{ {rnd.choice(CONDITIONS)} }};")
    return pol.parse("\n".join(out))


def contexts(spark, rnd, ids):
    rows = [(rnd.choice(ids), rnd.choice(["v1", None]), rnd.choice(["llm.request", "llm.response"]), f"m{rnd.randint(1, 3)}", rnd.random() < 0.5, rnd.random() < 0.5, rnd.randint(0, 4), rnd.choice([["email"], [], ["x"]])) for _ in range(300)]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, tenant_id string, policy_version string, action string, model string, pii_detected boolean, streaming boolean, tool_count long, pii_findings array<string>")


def decided(frame):
    return {r.n: r.decision for r in frame.select("n", "decision").collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_one_at_a_time(spark, seed):
    rnd = random.Random(seed)
    sets = {(f"t{i}", v): policies(rnd) for i in range(4) for v in ("v1", "")} | {tenants.BASELINE: policies(rnd)}
    rows = contexts(spark, rnd, ["t0", "t1", "t2", "t3", "other", None])
    got = decided(tenants.evaluate(tenants.Compiled(sets), rows))
    assert len(got) == 300
    for key, ps in sets.items():
        mine = rows.where((F.coalesce("tenant_id", F.lit("")) == key[0]) & (F.coalesce("policy_version", F.lit("")) == key[1])) if key != tenants.BASELINE else rows.where("coalesce(tenant_id, 'other') = 'other'")
        for n, d in decided(pol.evaluate(ps, mine)).items():
            assert got[n] == d, (key, n)


def test_without_a_baseline_everything_is_permitted(spark):
    rows = contexts(spark, random.Random(3), ["t0", "x"])
    out = tenants.evaluate(tenants.Compiled({("t0", "v1"): pol.parse("forbid(principal, action, resource);")}), rows)
    got = {(r.tenant_id, r.policy_version, r.decision.action) for r in out.collect()}
    assert got == {("t0", "v1", "block"), ("t0", None, "allow"), ("x", "v1", "allow"), ("x", None, "allow")}


def test_more_bits_than_a_word(spark):
    sets = {(f"t{i}", ""): pol.parse(f'@id("r{i}") forbid(principal, action, resource) when {{ context.tool_count > {i} }};\npermit(principal, action, resource);') for i in range(200)}
    compiled = tenants.Compiled(sets)
    assert compiled.words == 4 and len(compiled.bit) == 200
    rows = spark.createDataFrame([(i, f"t{i}", None, 100) for i in range(200)], "n int, tenant_id string, policy_version string, tool_count long")
    got = decided(tenants.evaluate(compiled, rows))
    assert all((d.action == "block") == (n < 100) and (d.rule_id == f"r{n}") == (n < 100) for n, d in got.items())


def test_too_many_alternatives():
    many = " && ".join(f"(context.tool_count > {2 * i} || context.tool_count < -{2 * i + 1})" for i in range(10))
    with pytest.raises(pol.PolicyError, match="alternatives"):
        tenants.Compiled({tenants.BASELINE: pol.parse(f"forbid(principal, action, resource) when {{ {many} }};")})


def test_shipped_policies(spark):
    rows = contexts(spark, random.Random(4), ["t0"])
    ps = default_policies.policies()
    assert decided(tenants.evaluate(tenants.Compiled({tenants.BASELINE: ps}), rows)) == decided(pol.evaluate(ps, rows))
