"""Policies of all tenants in one plan.

Tenants' policies share most of their conditions.  Every condition is taken apart
into comparisons; each distinct one is evaluated once a row, into a bit.  A policy
is then a few pairs of masks: bits that must be set and bits that must not be.
The masks are a table by tenant and version, so a decision is one projection, one
join with a catalog and one fold over the tenant's policies, however many tenants
there are.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.plans import policy as pol

#: Bits of one word of a mask; the sign bit stays free.
_WORD = 62
#: Alternatives of one policy; beyond them the conditions should be rewritten.
MOST_CLAUSES = 512
_CLAUSE = "struct<yes:array<bigint>,no:array<bigint>>"
_RULE = f"struct<rank:int,order:int,permits:boolean,action:string,rule_id:string,named:boolean,category:string,regulatory_mapping:array<string>,description:string,hold_message:string,transform_pattern:string,transform_replace:string,clauses:array<{_CLAUSE}>>"
#: The row for tenants that have no policies of their own.
BASELINE = ("", "")

Clause = tuple[frozenset[str], frozenset[str]]


def _clauses(node, positive: bool = True) -> list[Clause]:
    """Alternatives of a condition: the comparisons that must hold and those that must not."""
    op = node[0]
    if op == "!":
        return _clauses(node[1], not positive)
    if op in ("&&", "||"):
        parts = [_clauses(x, positive) for x in node[1:]]
        if (op == "||") == positive:
            return _least([c for p in parts for c in p])
        return _all(parts)
    sql = pol.to_sql(node)
    return [(frozenset([sql]), frozenset())] if positive else [(frozenset(), frozenset([sql]))]


def _all(parts: list[list[Clause]]) -> list[Clause]:
    out: list[Clause] = [(frozenset(), frozenset())]
    for part in parts:
        out = _least([(y | a, n | b) for y, n in out for a, b in part])
        if len(out) > MOST_CLAUSES:
            raise pol.PolicyError(f"a condition has more than {MOST_CLAUSES} alternatives")
    return out


def _least(clauses: list[Clause]) -> list[Clause]:
    """Each alternative once, without those that cannot hold."""
    return list(dict.fromkeys(c for c in clauses if not c[0] & c[1]))


def clauses(p: pol.Policy) -> list[Clause]:
    parts = [[(frozenset([f"(action = {pol.SPARK.text(p.action)})"]), frozenset())]] if p.action else []
    return _all([*parts, *(_clauses(w) for w in p.when), *(_clauses(u, False) for u in p.unless)])


class Compiled:
    """The comparisons of all tenants' policies, and the policies as masks over them."""

    def __init__(self, policies: Mapping[tuple[str, str], list[pol.Policy]]):
        """``policies`` by (tenant_id, version); ``BASELINE`` is for everybody else."""
        found = {key: [(p, clauses(p)) for p in ps or [pol.Policy("permit", 0)]] for key, ps in policies.items()}
        names = sorted({a for ps in found.values() for _, cs in ps for yes, no in cs for a in yes | no})
        self.bit = {a: i for i, a in enumerate(names)}
        self.words = max(1, -(-len(names) // _WORD))
        self.rows = [(*key, [self._rule(p, cs) for p, cs in ps]) for key, ps in found.items()]

    def _mask(self, atoms: frozenset[str]) -> list[int]:
        out = [0] * self.words
        for a in atoms:
            out[self.bit[a] // _WORD] |= 1 << self.bit[a] % _WORD
        return out

    def _rule(self, p: pol.Policy, cs: list[Clause]) -> tuple:
        a = p.annotations
        pattern = a.get("transform_pattern")
        return (pol.RANKS[p.enforcement], -p.order, p.effect == "permit", p.enforcement, p.rule_id, "id" in a, a.get("category"), p.frameworks, a.get("description"), a.get("hold_message"), pattern, a.get("transform_replace", "[REDACTED]") if pattern else None, [(self._mask(y), self._mask(n)) for y, n in cs])

    def table(self, spark: SparkSession) -> DataFrame:
        """tenant_id, version and rules."""
        return spark.createDataFrame(self.rows, f"tenant_id string, version string, rules array<{_RULE}>")

    def bits(self) -> Column:
        """The words of a row's mask."""
        words = []
        for w in range(self.words):
            bits = [f"CASE WHEN {a} THEN {1 << i % _WORD}L ELSE 0L END" for a, i in self.bit.items() if i // _WORD == w]
            words.append(F.expr(" | ".join(bits) or "0L"))
        return F.array(*words)


def _holds(rule: Column, bits: Column, words: int) -> Column:
    def clause(c: Column) -> Column:
        out = F.lit(True)
        for w in range(words):
            yes, no = c["yes"][w], c["no"][w]
            out = out & (bits[w].bitwiseAND(yes) == yes) & (bits[w].bitwiseAND(no) == 0)
        return out

    return F.exists(rule["clauses"], clause)


def evaluate(compiled: Compiled, contexts: DataFrame) -> DataFrame:
    """``contexts`` (tenant_id, policy_version, action and any facts) with a decision column, as ``policy.evaluate`` gives it.

    Rows whose tenant and version have no policies are decided by the baseline.
    """
    spark = contexts.sparkSession
    full = pol.with_defaults(contexts).withColumn("_bits", compiled.bits())
    table = compiled.table(spark)
    base = next((r[2] for r in compiled.rows if r[:2] == BASELINE), [Compiled({BASELINE: []}).rows[0][2][0]])
    # The baseline is one row: it is joined to all, tenants' own to theirs.
    baseline = spark.createDataFrame([(base,)], f"_base array<{_RULE}>")
    own = table.select(F.col("tenant_id").alias("_tenant"), F.col("version").alias("_version"), F.col("rules").alias("_own"))
    joined = full.join(own, (F.col("tenant_id") == F.col("_tenant")) & (F.coalesce("policy_version", F.lit("")) == F.col("_version")), "left").join(F.broadcast(baseline))
    met = F.filter(F.coalesce("_own", "_base"), lambda r: _holds(r, F.col("_bits"), compiled.words))
    rows = joined.withColumn("_met", met).withColumn("_forbids", F.filter("_met", lambda r: ~r["permits"]))
    found = F.when(F.size("_forbids") > 0, F.col("_forbids")).otherwise(F.col("_met"))
    rows = rows.withColumn("_found", found).withColumn("_won", F.array_max(F.transform("_found", lambda r: r.dropFields("clauses"))))
    won = F.col("_won")
    matched = F.transform(F.filter("_found", lambda r: r["named"]), lambda r: F.struct(r["rule_id"].alias("rule_id"), r["action"].alias("action"), r["category"].alias("category"), r["regulatory_mapping"].alias("regulatory_mapping")))
    decision = F.struct(
        F.coalesce(won["action"], F.lit("block")).alias("action"),
        *(won[c].alias(c) for c in ("rule_id", "description", "hold_message", "transform_pattern", "transform_replace")),
        F.coalesce(won["regulatory_mapping"], F.array().cast("array<string>")).alias("regulatory_mapping"),
        matched.alias("matched_rules"),
    )
    return rows.withColumn("decision", decision).drop("_bits", "_tenant", "_version", "_own", "_base", "_met", "_forbids", "_found", "_won")
