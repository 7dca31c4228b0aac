"""Declarative policies compiled to SQL expressions.

A policy text is parsed on the driver into an AST; every condition becomes one
SQL boolean over the columns of the fact row, so a decision is a projection that
Catalyst prunes and generates code for.  Names and methods that are not known are
an error at compile time, never a silent false.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Actions by severity.
RANKS = {"allow": 0, "transform": 1, "flag": 2, "hold": 3, "block": 4}
BODY_ACTIONS = ("transform", "hold", "block")

# The fact row, by name and type, with defaults.
CONTEXT: dict[str, tuple[str, object]] = {
    "model": ("string", ""), "streaming": ("boolean", False), "pii_detected": ("boolean", False), "pii_findings": ("array<string>", None), "risk_level": ("string", ""),
    "tool_name": ("string", ""), "tool_names": ("array<string>", None), "tool_count": ("bigint", 0), "requested_tools": ("array<string>", None),
    "budget_remaining_cents": ("bigint", -1), "budget_utilization_pct": ("bigint", 0), "injection_detected": ("boolean", False), "jailbreak_detected": ("boolean", False),
    "threat_detected": ("boolean", False), "identity_claim_detected": ("boolean", False), "confidential_detected": ("boolean", False), "bias_detected": ("boolean", False),
    "exfiltration_detected": ("boolean", False), "exfiltration_type": ("string", ""), "unauthorized_tool_detected": ("boolean", False), "tool_categories": ("array<string>", None),
    "tool_highest_risk_category": ("string", ""), "tool_allowlist_mode": ("boolean", False), "fallback_available": ("boolean", False), "model_approved": ("boolean", False),
    "consent_given": ("boolean", False), "anomaly_detected": ("boolean", False), "anomaly_type": ("string", ""), "data_residency_compliant": ("boolean", True),
    "org_timezone": ("string", ""), "org_industry": ("string", ""), "org_region": ("string", ""), "org_business_hours_active": ("boolean", False),
    "mcp_server_approved": ("boolean", True), "mcp_server_id": ("string", ""),
}

# Names in families, and the flat facts they stand for.
FAMILIES = {
    "agent_integrity.injection_detected": "injection_detected",
    "agent_integrity.jailbreak_detected": "jailbreak_detected",
    "data_protection.pii_present": "pii_detected",
    "data_protection.confidential_detected": "confidential_detected",
    "data_protection.exfiltration_detected": "exfiltration_detected",
    "content_safety.threat_detected": "threat_detected",
    "content_safety.bias_detected": "bias_detected",
    "identity_safety.disclosure_detected": "identity_claim_detected",
    "tool_governance.unauthorized_detected": "unauthorized_tool_detected",
    "supply_chain.mcp_server_approved": "mcp_server_approved",
    "supply_chain.mcp_server_id": "mcp_server_id",
}

# Detectors behind facts, by what a fact's name holds; the first that fits counts.
FACT_DETECTORS = (("injection", "injection"), ("jailbreak", "jailbreak"), ("pii", "pii"), ("exfiltration", "exfiltration"), ("confidential", "confidential"), ("toxicity", "toxicity"), ("threat", "threat"), ("identity_claim", "identity_claim"), ("disclosure", "identity_claim"), ("unauthorized_tool", "tool_governance"), ("tool_governance", "tool_governance"), ("identity_safety", "identity_claim"))


class PolicyError(ValueError):
    """A policy text that does not parse or names something unknown."""


@dataclass(frozen=True)
class Policy:
    effect: str
    order: int
    annotations: dict[str, str] = field(default_factory=dict)
    action: str | None = None
    when: tuple = ()
    unless: tuple = ()

    @property
    def rule_id(self) -> str:
        return self.annotations.get("id") or f"policy{self.order}"

    @property
    def enforcement(self) -> str:
        named = self.annotations.get("enforcement", "").lower()
        return named if named in RANKS else "block" if self.effect == "forbid" else "allow"

    @property
    def enforcing(self) -> bool:
        """Whether what it reads must be known before the decision."""
        named = self.annotations.get("enforcement")
        return named in BODY_ACTIONS if named is not None else self.effect == "forbid"

    @property
    def frameworks(self) -> list[str]:
        return [x.strip() for x in self.annotations.get("regulatory_mapping", "").split(",") if x.strip()]


# --- parsing ----------------------------------------------------------------------

_TOKEN = re.compile(r'\s+|//[^\n]*|(?P<string>"(?:[^"\\]|\\.)*")|(?P<number>-?\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>::|==|!=|<=|>=|&&|\|\||[@()\[\]{}.,;:<>!])')


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise PolicyError(f"unexpected {text[at : at + 20]!r}")
        if m.lastgroup:
            out.append((m.lastgroup, m.group()))
        at = m.end()
    return [*out, ("end", "")]


def _unquote(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}.get(m[1], m[1]), s[1:-1])


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at = _tokens(text), 0

    def peek(self, k: int = 0) -> str:
        return self.tokens[min(self.at + k, len(self.tokens) - 1)][1]

    def take(self, want: str | None = None) -> str:
        kind, value = self.tokens[self.at]
        if want is not None and value != want:
            raise PolicyError(f"expected {want!r}, found {value or 'the end'!r}")
        self.at += kind != "end"
        return value

    def string(self) -> str:
        if self.tokens[self.at][0] != "string":
            raise PolicyError(f"expected a string, found {self.peek()!r}")
        return _unquote(self.take())

    def policies(self) -> list[Policy]:
        out = []
        while self.tokens[self.at][0] != "end":
            out.append(self.policy(len(out)))
        return out

    def policy(self, order: int) -> Policy:
        notes: dict[str, str] = {}
        while self.peek() == "@":
            self.take()
            name = self.take()
            self.take("(")
            notes[name] = self.string()
            self.take(")")
        effect = self.take()
        if effect not in ("permit", "forbid"):
            raise PolicyError(f"expected permit or forbid, found {effect!r}")
        self.take("(")
        self.take("principal")
        self.take(",")
        self.take("action")
        action = None
        if self.peek() == "==":
            self.take()
            action = self.entity()
        self.take(",")
        self.take("resource")
        self.take(")")
        bodies: dict[str, list] = {"when": [], "unless": []}
        while self.peek() in bodies:
            kind = self.take()
            self.take("{")
            bodies[kind].append(self.either())
            self.take("}")
        self.take(";")
        return Policy(effect, order, notes, action, tuple(bodies["when"]), tuple(bodies["unless"]))

    def entity(self) -> str:
        self.take()
        while self.peek() == "::":
            self.take()
            if self.tokens[self.at][0] == "string":
                return self.string()
            self.take()
        raise PolicyError("an entity needs an id")

    def _chain(self, op: str, part):
        first = part()
        rest = []
        while self.peek() == op:
            self.take()
            rest.append(part())
        return (op, first, *rest) if rest else first

    def either(self):
        return self._chain("||", self.both)

    def both(self):
        return self._chain("&&", self.relation)

    def relation(self):
        left = self.unary()
        op = self.peek()
        if op in ("==", "!=", "<", "<=", ">", ">="):
            self.take()
            return op, left, self.unary()
        if op == "has":
            self.take()
            return "has", left, self.string() if self.tokens[self.at][0] == "string" else self.take()
        if op == "like":
            self.take()
            return "like", left, self.take()
        if op == "in":
            self.take()
            return "in", left, self.unary()
        return left

    def unary(self):
        if self.peek() == "!":
            self.take()
            return "!", self.unary()
        return self.member()

    def member(self):
        kind, value = self.tokens[self.at]
        if value == "(":
            self.take()
            node = self.either()
            self.take(")")
        elif value == "[":
            self.take()
            items = []
            while self.peek() != "]":
                items.append(self.unary())
                if self.peek() == ",":
                    self.take()
            self.take("]")
            node = ("list", *items)
        elif kind == "string":
            node = ("value", self.string())
        elif kind == "number":
            node = ("value", int(self.take()))
        elif value in ("true", "false"):
            node = ("value", self.take() == "true")
        elif value == "context":
            self.take()
            node = ("context",)
        else:
            raise PolicyError(f"unexpected {value or 'end'!r} in a condition")
        while self.peek() == ".":
            self.take()
            name = self.take()
            if self.peek() == "(":
                self.take()
                arg = self.either()
                self.take(")")
                if name not in ("contains", "containsAny", "containsAll"):
                    raise PolicyError(f"unknown method {name}")
                node = (name, node, arg)
            elif node[0] in ("context", "attr"):
                node = ("attr", *node[1:], name)
            else:
                raise PolicyError(f"no attribute {name} here")
        return node


def parse(text: str, aliases: Mapping[str, str] | None = None) -> list[Policy]:
    """The policies of a text.  ``aliases`` maps foreign annotation names and enforcement values to the ones used here."""
    found = _Parser(text).policies()
    if not aliases:
        return found
    known = lambda x: aliases.get(x, x)
    return [replace(p, annotations={known(k): known(v) if known(k) == "enforcement" else v for k, v in p.annotations.items()}) for p in found]


# --- compiling ---------------------------------------------------------------------


class Dialect:
    """How a condition is written: for Spark, or for another SQL engine to check against."""

    def __init__(self, spark: bool = True):
        self.spark = spark

    def text(self, s: str) -> str:
        return "'" + (s.replace("\\", "\\\\") if self.spark else s).replace("'", "\\'" if self.spark else "''") + "'"

    def array(self, items: list[str]) -> str:
        return f"array({', '.join(items)})" if self.spark else f"[{', '.join(items)}]"

    def contains(self, a: str, x: str) -> str:
        return f"array_contains({a}, {x})" if self.spark else f"list_contains({a}, {x})"

    def any(self, a: str, b: str) -> str:
        return f"arrays_overlap({a}, {b})" if self.spark else f"list_has_any({a}, {b})"

    def all(self, a: str, b: str) -> str:
        return f"size(array_except({b}, {a})) = 0" if self.spark else f"list_has_all({a}, {b})"


SPARK = Dialect()


def _attribute(path: tuple[str, ...]) -> str:
    name = FAMILIES.get(".".join(path), path[0] if len(path) == 1 else "")
    if name not in CONTEXT:
        raise PolicyError(f"unknown attribute context.{'.'.join(path)}")
    return name


def to_sql(node, d: Dialect = SPARK) -> str:
    op = node[0]
    if op in ("||", "&&"):
        return "(" + {"||": " OR ", "&&": " AND "}[op].join(to_sql(x, d) for x in node[1:]) + ")"
    if op == "!":
        return f"(NOT {to_sql(node[1], d)})"
    if op in ("==", "!=", "<", "<=", ">", ">="):
        return f"({to_sql(node[1], d)} {({'==': '=', '!=': '<>'}).get(op, op)} {to_sql(node[2], d)})"
    if op == "value":
        v = node[1]
        return d.text(v) if isinstance(v, str) else str(v).upper() if isinstance(v, bool) else str(v)
    if op == "list":
        return d.array([to_sql(x, d) for x in node[1:]])
    if op == "attr":
        return _attribute(node[1:])
    if op == "has":
        # Every known fact is always there.
        path = (*node[1][1:], node[2])
        known = _try_attribute(path) or any(k.startswith(".".join(path) + ".") for k in FAMILIES)
        return "TRUE" if known else "FALSE"
    if op == "like":
        if not node[2].startswith('"'):
            raise PolicyError("like needs a literal pattern")
        pattern = re.escape(node[2][1:-1]).replace(r"\\\*", r"\*").replace(r"\*", ".*")
        return f"regexp_like({to_sql(node[1], d)}, {d.text('^(?s:' + pattern + ')$')})" if d.spark else f"regexp_matches({to_sql(node[1], d)}, {d.text('^(?s:' + pattern + ')$')})"
    if op == "in" or op == "contains":
        a, x = (node[2], node[1]) if op == "in" else (node[1], node[2])
        if a == ("list",):
            return "FALSE"
        return d.contains(to_sql(a, d), to_sql(x, d))
    if op in ("containsAny", "containsAll"):
        if node[2] == ("list",):
            return "TRUE" if op == "containsAll" else "FALSE"
        return {"containsAny": d.any, "containsAll": d.all}[op](to_sql(node[1], d), to_sql(node[2], d))
    raise PolicyError(f"cannot compile {op}")


def _try_attribute(path: tuple[str, ...]) -> bool:
    try:
        return bool(_attribute(path))
    except PolicyError:
        return False


def condition_sql(p: Policy, d: Dialect = SPARK) -> str:
    """Scope and conditions of a policy over the columns ``action`` and the facts."""
    parts = [f"action = {d.text(p.action)}"] if p.action else []
    parts += [to_sql(w, d) for w in p.when] + [f"(NOT {to_sql(u, d)})" for u in p.unless]
    return f"coalesce({' AND '.join(parts) or 'TRUE'}, FALSE)"


def validate(policies: list[Policy]) -> None:
    """Raise where a policy names a fact or method that is not known."""
    for p in policies:
        condition_sql(p)


# --- deciding ---------------------------------------------------------------------


def decision(policies: list[Policy]) -> Column:
    """struct(action, rule_id, description, hold_message, transform_pattern, transform_replace, regulatory_mapping, matched_rules).

    Any satisfied forbid makes the forbids the reasons; else the satisfied
    permits are; with neither the answer is block.  The strictest reason wins,
    the first in the text among equals.
    """
    validate(policies)

    def reasons(effect: str) -> Column:
        rows = []
        for p in (q for q in policies if q.effect == effect):
            a = p.annotations
            pattern = a.get("transform_pattern")
            row = F.struct(
                F.lit(RANKS[p.enforcement]).alias("rank"),
                F.lit(-p.order).alias("order"),
                F.lit(p.enforcement).alias("action"),
                F.lit(p.rule_id).alias("rule_id"),
                F.lit("id" in a).alias("named"),
                F.lit(a.get("category")).cast("string").alias("category"),
                F.array(*(F.lit(x) for x in p.frameworks)).cast("array<string>").alias("regulatory_mapping"),
                F.lit(a.get("description")).cast("string").alias("description"),
                F.lit(a.get("hold_message")).cast("string").alias("hold_message"),
                F.lit(pattern).cast("string").alias("transform_pattern"),
                F.lit(a.get("transform_replace", "[REDACTED]") if pattern else None).cast("string").alias("transform_replace"),
            )
            rows.append(F.when(F.expr(condition_sql(p)), row))
        none = "array<struct<rank:int,order:int,action:string,rule_id:string,named:boolean,category:string,regulatory_mapping:array<string>,description:string,hold_message:string,transform_pattern:string,transform_replace:string>>"
        return F.filter(F.array(*rows), lambda x: x.isNotNull()).cast(none) if rows else F.array().cast(none)

    if not policies:  # no policy at all permits everything
        policies = [Policy("permit", 0)]
    forbids, permits = reasons("forbid"), reasons("permit")
    found = F.when(F.size(forbids) > 0, forbids).otherwise(permits)
    won = F.array_max(found)
    matched = F.transform(F.filter(found, lambda r: r["named"]), lambda r: F.struct(r["rule_id"].alias("rule_id"), r["action"].alias("action"), r["category"].alias("category"), r["regulatory_mapping"].alias("regulatory_mapping")))
    return F.struct(
        F.coalesce(won["action"], F.lit("block")).alias("action"),
        won["rule_id"].alias("rule_id"),
        won["description"].alias("description"),
        won["hold_message"].alias("hold_message"),
        won["transform_pattern"].alias("transform_pattern"),
        won["transform_replace"].alias("transform_replace"),
        F.coalesce(won["regulatory_mapping"], F.array().cast("array<string>")).alias("regulatory_mapping"),
        matched.alias("matched_rules"),
    )


def decision_sql(policies: list[Policy], d: Dialect) -> dict[str, str]:
    """action and rule_id as plain SQL expressions, for engines without array functions."""
    rank = {}
    for effect in ("forbid", "permit"):
        cases = [f"CASE WHEN {condition_sql(p, d)} THEN {RANKS[p.enforcement]} ELSE -1 END" for p in policies if p.effect == effect]
        rank[effect] = f"greatest({', '.join(cases)}, -1)" if cases else "-1"
    won = f"(CASE WHEN {rank['forbid']} >= 0 THEN {rank['forbid']} ELSE {rank['permit']} END)"
    action = f"CASE {won} " + " ".join(f"WHEN {r} THEN '{a}'" for a, r in RANKS.items()) + " ELSE 'block' END"
    picks = [f"WHEN {rank['forbid']} {'>=' if p.effect == 'forbid' else '<'} 0 AND {won} = {RANKS[p.enforcement]} AND {condition_sql(p, d)} THEN {d.text(p.rule_id)}" for p in policies]
    return {"action": action, "rule_id": f"CASE {' '.join(picks)} END"}


def evaluate(policies: str | list[Policy], contexts: DataFrame, on_error: str = "allow") -> DataFrame:
    """``contexts`` (action and any facts; what is missing gets its default) with a decision column.

    With ``on_error`` "raise" a text that does not compile raises; else it decides
    every row as ``on_error`` says.
    """
    full = with_defaults(contexts)
    try:
        column = decision(parse(policies) if isinstance(policies, str) else policies)
    except PolicyError:
        if on_error == "raise":
            raise
        column = decision([Policy("permit" if on_error == "allow" else "forbid", 0, {"enforcement": on_error})])
    return full.withColumn("decision", column)


def with_defaults(df: DataFrame) -> DataFrame:
    """All facts as columns that are never null."""
    if "action" not in df.columns:
        df = df.withColumn("action", F.lit("llm.request"))
    new = {}
    for name, (kind, default) in CONTEXT.items():
        base = F.array().cast(kind) if default is None else F.lit(default).cast(kind)
        new[name] = F.coalesce(F.col(name).cast(kind), base) if name in df.columns else base
    return df.withColumns(new)


def resolve(*actions: Column) -> Column:
    """The strictest of several actions; allow where there is none."""
    ranks = [F.coalesce(_rank(a), F.lit(0)) for a in actions]
    top = F.greatest(*ranks) if len(ranks) > 1 else ranks[0]
    return F.element_at(F.array(*(F.lit(a) for a in RANKS)), top + 1)


def _rank(action: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for a, r in RANKS.items():
        out = out.when(action == a, r)
    return out


def final_action(request: Column, response: Column) -> Column:
    """The response's action where it is stricter, else the request's."""
    return F.when(_rank(response) > _rank(request), response).otherwise(request)


def forwarded_body(action: Column, original: Column, redacted: Column) -> Column:
    return F.when(action == "block", F.lit(None).cast("string")).when(action.isin(*BODY_ACTIONS), redacted).otherwise(original)


def client_status(action: Column, upstream: Column, error: Column) -> Column:
    """HTTP status of an interaction; ``error`` names a failure or is null."""
    out = F.when(action == "block", 400)
    # Failures and their statuses.
    for name, status in (("policy", 400), ("no_api_key", 400), ("timeout", 504), ("unreachable", 502), ("kill_switch", 503), ("hold_timeout", 503), ("capacity", 503), ("rate_limit", 429)):
        out = out.when(error == name, status)
    return out.when(error.isNotNull(), 500).otherwise(upstream)


# --- analyses -----------------------------------------------------------------------


def observe(policies: list[Policy]) -> list[Policy]:
    """Observation mode: what would block or hold is flagged instead."""
    return [replace(p, annotations={**p.annotations, "enforcement": "flag"}) if p.annotations.get("enforcement") in ("block", "hold") or p.effect == "forbid" and "enforcement" not in p.annotations else p for p in policies]


def for_mode(policies: list[Policy], mode: str) -> list[Policy]:
    """``observe`` observes; anything else enforces."""
    return observe(policies) if mode == "observe" else policies


def observe_text(text: str) -> str:
    """The same on a text: annotations turn to flag, bare forbids get one."""
    out, noted = [], False
    for line in text.split("\n"):
        bare = line.strip()
        if bare.startswith("@enforcement("):
            noted = True
            line = re.sub(r'@enforcement\("(?:block|hold)"\)', '@enforcement("flag")', line)
        elif bare.startswith("forbid(") or bare.startswith("forbid ("):
            if not noted:
                out.append('@enforcement("flag")')
            noted = False
        elif bare.startswith("permit"):
            noted = False
        out.append(line)
    return "\n".join(out)


def facts(node) -> set[str]:
    """Attributes that a condition reads, as written."""
    if node[0] == "attr":
        return {".".join(node[1:])}
    if node[0] == "has":
        return {".".join((*node[1][1:], node[2]))}
    return {f for x in node[1:] if isinstance(x, tuple) for f in facts(x)}


@dataclass(frozen=True)
class Promotion:
    """What must be known before a request's decision."""

    facts: frozenset[str]
    detectors: frozenset[str]
    response: bool

    @property
    def pii(self) -> bool:
        return "pii" in self.detectors


def promotion(policies: list[Policy]) -> Promotion:
    read: set[str] = set()
    response = False
    for p in policies:
        if p.enforcing:
            response |= p.action in ("llm.response", "tool.call")
            for w in p.when:
                read |= facts(w)
    detectors = {d for f in read if (d := detector_of(f))}
    return Promotion(frozenset(read), frozenset(detectors), response)


def detector_of(fact: str) -> str | None:
    return next((d for part, d in FACT_DETECTORS if part in fact), None)


def mask_unpromoted(df: DataFrame, need: Promotion) -> DataFrame:
    """Facts of detectors that do not run before the decision, as false."""
    known = {"injection_detected", "jailbreak_detected", "threat_detected", "identity_claim_detected", "confidential_detected", "bias_detected", "exfiltration_detected"}
    off = [f for f in known if detector_of(f) not in need.detectors]
    return df.withColumns({f: F.lit(False) for f in sorted(off) if f in df.columns})


def pattern_names(policies: list[Policy]) -> list[tuple[str, str]]:
    """(policy id, pattern name) of every literal in a containsAny."""
    out: dict[tuple[str, str], None] = {}

    def walk(p: Policy, node) -> None:
        if node[0] == "containsAny" and node[2][0] == "list":
            for x in node[2][1:]:
                out.setdefault((p.annotations.get("id", ""), x[1]))
        for x in node[1:]:
            if isinstance(x, tuple):
                walk(p, x)

    for p in policies:
        for w in (*p.when, *p.unless):
            walk(p, w)
    return list(out)


def to_frame(spark, policies: list[Policy]) -> DataFrame:
    """The policies as a dimension table."""
    rows = [(p.order, p.annotations.get("id"), p.rule_id, p.annotations.get("category"), p.effect, p.enforcement, p.action, p.annotations.get("description"), p.frameworks) for p in policies]
    return spark.createDataFrame(rows, "order int, id string, rule_id string, category string, effect string, enforcement string, action string, description string, frameworks array<string>")


def missing_patterns(spark, policies: list[Policy], compiled: DataFrame) -> DataFrame:
    """(policy_id, pattern_name) that policies name and the catalog (column pattern_name) lacks."""
    named = spark.createDataFrame(pattern_names(policies) or [("", "")], "policy_id string, pattern_name string").where("pattern_name <> ''")
    return named.join(compiled.select("pattern_name").distinct(), "pattern_name", "left_anti").select("policy_id", "pattern_name")
