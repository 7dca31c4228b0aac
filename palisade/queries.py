"""The query catalog over the driver's tables, with equivalent SQL for checking.

Every entry applies operators of this library to whole tables.  Phrases from
``probes`` are appended by id so that detectors have something to find.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.functions import detectors as det
from palisade.functions import pii, text
from palisade.functions.patterns import DETECTORS, PII, TOOL_CATEGORIES, URL, URL_WITH_PARAMS
from palisade.operators import audit, economics, rollups, routing
from palisade.plans import default_policies
from palisade.plans import policy as pol
from palisade.plans import tenants
from palisade.probes import PROBES, TOOLS
from palisade.streaming import buffer, frames, live, scan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DUCK = pol.Dialect(spark=False)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Text scans on all cores: a small table in few files is dealt out first, others are read as they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    small = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 256 << 20
    return df.repartition(cores) if small and len(df.inputFiles()) < cores else df


def q(s: str) -> str:
    """A string as a SQL literal."""
    return "'" + s.replace("'", "''") + "'"


def lits(items) -> Column:
    return F.array(*(F.lit(x) for x in items))


def duck_list(items) -> str:
    return "[" + ", ".join(q(x) for x in items) + "]"


def pick(items, key: Column) -> Column:
    return F.element_at(lits(items), (key % len(items) + 1).cast("int"))


def duck_pick(items, key: str) -> str:
    return f"{duck_list(items)}[CAST({key} % {len(items)} AS INT) + 1]"


def rx(t: str, pattern: str) -> str:
    return f"regexp_matches({t}, {q(pattern)})"


def any_rx(t: str, patterns) -> str:
    return "(" + " OR ".join(rx(t, p.regex) for p in patterns) + ")"


# --- texts -------------------------------------------------------------------------


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "lang", "source", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), pick(PROBES, F.col("doc_id"))).alias("t"))


DOCS = f"docs AS (SELECT doc_id, lang, source, coalesce(text, '') || ' ' || {duck_pick(PROBES, 'doc_id')} AS t FROM documents)"


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request for each conversation: its user turns, then a probe."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ")
    return c.groupBy("conv_id").agg(joined.alias("user_text")).withColumn("t", F.concat("user_text", F.lit(" "), pick(PROBES, F.col("conv_id"))))


REQS = f"reqs AS (SELECT conv_id, user_text, user_text || ' ' || {duck_pick(PROBES, 'conv_id')} AS t FROM (SELECT conv_id, string_agg(text, ' ' ORDER BY turn, text) AS user_text FROM conversations WHERE role = 'user' GROUP BY conv_id))"

# --- personal data -------------------------------------------------------------------

_counts_sql = " UNION ALL ".join(f"SELECT doc_id, lang, source, {q(p.name)} AS pattern, CAST(len(regexp_extract_all(t, {q(p.regex)})) AS BIGINT) AS n FROM docs" for p in PII)


def _counts(d: DataFrame, *keep: str) -> DataFrame:
    found = pii.scan_only(F.col("t"), "request")
    return d.select(*keep, F.explode(found).alias("f")).select(*keep, F.col("f.pattern").alias("pattern"), F.col("f.count").cast("long").alias("n"))


@query("pii_scan_counts", f"WITH {DOCS}, c AS ({_counts_sql}) SELECT doc_id, pattern, n FROM c WHERE n > 0")
def _(spark, d):
    return _counts(documents(spark, d), "doc_id")


@query("pii_by_source", f"WITH {DOCS}, c AS ({_counts_sql}) SELECT source, lang, pattern, CAST(sum(n) AS BIGINT) AS matches, count(*) AS docs FROM c WHERE n > 0 GROUP BY ALL")
def _(spark, d):
    return _counts(documents(spark, d), "source", "lang").groupBy("source", "lang", "pattern").agg(F.sum("n").alias("matches"), F.count("*").alias("docs"))


@query("pii_has_any", f"WITH {DOCS} SELECT doc_id, {any_rx('t', PII)} AS has_pii FROM docs")
def _(spark, d):
    return documents(spark, d).select("doc_id", pii.has_pii(F.col("t")).alias("has_pii"))


def redact_steps(source: str, keys: str) -> list[str]:
    """CTEs r0 on: column t of ``source`` with matches replaced is column r of the last one."""
    steps = [f"r0 AS (SELECT {keys}, t, t AS r FROM {source})"]
    for i, p in enumerate(PII):
        steps.append(f"r{i + 1} AS (SELECT {keys}, t, CASE WHEN strlen(t) >= {pii.LEAST_BYTES} AND {rx('t', p.regex)} THEN regexp_replace(r, {q(p.regex)}, {q(p.token)}, 'g') ELSE r END AS r FROM r{i})")
    return steps


REDACTED = f"r{len(PII)}"


@query("pii_redact_text", f"WITH {DOCS}, {', '.join(redact_steps('docs', 'doc_id'))} SELECT doc_id, md5(r) AS redacted_md5, r <> t AS changed FROM {REDACTED}")
def _(spark, d):
    r = pii.scan_and_redact(documents(spark, d), "t", "request")
    return r.select("doc_id", F.md5(F.col("redacted_text").cast("binary")).alias("redacted_md5"), (F.col("redacted_text") != F.col("t")).alias("changed"))


_VALUES = f"""v AS (SELECT doc_id, regexp_replace(t, '["\\\\\\n\\r\\t]', ' ', 'g') AS t FROM docs)"""


@query("pii_redact_response", f"""WITH {DOCS}, {_VALUES}, {', '.join(redact_steps('v', 'doc_id'))} SELECT doc_id, md5('{{"choices":[{{"message":{{"content":"' || r || '"}}}}]}}') AS body_md5 FROM {REDACTED}""")
def _(spark, d):
    body = F.concat(F.lit('{"choices":[{"message":{"content":"'), F.regexp_replace("t", r'["\\\n\r\t]', " "), F.lit('"}}]}'))
    return documents(spark, d).select("doc_id", F.md5(pii.redact_response(body).cast("binary")).alias("body_md5"))


@query("pii_quality_join", f"WITH {DOCS} SELECT quality, toxic, count(*) AS docs, count(*) FILTER ({any_rx('t', PII)}) AS with_pii FROM docs JOIN labels USING (doc_id) GROUP BY ALL")
def _(spark, d):
    rows = documents(spark, d).join(table(spark, d, "labels"), "doc_id")
    return rows.groupBy("quality", "toxic").agg(F.count("*").alias("docs"), F.count_if(pii.has_pii(F.col("t"))).alias("with_pii"))


# --- detectors ----------------------------------------------------------------------


def _detector_query(name: str, patterns) -> None:
    rows = " UNION ALL ".join(f"SELECT doc_id, {q(p.name)} AS pattern_name, {q(p.category)} AS category, regexp_extract(t, {q(p.regex)}) AS m FROM docs WHERE {rx('t', p.regex)}" for p in patterns)
    within = "CASE WHEN strlen(m) > 200 THEN left(m, list_max(list_filter(range(0, 201), lambda k: strlen(left(m, k)) <= 200))) || '...' ELSE m END"

    @query(f"detector_{name}", f"WITH {DOCS} SELECT doc_id, pattern_name, category, {within} AS matched_text FROM ({rows})")
    def _(spark, d):
        f = documents(spark, d).select("doc_id", F.explode(det.findings(F.col("t"), patterns)).alias("f"))
        return f.select("doc_id", "f.pattern_name", "f.category", "f.matched_text")


for _name, _patterns in DETECTORS.items():
    _detector_query(_name, _patterns)


@query("detector_types", f"WITH {DOCS} SELECT doc_id, " + ", ".join(f"CASE {' '.join(f'WHEN {rx("t", p.regex)} THEN {q(p.category)}' for p in ps)} ELSE '' END AS {n}_type" for n, ps in DETECTORS.items()) + " FROM docs")
def _(spark, d):
    return documents(spark, d).select("doc_id", *(det.first_category(F.col("t"), ps).alias(f"{n}_type") for n, ps in DETECTORS.items()))


@query("url_features", f"SELECT page_id, CAST(len(regexp_extract_all(html, {q(URL)})) AS BIGINT) AS url_count, {rx('html', URL_WITH_PARAMS)} AS has_params FROM pages")
def _(spark, d):
    h = F.col("html")
    return spread(table(spark, d, "pages")).select("page_id", det.count_urls(h).alias("url_count"), det.has_params(h).alias("has_params"))


# --- tools ----------------------------------------------------------------------------


def _event_tools(spark, d) -> DataFrame:
    e = F.col("event_id")
    return spread(table(spark, d, "events")).select("event_id", F.array(pick(TOOLS, e), pick(TOOLS, F.floor(e / 3)), F.col("event_type")).alias("tools"))


EVENT_TOOLS = f"et AS (SELECT event_id, [{duck_pick(TOOLS, 'event_id')}, {duck_pick(TOOLS, '(event_id // 3)')}, event_type] AS tools FROM events)"


def _tool_cats(x: str) -> str:
    whole = "list_filter([" + ", ".join(f"CASE WHEN {rx(x, c.regex)} THEN {q(c.name)} END" for c in TOOL_CATEGORIES) + "], lambda v: v IS NOT NULL)"
    words = "list_filter([" + ", ".join(f"CASE WHEN len(list_filter(string_split({x}, '_'), lambda w: {rx('w', c.regex)})) > 0 THEN {q(c.name)} END" for c in TOOL_CATEGORIES) + "], lambda v: v IS NOT NULL)"
    return f"CASE WHEN len({whole}) > 0 THEN {whole} WHEN contains({x}, '_') THEN {words} ELSE [] END"


_by_name = f"n AS (SELECT name, {_tool_cats('name')} AS cats FROM (SELECT DISTINCT unnest(tools) AS name FROM et))"
_ranked = "CASE " + " ".join(f"WHEN list_contains(cs, {q(c.name)}) THEN {q(c.name)}" for c in sorted(TOOL_CATEGORIES, key=lambda c: c.rank)) + " ELSE '' END"


@query(
    "tool_governance_denylist",
    f"""WITH {EVENT_TOOLS}, {_by_name}, x AS (SELECT event_id, unnest(tools) AS name, unnest([1, 2, 3]) AS i FROM et),
    g AS (SELECT event_id, string_agg(name, ',' ORDER BY i) FILTER (len(cats) > 0) AS names, list_sort(list_distinct(flatten(list(cats)))) AS cs FROM x JOIN n USING (name) GROUP BY event_id)
    SELECT event_id, names IS NOT NULL AS detected, coalesce(names, '') AS names, array_to_string(cs, ',') AS categories, {_ranked} AS highest FROM g""",
)
def _(spark, d):
    g = _event_tools(spark, d).select("event_id", det.tool_governance(F.col("tools")).alias("g"))
    return g.select("event_id", "g.detected", F.array_join("g.unauthorized_names", ",").alias("names"), F.array_join("g.categories", ",").alias("categories"), F.col("g.highest_risk_category").alias("highest"))


_ALLOWED = ("search_docs", "weather", "view", "click")


@query("tool_governance_allowlist", f"WITH {EVENT_TOOLS}, f AS (SELECT event_id, list_filter(tools, lambda t: t NOT IN ({', '.join(q(a) for a in _ALLOWED)})) AS f FROM et) SELECT event_id, len(f) > 0 AS detected, array_to_string(f, ',') AS names FROM f")
def _(spark, d):
    g = _event_tools(spark, d).select("event_id", det.tool_governance(F.col("tools"), _ALLOWED).alias("g"))
    return g.select("event_id", "g.detected", F.array_join("g.unauthorized_names", ",").alias("names"))


@query("tool_not_allowed", f"WITH {EVENT_TOOLS} SELECT tool_name, count(*) AS calls FROM (SELECT unnest(tools) AS tool_name FROM et) WHERE tool_name NOT IN ({', '.join(q(a) for a in _ALLOWED)}) GROUP BY tool_name")
def _(spark, d):
    calls = _event_tools(spark, d).select(F.explode("tools").alias("tool_name"))
    allowed = spark.createDataFrame([(a,) for a in _ALLOWED], "tool_name string")
    return routing.not_allowed(calls, allowed).groupBy("tool_name").agg(F.count("*").alias("calls"))


@query("tools_in_text", f"""SELECT conv_id, turn, array_to_string(CASE WHEN contains(t, 'tool_calls') THEN regexp_extract_all(t, '"name"\\s*:\\s*"([^"]{{1,100}})"', 1) ELSE [] END, ',') AS tools FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '{{"tool_calls": [{{"name": "' || {duck_pick(TOOLS, 'conv_id')} || '"}}, {{"name":"x"}}]}}' ELSE text END AS t FROM conversations)""")
def _(spark, d):
    made = F.concat(F.lit('{"tool_calls": [{"name": "'), pick(TOOLS, F.col("conv_id")), F.lit('"}, {"name":"x"}]}'))
    c = table(spark, d, "conversations").withColumn("t", F.when(F.col("turn") % 2 == 0, made).otherwise(F.col("text")))
    return c.select("conv_id", "turn", F.array_join(det.tools_in_text(F.col("t")), ",").alias("tools"))


# --- conversations -------------------------------------------------------------------


@query("user_text", f"WITH {REQS} SELECT conv_id, md5(user_text) AS text_md5, CAST(length(user_text) AS BIGINT) AS n FROM reqs")
def _(spark, d):
    return requests(spark, d).select("conv_id", F.md5(F.col("user_text").cast("binary")).alias("text_md5"), F.length("user_text").cast("long").alias("n"))


@query("role_counts", "SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations, max(turn) AS last_turn FROM conversations GROUP BY role")
def _(spark, d):
    return table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.count_distinct("conv_id").alias("conversations"), F.max("turn").alias("last_turn"))


@query("last_turn", "SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role FROM conversations GROUP BY conv_id")
def _(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("role", "turn").alias("role"))


@query("response_pii", f"SELECT conv_id, turn, {any_rx('text', PII)} AS has_pii FROM conversations WHERE role = 'assistant'")
def _(spark, d):
    return table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", pii.has_pii(F.col("text")).alias("has_pii"))


@query("body_fields", "SELECT conv_id, ['gpt-4o', 'o3-mini', 'unknown'][CAST(conv_id % 3 AS INT) + 1] AS model, conv_id % 2 = 0 AS streaming, 'hello u' || conv_id || ' more' AS user_text, 'a' || conv_id || ',b' AS tools FROM (SELECT DISTINCT conv_id FROM conversations)")
def _(spark, d):
    k = F.col("conv_id").cast("string")
    body = F.concat(F.lit('{"model":"'), pick(("gpt-4o", "o3-mini", "unknown"), F.col("conv_id")), F.lit('","stream":'), (F.col("conv_id") % 2 == 0).cast("string"), F.lit(',"messages":[{"role":"system","content":"s"},{"role":"user","content":"hello u'), k, F.lit('"},{"role":"user","content":[{"type":"text","text":"skip"}]},{"role":"user","content":"more"}],"tools":[{"type":"function","function":{"name":"a'), k, F.lit('"}},{"type":"function","function":{"name":"b"}}]}'))
    c = table(spark, d, "conversations").select("conv_id").distinct().withColumn("b", body)
    return c.select("conv_id", text.model_of(F.col("b")).alias("model"), text.stream_of(F.col("b")).alias("streaming"), text.user_text(F.col("b")).alias("user_text"), F.array_join(text.requested_tools(F.col("b")), ",").alias("tools"))


@query("response_tools", "SELECT conv_id, 't' || conv_id AS tools, 'tool.call' AS action FROM (SELECT DISTINCT conv_id FROM conversations)")
def _(spark, d):
    k = F.concat(F.lit("t"), F.col("conv_id").cast("string"))
    shapes = F.element_at(F.array(F.concat(F.lit('{"content":[{"type":"text","text":"x"},{"type":"tool_use","name":"'), k, F.lit('"}]}')), F.concat(F.lit('{"candidates":[{"content":{"parts":[{"functionCall":{"name":"'), k, F.lit('"}}]}}]}')), F.concat(F.lit('{"choices":[{"message":{"tool_calls":[{"function":{"name":"'), k, F.lit('","arguments":"{}"}}]}}]}'))), (F.col("conv_id") % 3 + 1).cast("int"))
    c = table(spark, d, "conversations").select("conv_id").distinct().withColumn("b", shapes).withColumn("tools", text.response_tools(F.col("b")))
    return c.select("conv_id", F.array_join("tools", ",").alias("tools"), text.response_action(F.col("tools")).alias("action"))


# --- decisions --------------------------------------------------------------------------

_MODELS = ("gpt-4o", "gpt-4o-mini", "unknown", "o3-mini")
_SYNC = ("injection", "jailbreak", "exfiltration", "threat")


def contexts(spark, d) -> DataFrame:
    c, t = F.col("conv_id"), F.col("t")
    return requests(spark, d).select(
        "conv_id",
        F.lit("llm.request").alias("action"),
        pick(_MODELS, c).alias("model"),
        pii.pattern_names(t).alias("pii_findings"),
        *((det.long_enough(t) & det.detected(t, n)).alias(f"{n}_detected") for n in _SYNC),
        F.when(c % 11 == 0, 0).otherwise(1000).cast("long").alias("budget_remaining_cents"),
        F.when(c % 17 == 0, "prohibited").otherwise("limited").alias("risk_level"),
        (pick(_MODELS, c) != "unknown").alias("model_approved"),
        (c % 5 != 0).alias("fallback_available"),
        (c % 13 != 0).alias("data_residency_compliant"),
        (c % 19 == 0).alias("anomaly_detected"),
    )


CTX = f"""ctx AS (SELECT conv_id, 'llm.request' AS action, {duck_pick(_MODELS, 'conv_id')} AS model,
  list_filter([{', '.join(f"CASE WHEN {rx('t', p.regex)} THEN {q(p.name)} END" for p in PII)}], lambda v: v IS NOT NULL) AS pii_findings,
  {', '.join(f"strlen(t) >= {det.LEAST_BYTES} AND {any_rx('t', DETECTORS[n])} AS {n}_detected" for n in _SYNC)},
  CASE WHEN conv_id % 11 = 0 THEN 0 ELSE 1000 END AS budget_remaining_cents, CASE WHEN conv_id % 17 = 0 THEN 'prohibited' ELSE 'limited' END AS risk_level,
  {duck_pick(_MODELS, 'conv_id')} <> 'unknown' AS model_approved, conv_id % 5 <> 0 AS fallback_available, conv_id % 13 <> 0 AS data_residency_compliant, conv_id % 19 = 0 AS anomaly_detected,
  false AS identity_claim_detected, false AS confidential_detected, false AS bias_detected, false AS unauthorized_tool_detected, false AS tool_allowlist_mode, '' AS tool_highest_risk_category, 0 AS tool_count FROM reqs)"""


def _decided(spark, d, policies=None) -> DataFrame:
    return pol.evaluate(policies or default_policies.policies(), contexts(spark, d))


def _decision_sql(policies) -> str:
    s = pol.decision_sql(policies, DUCK)
    return f"SELECT conv_id, {s['action']} AS decided, {s['rule_id']} AS rule_id FROM ctx"


_ALL = default_policies.policies()


@query("policy_decision", f"WITH {REQS}, {CTX} {_decision_sql(_ALL)}")
def _(spark, d):
    return _decided(spark, d).select("conv_id", F.col("decision.action").alias("decided"), "decision.rule_id")


@query("policy_actions", f"WITH {REQS}, {CTX}, x AS ({_decision_sql(_ALL)}) SELECT decided, count(*) AS requests FROM x GROUP BY decided")
def _(spark, d):
    return _decided(spark, d).groupBy(F.col("decision.action").alias("decided")).agg(F.count("*").alias("requests"))


@query("policy_observe", f"WITH {REQS}, {CTX} {_decision_sql(pol.observe(_ALL))}")
def _(spark, d):
    return _decided(spark, d, pol.observe(default_policies.policies())).select("conv_id", F.col("decision.action").alias("decided"), "decision.rule_id")


@query("policy_promoted_only", f"WITH {REQS}, {CTX.replace('ctx AS', 'full_ctx AS')}, ctx AS (SELECT * REPLACE (false AS injection_detected, false AS jailbreak_detected, false AS threat_detected) FROM full_ctx) {_decision_sql(_ALL)}")
def _(spark, d):
    ps = default_policies.policies()
    return pol.evaluate(ps, pol.mask_unpromoted(contexts(spark, d), pol.promotion(ps))).select("conv_id", F.col("decision.action").alias("decided"), "decision.rule_id")


_matched_sql = " UNION ALL ".join(f"SELECT conv_id, {q(p.rule_id)} AS rule_id, {q(p.enforcement)} AS rule_action, {q(p.annotations['category'])} AS category FROM ctx WHERE {pol.condition_sql(p, DUCK)}" for p in _ALL if p.effect == "forbid")


@query("policy_matched_rules", f"WITH {REQS}, {CTX} {_matched_sql}")
def _(spark, d):
    return _decided(spark, d).select("conv_id", F.explode("decision.matched_rules").alias("r")).select("conv_id", "r.rule_id", F.col("r.action").alias("rule_action"), "r.category")


_frameworks_sql = " UNION ALL ".join(f"SELECT unnest({duck_list(p.frameworks)}) AS framework, decided FROM dec WHERE rule_id = {q(p.rule_id)}" for p in _ALL if p.frameworks)


@query("events_by_framework", f"WITH {REQS}, {CTX}, dec AS MATERIALIZED ({_decision_sql(_ALL)}), f AS ({_frameworks_sql}) SELECT framework, decided AS action, count(*) AS events FROM f GROUP BY ALL")
def _(spark, d):
    return rollups.events_by_framework(_decided(spark, d).select(F.col("decision.regulatory_mapping").alias("regulatory_mapping"), F.col("decision.action").alias("action")))


_RESP = ("identity_claim", "confidential", "bias", "exfiltration")


def _responses(spark, d) -> DataFrame:
    t = F.concat("text", F.lit(" "), pick(PROBES, F.col("conv_id") + F.col("turn")))
    rows = spread(table(spark, d, "conversations")).where("role = 'assistant'").select("conv_id", "turn", t.alias("t"))
    return rows.select("conv_id", "turn", F.lit("llm.response").alias("action"), *(det.detected(F.col("t"), n).alias(f"{n}_detected") for n in _RESP))


RESP = f"resp AS (SELECT conv_id, turn, 'llm.response' AS action, {', '.join(f'{any_rx("t", DETECTORS[n])} AS {n}_detected' for n in _RESP)}, []::VARCHAR[] AS pii_findings, -1 AS budget_remaining_cents, '' AS risk_level, false AS threat_detected, false AS injection_detected, false AS jailbreak_detected, false AS model_approved, false AS fallback_available, true AS data_residency_compliant, false AS anomaly_detected, false AS unauthorized_tool_detected, false AS tool_allowlist_mode, '' AS tool_highest_risk_category, 0 AS tool_count FROM (SELECT conv_id, turn, text || ' ' || {duck_pick(PROBES, '(conv_id + turn)')} AS t FROM conversations WHERE role = 'assistant'))"
_resp_sql = pol.decision_sql(_ALL, DUCK)


@query("response_decision", f"WITH {RESP} SELECT conv_id, turn, {_resp_sql['action']} AS decided, {_resp_sql['rule_id']} AS rule_id FROM resp")
def _(spark, d):
    return pol.evaluate(default_policies.policies(), _responses(spark, d)).select("conv_id", "turn", F.col("decision.action").alias("decided"), "decision.rule_id")


_rank_sql = "CASE {} WHEN 'allow' THEN 0 WHEN 'transform' THEN 1 WHEN 'flag' THEN 2 WHEN 'hold' THEN 3 ELSE 4 END"


@query("final_action", f"WITH {REQS}, {CTX}, {RESP}, a AS ({_decision_sql(_ALL)}), b AS (SELECT conv_id, turn, {_resp_sql['action']} AS r FROM resp) SELECT b.conv_id, b.turn, CASE WHEN {_rank_sql.format('r')} > {_rank_sql.format('decided')} THEN r ELSE decided END AS final FROM a JOIN b USING (conv_id)")
def _(spark, d):
    a = _decided(spark, d).select("conv_id", F.col("decision.action").alias("decided"))
    b = pol.evaluate(default_policies.policies(), _responses(spark, d)).select("conv_id", "turn", F.col("decision.action").alias("r"))
    return a.join(b, "conv_id").select("conv_id", "turn", pol.final_action(F.col("decided"), F.col("r")).alias("final"))


_BODY = """'{"model":"' || model || '","prompt":"' || regexp_replace(t, '["\\\\\\n\\r\\t]', ' ', 'g') || '"}'"""
_ERRORS = ("", "timeout", "unreachable", "kill_switch", "rate_limit", "no_api_key", "other")


@query(
    "forwarded_body",
    f"""WITH {REQS}, {CTX}, x AS ({_decision_sql(_ALL)}), o AS (SELECT reqs.conv_id, x.decided, {_BODY} AS t FROM reqs JOIN x USING (conv_id) JOIN ctx USING (conv_id)), {', '.join(redact_steps('o', 'conv_id, decided'))}
    SELECT conv_id, CASE WHEN decided = 'block' THEN NULL WHEN decided IN ('transform', 'hold') THEN md5(r) ELSE md5(t) END AS body_md5,
      CAST(CASE WHEN decided = 'block' THEN 400 ELSE [200, 504, 502, 503, 429, 400, 500][CAST(conv_id % 7 AS INT) + 1] END AS INT) AS status FROM {REDACTED}""",
)
def _(spark, d):
    """What goes upstream of real bodies, and the status of the answer in every state."""
    body = F.concat(F.lit('{"model":"'), pick(_MODELS, F.col("conv_id")), F.lit('","prompt":"'), F.regexp_replace("t", r'["\\\n\r\t]', " "), F.lit('"}'))
    bodies = pii.scan_and_redact(requests(spark, d).select("conv_id", body.alias("b")), "b", "request")
    x = _decided(spark, d).select("conv_id", F.col("decision.action").alias("a")).join(bodies, "conv_id")
    error = F.nullif(pick(_ERRORS, F.col("conv_id")), F.lit(""))
    sent = pol.forwarded_body(F.col("a"), F.col("b"), F.col("redacted_text"))
    return x.select("conv_id", F.md5(sent.cast("binary")).alias("body_md5"), pol.client_status(F.col("a"), F.lit(200), error).alias("status"))


@query("audit_compact", f"WITH {REQS}, {CTX}, m AS ({_matched_sql}), x AS ({_decision_sql(_ALL)}), g AS (SELECT conv_id, {', '.join(f"string_agg(rule_id, ',' ORDER BY {'CASE rule_id ' + ' '.join(f'WHEN {q(p.rule_id)} THEN {p.order}' for p in _ALL) + ' END'}) FILTER (rule_action = '{a}') AS {a}_ids" for a in ('block', 'flag'))} FROM m GROUP BY conv_id) SELECT conv_id, concat_ws(' ', '[' || upper(decided) || ']', 'POST', '/v1/chat/completions', 'model=' || model, 'block=' || block_ids, 'flag=' || flag_ids, CASE WHEN g.conv_id IS NULL THEN 'rule=' || rule_id END, CASE WHEN len(pii_findings) > 0 THEN 'matched=' || array_to_string(pii_findings, ',') END, 'latency=1.5ms') AS line FROM ctx JOIN x USING (conv_id) LEFT JOIN g USING (conv_id)")
def _(spark, d):
    c = F.col("decision")
    line = audit.compact_line(c["action"], F.lit("POST"), F.lit("/v1/chat/completions"), F.col("model"), c["matched_rules"], F.col("pii_findings"), c["rule_id"], F.lit(1.5))
    return _decided(spark, d).select("conv_id", line.alias("line"))


@query("enrichment_rows", f"WITH {REQS} SELECT conv_id, {', '.join(f'{any_rx("t", DETECTORS[n])} AS {n}' for n in ('injection', 'bias'))} FROM reqs WHERE {' OR '.join(any_rx('t', DETECTORS[n]) for n in ('injection', 'bias'))}")
def _(spark, d):
    rows = requests(spark, d).select(F.col("conv_id").cast("string").alias("audit_id"), F.current_timestamp().alias("ts"), F.create_map(*(x for n in ("injection", "bias") for x in (F.lit(n), det.detect(F.col("t"), n)))).alias("detections"), F.array().cast("array<struct<pattern:string>>").alias("findings"))
    e = audit.enrichment(rows)
    return e.select(F.col("parent_audit_id").cast("long").alias("conv_id"), *(F.col("detector_snapshot")[n]["detected"].alias(n) for n in ("injection", "bias")))


@query("evidence_labels", f"WITH {REQS} SELECT conv_id, array_to_string(list_sort(list_filter(['agent_integrity', CASE WHEN {any_rx('t', DETECTORS['injection'])} THEN 'injection' END], lambda v: v IS NOT NULL)), ',') AS labels FROM reqs")
def _(spark, d):
    facts = audit.control_facts(det.signal(F.col("t"), "injection"), "injection")
    return requests(spark, d).select("conv_id", F.array_join(audit.evidence_labels(facts), ",").alias("labels"))


# --- policies as tables -------------------------------------------------------------------

_policy_values = ", ".join(f"({q(p.rule_id)}, {q(p.annotations['category'])}, {q(p.enforcement)}, {duck_list(p.frameworks)})" for p in _ALL if "id" in p.annotations)
POLICIES = f"p AS (SELECT * FROM (VALUES {_policy_values}) v(rule_id, category, enforcement, frameworks))"


@query(
    "policy_coverage",
    f"""WITH {REQS}, {CTX}, {POLICIES}, m AS ({_matched_sql}), u AS (SELECT rule_id, enforcement, unnest(frameworks) AS framework FROM p)
    SELECT framework, count(DISTINCT u.rule_id) AS policies, count(DISTINCT u.rule_id) FILTER (enforcement = 'block') AS blocking, count(DISTINCT conv_id) AS interactions FROM u LEFT JOIN m ON m.rule_id = u.rule_id GROUP BY framework""",
)
def _(spark, d):
    return rollups.coverage_of(pol.to_frame(spark, default_policies.policies()), _matched(spark, d), "conv_id")


def _matched(spark, d) -> DataFrame:
    return _decided(spark, d).select("conv_id", F.explode("decision.matched_rules").alias("r")).select("conv_id", "r.rule_id")


@query("policies_by_category", f"WITH {REQS}, {CTX}, {POLICIES}, m AS ({_matched_sql}) SELECT p.category, enforcement, count(DISTINCT p.rule_id) AS policies, count(conv_id) AS matches FROM p LEFT JOIN m ON m.rule_id = p.rule_id GROUP BY ALL")
def _(spark, d):
    return rollups.by_category_of(pol.to_frame(spark, default_policies.policies()), _matched(spark, d))


_named = pol.pattern_names(_ALL)


@query("policy_missing_patterns", f"WITH {DOCS}, c AS ({_counts_sql}), n AS (SELECT * FROM (VALUES {', '.join(f'({q(a)}, {q(b)})' for a, b in _named)}) v(policy_id, pattern_name) WHERE pattern_name NOT IN ('credit_card', 'ssn', 'email', 'phone')) SELECT policy_id, pattern_name, count(doc_id) AS documents FROM n LEFT JOIN c ON pattern = pattern_name AND c.n > 0 GROUP BY ALL")
def _(spark, d):
    """Patterns that policies name, a small catalog lacks, and documents hold."""
    compiled = spark.createDataFrame([(p.name,) for p in pii.preset("code_default")], "pattern_name string")
    missing = pol.missing_patterns(spark, default_policies.policies(), compiled)
    held = _counts(documents(spark, d), "doc_id").groupBy(F.col("pattern").alias("pattern_name")).agg(F.count("*").alias("documents"))
    return missing.join(held, "pattern_name", "left").select("policy_id", "pattern_name", F.coalesce("documents", F.lit(0)).alias("documents"))


_FLAGS = [n for n, (k, _) in pol.CONTEXT.items() if k == "boolean"]
_CTX_FLAGS = ("model_approved", "fallback_available", "data_residency_compliant", "anomaly_detected", *(f"{n}_detected" for n in _SYNC))


@query("detector_vocabulary", f"WITH {REQS}, {CTX} " + " UNION ALL ".join(f"SELECT {q(n)} AS field, 'boolean' AS kind, count(*) FILTER ({n if n in _CTX_FLAGS else str(pol.CONTEXT[n][1]).lower()}) AS rows_true FROM ctx" for n in _FLAGS))
def _(spark, d):
    """The boolean facts that policies may read, and in how many rows each is true."""
    full = pol.with_defaults(contexts(spark, d))
    counts = full.agg(*(F.count_if(F.col(n)).alias(n) for n in _FLAGS))
    return counts.unpivot([], _FLAGS, "field", "rows_true").select("field", F.lit("boolean").alias("kind"), "rows_true")


# --- policies of many tenants ---------------------------------------------------------------

_TENANTS = 1000
_OWN = ("flag", "hold", "block")


def _tenant_text(k: int) -> str:
    return f"""permit(principal, action, resource);
    @id("own-{k}") @enforcement("{_OWN[k % 3]}") forbid(principal, action == Gov::Action::"llm.request", resource) when {{ context.budget_remaining_cents < {k % 20 * 60} && !(context.model == "{_MODELS[k % 4]}" || context.injection_detected) }};
    @id("shared") @enforcement("flag") forbid(principal, action, resource) when {{ context.pii_findings.containsAny(["email", "ssn"]) }} unless {{ context.model_approved }};"""


@query(
    "tenant_decisions",
    f"""WITH {REQS}, {CTX}, x AS (SELECT *, conv_id * 7 % {_TENANTS + 50} AS k FROM ctx),
    h AS (SELECT conv_id, k, k < {_TENANTS} AND budget_remaining_cents < k % 20 * 60 AND NOT ({duck_pick(_MODELS, 'k')} = model OR injection_detected) AS own, k < {_TENANTS} AND list_has_any(pii_findings, ['email', 'ssn']) AND NOT model_approved AS shared FROM x),
    base AS ({_decision_sql(_ALL)})
    SELECT conv_id, k AS tenant, CASE WHEN k >= {_TENANTS} THEN base.decided WHEN own THEN {duck_pick(_OWN, 'k')} WHEN shared THEN 'flag' ELSE 'allow' END AS decided,
      CASE WHEN k >= {_TENANTS} THEN base.rule_id WHEN own THEN 'own-' || k WHEN shared THEN 'shared' ELSE 'policy0' END AS rule_id FROM h JOIN base USING (conv_id)""",
)
def _(spark, d):
    """A thousand tenants with rules of their own, and some without; all in one projection and one join."""
    texts = {(str(k), ""): pol.parse(_tenant_text(k)) for k in range(_TENANTS)} | {tenants.BASELINE: _ALL}
    k = F.col("conv_id") * 7 % (_TENANTS + 50)
    rows = contexts(spark, d).withColumns({"tenant_id": k.cast("string"), "policy_version": F.lit(""), "tenant": k})
    return tenants.evaluate(tenants.Compiled(texts), rows).select("conv_id", "tenant", F.col("decision.action").alias("decided"), "decision.rule_id")


# --- routing -------------------------------------------------------------------------


def _routed(spark, d) -> DataFrame:
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    reqs = c.select(F.col("c_custkey").alias("request_id"), pick((*_MODELS, ""), F.col("c_custkey")).alias("model"), F.col("r_name").alias("tenant_region"))
    models = spark.createDataFrame([("gpt-4o", "openai", "gpt-4o-2", "EUROPE", ["o3-mini"]), ("gpt-4o-mini", "openai", None, "global", []), ("o3-mini", "nowhere", "o3", "ASIA", ["gpt-4o"])], "model string, provider string, actual_model string, region string, fallback array<string>")
    providers = spark.createDataFrame([("openai", "https://api.example.com")], "provider string, base_url string")
    return routing.resolve_routes(reqs, models, providers, "gpt-4o", "https://upstream.example.com")


@query(
    "route_lookup",
    f"""WITH r AS (SELECT c_custkey AS request_id, coalesce(nullif({duck_pick((*_MODELS, ''), 'c_custkey')}, ''), 'gpt-4o') AS model FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
    SELECT request_id, model, model IN ('gpt-4o', 'gpt-4o-mini', 'o3-mini') AS model_approved, CASE WHEN model IN ('gpt-4o', 'gpt-4o-mini') THEN 'openai' ELSE 'upstream' END AS provider, CASE model WHEN 'gpt-4o' THEN 'gpt-4o-2' ELSE model END AS actual_model, model = 'gpt-4o' AS fallback_available FROM r""",
)
def _(spark, d):
    return _routed(spark, d).select("request_id", "model", "model_approved", "provider", "actual_model", "fallback_available")


@query(
    "data_residency",
    f"""WITH r AS (SELECT c_custkey AS request_id, coalesce(nullif({duck_pick((*_MODELS, ''), 'c_custkey')}, ''), 'gpt-4o') AS model, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
    SELECT r_name AS tenant_region, model = 'gpt-4o-mini' OR (model = 'gpt-4o' AND r_name = 'EUROPE') AS compliant, count(*) AS requests FROM r GROUP BY ALL""",
)
def _(spark, d):
    ok = text.data_residency(F.col("tenant_region"), F.col("route_region"))
    return _routed(spark, d).groupBy("tenant_region", ok.alias("compliant")).agg(F.count("*").alias("requests"))


@query("business_hours", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN hour(ts) >= 9 AND hour(ts) < 17 WHEN 1 THEN hour(ts) >= 22 OR hour(ts) * 60 + minute(ts) < 390 ELSE false END AS active FROM events")
def _(spark, d):
    w = F.element_at(F.array(F.lit("09:00-17:00"), F.lit("22:00-06:30"), F.lit("Mon-Fri 09:00-17:00"), F.lit(None).cast("string")), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", text.business_hours(F.col("ts"), w, F.lit("UTC")).alias("active"))


@query("mcp_approval", "SELECT event_id, user_id % 3 = 0 OR user_id % 10 = 7 AS approved FROM events")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("srv-"), F.col("user_id") % 10)).alias("mcp_server_id"))
    reg = spark.createDataFrame([("srv-7",)], "server_id string")
    return routing.with_mcp(e, reg).select("event_id", F.col("mcp_server_approved").alias("approved"))


@query("scalar_projections", "SELECT doc_id, CASE WHEN octet_length(encode(text)) > 200 THEN true ELSE false END AS cut, sha256(CAST(doc_id AS VARCHAR)) AS key_hash, lower(substr(md5(CAST(doc_id AS VARCHAR)), 1, 32)) AS trace_id, ['openai', 'anthropic', 'gemini'][CAST(doc_id % 3 AS INT) + 1] AS provider FROM documents")
def _(spark, d):
    k = F.col("doc_id").cast("string")
    header = F.concat(F.lit("00-"), F.md5(k.cast("binary")), F.lit("-00f067aa0ba902b7-01"))
    path = pick(("/v1/chat/completions", "/v1/messages", "/v1beta/models/x:generateContent"), F.col("doc_id"))
    short = text.truncate_payload(F.col("text"), 200)
    return table(spark, d, "documents").select("doc_id", short.endswith("[…truncated]").alias("cut"), text.key_hash(k).alias("key_hash"), text.trace_context(header)["trace_id"].alias("trace_id"), text.provider_of(F.lit(None).cast("string"), path).alias("provider"))


# --- economics -------------------------------------------------------------------------


def _usages(spark, d) -> DataFrame:
    e = F.col("event_id")
    rows = table(spark, d, "events").select("event_id", "ts", pick((*_MODELS, "gpt-4.1"), e).alias("model"), (F.col("user_id") % 7).cast("string").alias("tenant_id"), F.col("user_id").cast("string").alias("api_key"), F.lit("anonymous").alias("agent_id"), (e % 900).alias("prompt_tokens"), (e % 300).alias("completion_tokens"))
    return economics.with_cost(rows, economics.price_table(spark))


_prices = ", ".join(f"({q(m)}, {a}, {b})" for m, a, b in economics.PRICES)
USE = f"""use AS (SELECT event_id, ts, u.model, CAST(user_id % 7 AS VARCHAR) AS tenant_id, CAST(user_id AS VARCHAR) AS api_key, coalesce(p / 1000 * pp + c / 1000 * pc, 0.0) AS cost_usd
  FROM (SELECT event_id, ts, user_id, {duck_pick((*_MODELS, 'gpt-4.1'), 'event_id')} AS model, event_id % 900 AS p, event_id % 300 AS c FROM events) u
  LEFT JOIN (SELECT model, CAST(a AS DOUBLE) AS pp, CAST(b AS DOUBLE) AS pc FROM (VALUES {_prices}) v(model, a, b)) x USING (model))"""


@query("cost_by_model", f"WITH {USE} SELECT model, count(*) AS n, round(sum(cost_usd), 9) AS cost_usd FROM use GROUP BY model")
def _(spark, d):
    return _usages(spark, d).groupBy("model").agg(F.count("*").alias("n"), F.round(F.sum("cost_usd"), 9).alias("cost_usd"))


_NOW = "2024-01-20 12:00:00"


@query("budget_status", f"""WITH {USE}, b AS (SELECT * FROM (VALUES ('tenant', '1', 0.05, 'daily'), ('tenant', '2', 0.5, 'weekly'), ('tenant', '3', 5.0, 'monthly'), ('tenant', '4', 0.0, 'daily'), ('api_key', '11', 0.001, 'monthly')) v(scope, scope_id, amount, period)),
  s AS (SELECT scope, scope_id, amount, period, coalesce((SELECT sum(cost_usd) FROM use WHERE (CASE scope WHEN 'tenant' THEN tenant_id ELSE api_key END) = scope_id AND ts <= TIMESTAMP '{_NOW}' AND ts >= date_trunc(CASE period WHEN 'daily' THEN 'day' WHEN 'weekly' THEN 'week' ELSE 'month' END, TIMESTAMP '{_NOW}')), 0.0) AS spent FROM b)
  SELECT scope, scope_id, round(spent, 9) AS spent_usd, round(greatest(amount - spent, 0.0), 9) AS remaining_usd, round(CASE WHEN amount > 0 THEN least(spent / amount * 100, 100.0) ELSE 0.0 END, 9) AS utilization_pct FROM s""")
def _(spark, d):
    b = spark.createDataFrame([("tenant", "1", 0.05, "daily"), ("tenant", "1", 0.01, "daily"), ("tenant", "2", 0.5, "weekly"), ("tenant", "3", 5.0, "monthly"), ("tenant", "4", 0.0, "daily"), ("api_key", "11", 0.001, "monthly")], "scope string, scope_id string, amount_usd double, period string")
    s = economics.spent(_usages(spark, d), b, F.lit(_NOW).cast("timestamp")).withColumn("s", economics.budget_status(F.col("amount_usd"), F.col("spent_usd")))
    return s.select("scope", "scope_id", F.round("spent_usd", 9).alias("spent_usd"), F.round("s.remaining_usd", 9).alias("remaining_usd"), F.round("s.utilization_pct", 9).alias("utilization_pct"))


@query("running_spend", f"WITH {USE} SELECT event_id, round(sum(cost_usd) OVER (PARTITION BY tenant_id, date_trunc('day', ts) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 9) AS running_usd FROM use")
def _(spark, d):
    return economics.running_spend(_usages(spark, d), ["tenant_id"], "daily").select("event_id", F.round("running_usd", 9).alias("running_usd"))


for _period, _unit in (("daily", "day"), ("weekly", "week"), ("monthly", "month")):

    def _spend(spark, d, period=_period):
        u = _usages(spark, d).withColumn("start", economics.period_start(F.col("ts"), F.lit(period)))
        return u.groupBy("tenant_id", F.date_format("start", "yyyy-MM-dd").alias("period_start")).agg(F.round(F.sum("cost_usd"), 9).alias("cost_usd"), F.max(F.date_format(economics.reset_at(F.col("ts"), F.lit(period)), "yyyy-MM-dd")).alias("reset_at"))

    query(f"spend_{_period}", f"WITH {USE} SELECT tenant_id, strftime(date_trunc('{_unit}', ts), '%Y-%m-%d') AS period_start, round(sum(cost_usd), 9) AS cost_usd, max(strftime(date_trunc('{_unit}', ts) + INTERVAL 1 {_unit}, '%Y-%m-%d')) AS reset_at FROM use GROUP BY ALL")(_spend)


@query("rate_limit", f"WITH {USE}, c AS (SELECT date_trunc('minute', ts) AS m, tenant_id, count(*) AS n FROM use GROUP BY ALL) SELECT strftime(m, '%Y-%m-%d %H:%M') AS minute, tenant_id AS scope_id, n FROM c WHERE tenant_id IN ('1', '2', '3') AND n > 1")
def _(spark, d):
    limits = spark.createDataFrame([("tenant", t, 1) for t in "123"], "scope string, scope_id string, per_minute int")
    r = economics.rate_limit(_usages(spark, d), limits)
    return r.select(F.date_format("minute", "yyyy-MM-dd HH:mm").alias("minute"), "scope_id", "n")


@query(
    "rate_limit_first_breach",
    f"""WITH {USE}, c AS (SELECT date_trunc('minute', ts) AS m, 0 AS place, 'global' AS scope, '*' AS scope_id, count(*) AS n FROM use GROUP BY ALL HAVING count(*) > 2
      UNION ALL SELECT date_trunc('minute', ts), 1, 'tenant', tenant_id, count(*) FROM use GROUP BY ALL HAVING count(*) > 1)
    SELECT strftime(m, '%Y-%m-%d %H:%M') AS minute, scope, scope_id, n FROM c QUALIFY row_number() OVER (PARTITION BY m ORDER BY place, scope_id) = 1""",
)
def _(spark, d):
    limits = spark.createDataFrame([("global", "*", 2), *(("tenant", str(t), 1) for t in range(7))], "scope string, scope_id string, per_minute int")
    r = economics.first_breach(economics.rate_limit(_usages(spark, d), limits))
    return r.select(F.date_format("minute", "yyyy-MM-dd HH:mm").alias("minute"), "scope", "scope_id", "n")


@query(
    "rate_admission",
    f"""WITH {USE}, b AS (SELECT event_id, tenant_id, date_trunc('hour', ts) AS m, event_id % 60 AS ts FROM use), t AS (SELECT *, row_number() OVER (PARTITION BY m, tenant_id ORDER BY ts, event_id) AS place FROM b),
    g AS (SELECT *, sum(CASE WHEN place <= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY m ORDER BY ts, event_id) AS taken FROM t)
    SELECT event_id, taken <= 2 AND place <= 1 AS admitted, CASE WHEN taken - CASE WHEN place <= 1 THEN 1 ELSE 0 END >= 2 THEN 'global' WHEN place > 1 THEN 'tenant' END AS refused_by FROM g""",
)
def _(spark, d):
    limits = spark.createDataFrame([("global", "*", 2), *(("tenant", str(t), 1) for t in range(7))], "scope string, scope_id string, per_minute int")
    # An hour's requests come in one minute, so that limits are met.
    burst = F.timestamp_seconds(F.unix_timestamp(F.date_trunc("hour", "ts")) + F.col("event_id") % 60)
    requests = _usages(spark, d).withColumns({"request_id": F.col("event_id"), "ts": burst})
    return economics.admit(requests, limits).select("event_id", "admitted", "refused_by")


_BUDGETS = [("api_key", "11", 1.0, 0.25), ("api_key", "12", 0.0, 0.5), ("tenant", "1", 0.5, 0.125), ("tenant", "2", 1.0, 2.0), ("agent", "a3", 4.0, 1.0)]


@query(
    "budget_lookup",
    f"""WITH b AS (SELECT scope, scope_id, CAST(floor(greatest(amount - spent, 0) * 100) AS BIGINT) AS cents, CAST(floor(CASE WHEN amount > 0 THEN least(spent / amount * 100, 100) ELSE 0 END) AS BIGINT) AS pct
      FROM (VALUES {", ".join(f"({q(a)}, {q(b)}, CAST({c} AS DOUBLE), CAST({e} AS DOUBLE))" for a, b, c, e in _BUDGETS)}) v(scope, scope_id, amount, spent))
    SELECT event_id, coalesce(k.cents, t.cents, a.cents, -1) AS budget_remaining_cents, coalesce(k.pct, t.pct, a.pct, 0) AS budget_utilization_pct FROM events
    LEFT JOIN b k ON k.scope = 'api_key' AND k.scope_id = CAST(user_id AS VARCHAR)
    LEFT JOIN b t ON t.scope = 'tenant' AND t.scope_id = CAST(user_id % 7 AS VARCHAR)
    LEFT JOIN b a ON a.scope = 'agent' AND a.scope_id = 'a' || (event_id % 5)""",
)
def _(spark, d):
    status = spark.createDataFrame(_BUDGETS, "scope string, scope_id string, amount_usd double, spent_usd double")
    requests = _usages(spark, d).withColumn("agent_id", F.concat(F.lit("a"), (F.col("event_id") % 5).cast("string")))
    return economics.lookup_budget(requests, status).select("event_id", "budget_remaining_cents", "budget_utilization_pct")


@query(
    "budget_refresh",
    f"""WITH b AS (SELECT user_id, value, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC) = 1)
    SELECT CAST(user_id AS VARCHAR) AS scope_id, value AS amount_usd, CASE WHEN date_trunc('day', ts) + INTERVAL 1 DAY <= TIMESTAMP '{_NOW}' THEN 0.0 ELSE value / 2 END AS spent_usd,
      strftime(CASE WHEN date_trunc('day', ts) + INTERVAL 1 DAY <= TIMESTAMP '{_NOW}' THEN date_trunc('day', TIMESTAMP '{_NOW}') ELSE date_trunc('day', ts) END + INTERVAL 1 DAY, '%Y-%m-%d') AS reset_on FROM b""",
)
def _(spark, d):
    status = table(spark, d, "events").select(
        F.lit("tenant").alias("scope"), F.col("user_id").cast("string").alias("scope_id"), F.col("value").alias("amount_usd"), (F.col("value") / 2).alias("spent_usd"), F.lit("daily").alias("period"),
        economics.reset_at(F.col("ts"), F.lit("daily")).alias("reset_at"), "event_id",
    )
    fresh = economics.refresh(status, F.lit(_NOW).cast("timestamp"), "event_id")
    return fresh.select("scope_id", "amount_usd", "spent_usd", F.date_format("reset_at", "yyyy-MM-dd").alias("reset_on"))


@query(
    "fallback_model",
    f"""WITH {USE} SELECT event_id, CASE model WHEN {q(_MODELS[0])} THEN 'small-a' WHEN {q(_MODELS[1])} THEN NULL END AS fallback_model FROM use""",
)
def _(spark, d):
    routes = spark.createDataFrame(
        [(_MODELS[0], [("provider_error", "other"), ("budget_exceeded", "small-a"), ("budget_exceeded", "small-b")]), (_MODELS[1], [("provider_error", "other")])],
        "model string, fallback array<struct<condition:string,model:string>>",
    )
    return economics.fallback_route(_usages(spark, d), routes).select("event_id", "fallback_model")


@query(
    "identity_lookup",
    "SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 't' || (user_id % 5) ELSE 'default' END AS tenant_id, CASE WHEN user_id % 3 = 0 THEN 'g' || user_id ELSE 'anonymous' END AS agent_id FROM events",
)
def _(spark, d):
    user = F.col("user_id").cast("string")
    e = table(spark, d, "events").select("event_id", "user_id", text.key_hash(user).alias("key_hash"))
    keys = e.where("user_id % 3 = 0").select("key_hash", F.concat(F.lit("t"), (F.col("user_id") % 5).cast("string")).alias("tenant_id"), F.concat(F.lit("g"), user).alias("agent_id")).distinct()
    return routing.with_identity(e, keys).select("event_id", "tenant_id", "agent_id")


@query(
    "principals",
    """WITH x AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'org' END AS b, CASE event_id % 5 WHEN 1 THEN 'org:' || user_id WHEN 2 THEN 'app:' || user_id WHEN 3 THEN 'u' || user_id WHEN 4 THEN '' END AS h FROM events)
    SELECT event_id, CASE WHEN b IS NOT NULL AND h IS NULL THEN b WHEN b IS NOT NULL AND (starts_with(h, b || ':') OR h = b) THEN h WHEN b IS NOT NULL THEN b || ':' || h
      WHEN starts_with(h, 'app:') THEN substr(h, 5) WHEN h <> '' THEN h ELSE 'anonymous' END AS principal FROM x""",
)
def _(spark, d):
    user, kind = F.col("user_id").cast("string"), F.col("event_id") % 5
    header = F.when(kind == 1, F.concat(F.lit("org:"), user)).when(kind == 2, F.concat(F.lit("app:"), user)).when(kind == 3, F.concat(F.lit("u"), user)).when(kind == 4, "")
    bound = F.when(F.col("event_id") % 3 == 0, "org")
    return table(spark, d, "events").select("event_id", text.principal_of(bound, header, reserved=("app",)).alias("principal"))


@query("hold_capacity", "SELECT count(*) AS active, count(*) >= 100 AS full FROM events WHERE event_type = 'error'")
def _(spark, d):
    h = table(spark, d, "events").select(F.when(F.col("event_type") == "error", "pending").otherwise("approved").alias("status"))
    return audit.capacity(h, 100)


@query("usage_parse", "SELECT event_id, CASE event_id % 3 WHEN 2 THEN -1 ELSE event_id % 50 END AS prompt_tokens, CASE event_id % 3 WHEN 0 THEN event_id % 50 + 9 WHEN 1 THEN event_id % 50 + 7 ELSE -1 END AS total_tokens FROM events")
def _(spark, d):
    n = (F.col("event_id") % 50).cast("string")
    bodies = F.array(F.concat(F.lit('{"usage":{"prompt_tokens":'), n, F.lit(',"completion_tokens":9,"total_tokens":'), (F.col("event_id") % 50 + 9).cast("string"), F.lit("}}")), F.concat(F.lit('{"usage":{"input_tokens":'), n, F.lit(',"output_tokens":7}}')), F.lit('{"usage":{}}'))
    k = (F.col("event_id") % 3 + 1).cast("int")
    u = economics.usage(F.element_at(bodies, k), F.element_at(F.array(F.lit("openai"), F.lit("anthropic"), F.lit("openai")), k))
    return table(spark, d, "events").select("event_id", *(F.coalesce(u[c], F.lit(-1).cast("long")).alias(c) for c in ("prompt_tokens", "total_tokens")))


# --- operations -------------------------------------------------------------------------


@query("latency_hourly", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type AS model, count(*) AS sample_count, round(quantile_cont(value, 0.5), 6) AS total_ms_p50, round(quantile_cont(value, 0.95), 6) AS total_ms_p95, round(quantile_cont(value, 0.99), 6) AS total_ms_p99, round(quantile_cont(value * 0.8, 0.5), 6) AS upstream_ms_p50 FROM events GROUP BY ALL")
def _(spark, d):
    s = table(spark, d, "events").select("ts", F.lit("a").alias("agent_id"), F.col("event_type").alias("model"), F.col("value").alias("total_ms"), (F.col("value") * 0.8).alias("upstream_ms"))
    return rollups.hourly(s, exact=True).select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "model", "sample_count", *(F.round(c, 6).alias(c) for c in ("total_ms_p50", "total_ms_p95", "total_ms_p99", "upstream_ms_p50")))


@query("latency_daily", "WITH d AS (SELECT date_trunc('day', ts) AS day, event_type AS model, count(*) AS sample_count FROM events GROUP BY ALL) SELECT strftime(day, '%Y-%m-%d') AS day, model, sample_count, true AS p50_near, true AS p95_near, true AS p99_near FROM d")
def _(spark, d):
    """Percentiles of days from the sketches of hours, held against the ranks of all values: at most 2 % of the rows off."""
    s = table(spark, d, "events").select("ts", F.lit("a").alias("agent_id"), F.col("event_type").alias("model"), F.col("value").alias("total_ms"), (F.col("value") * 0.8).alias("upstream_ms"))
    days = rollups.merged(rollups.sketches(s))
    qs = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    found = days.select("day", "model", "sample_count", *(rollups.quantile("total_ms_sketch", q).alias(n) for n, q in qs.items()))
    values = s.select(F.date_trunc("day", "ts").alias("day"), "model", "total_ms").join(found, ["day", "model"])
    ranks = values.groupBy("day", "model", "sample_count").agg(*(f(n) for n in qs for f in (lambda n: F.count_if(F.col("total_ms") < F.col(n)).alias(f"{n}_below"), lambda n: F.count_if(F.col("total_ms") <= F.col(n)).alias(f"{n}_upto"))))

    def near(n: str, q: float) -> Column:
        off = F.greatest(F.lit(1.0), F.col("sample_count") * 0.02)
        return ((F.col(f"{n}_below") - q * F.col("sample_count") <= off) & (q * F.col("sample_count") - F.col(f"{n}_upto") <= off)).alias(f"{n}_near")

    return ranks.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "model", "sample_count", *(near(n, q) for n, q in qs.items()))


@query("phase_overhead", "SELECT event_id, round(value * 0.5 + CASE WHEN event_id % 2 = 0 THEN value * 0.25 ELSE 0 END, 6) AS overhead_ms FROM events")
def _(spark, d):
    v = F.col("value")
    s = table(spark, d, "events").select("event_id", (v * 0.5).alias("auth_ms"), F.when(F.col("event_id") % 2 == 0, v * 0.25).alias("parse_ms"))
    return s.select("event_id", F.round(rollups.overhead(("auth_ms", "parse_ms")), 6).alias("overhead_ms"))


@query("audit_health", f"WITH {REQS}, {CTX}, x AS ({_decision_sql(_ALL)}) SELECT count(*) AS total, count(*) FILTER (decided = 'allow') AS allow, count(*) FILTER (decided = 'flag') AS flag, count(*) FILTER (decided = 'block') AS block FROM x")
def _(spark, d):
    a = _decided(spark, d).select(F.col("decision.action").alias("action"), F.current_timestamp().alias("ts"))
    return rollups.health(a).select("total", "allow", "flag", "block")


@query("retention", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' OR event_id % 50 = 0")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 50 != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("timestamp"))
    return audit.retained(e, "2024-01-20 00:00:00", 5).select("event_id")


@query("purge_count", "SELECT count(*) AS purged FROM events WHERE ts < TIMESTAMP '2024-01-15 00:00:00'")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"))
    return audit.purge(e, "2024-01-20 00:00:00", 5)[1]


@query("hold_page", "SELECT event_id AS hold_id, (SELECT count(*) FROM events WHERE event_type = 'error') AS total, (SELECT count(*) FROM events WHERE event_type = 'error') > 30 AS has_more FROM events WHERE event_type = 'error' ORDER BY ts, event_id LIMIT 20 OFFSET 10")
def _(spark, d):
    h = table(spark, d, "events").select(F.col("event_id").alias("hold_id"), F.col("ts").alias("created_at"), F.col("event_type").alias("status"))
    return audit.page(h, status="error", limit=20, offset=10).select("hold_id", "total", "has_more")


@query("hold_states", "SELECT event_id AS hold_id, CASE WHEN event_id % 3 = 0 THEN 'approved' WHEN TIMESTAMP '2024-01-20 00:00:00' >= ts + INTERVAL 30 SECOND THEN 'expired' ELSE 'pending' END AS status FROM events")
def _(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("hold_id"), F.col("ts").alias("created_at"))
    late = F.when(F.col("hold_id") % 3 == 0, 10).otherwise(40)
    decided = e.where("hold_id % 3 < 2").select("hold_id", F.lit("approved").alias("verdict"), (F.col("created_at") + F.make_interval(secs=late)).alias("decided_at"))
    return audit.resolve_holds(e, decided, F.lit("2024-01-20 00:00:00").cast("timestamp")).select("hold_id", "status")


# --- streams ------------------------------------------------------------------------------


def _chunks(spark, d) -> DataFrame:
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("stream_id"), F.posexplode(F.split("text", "(?<=[aeiou])")).alias("seq", "chunk"))
    return c.select("stream_id", F.col("seq").cast("long").alias("seq"), "chunk")


def _word_chunks(spark, d) -> DataFrame:
    """Words alternate between ending in a space and not."""
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("stream_id"), F.posexplode(F.split("text", " ")).alias("seq", "w"))
    return c.select("stream_id", F.col("seq").cast("long").alias("seq"), F.when(F.col("seq") % 3 == 2, F.concat("w", F.lit(" "))).otherwise(F.col("w")).alias("chunk"))


@query("stream_flush_groups", "WITH c AS (SELECT conv_id * 1000 + turn AS stream_id, unnest(range(0, len(string_split(text, ' ')))) AS seq, unnest(string_split(text, ' ')) AS w FROM conversations), k AS (SELECT stream_id, seq, CASE WHEN seq % 3 = 2 THEN w || ' ' ELSE w END AS chunk FROM c), f AS (SELECT *, CAST(coalesce(sum(CASE WHEN regexp_matches(chunk, '[ \\n\\r\\t]') THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS flush_seq FROM k) SELECT stream_id, flush_seq, md5(string_agg(chunk, '' ORDER BY seq)) AS text_md5, CASE WHEN bool_or(regexp_matches(chunk, '[ \\n\\r\\t]')) THEN 'boundary' ELSE 'end' END AS reason FROM f GROUP BY ALL")
def _(spark, d):
    g = buffer.flush_groups(_word_chunks(spark, d))
    return g.select("stream_id", "flush_seq", F.md5(F.col("text").cast("binary")).alias("text_md5"), "reason")


def flush_ctes(source: str, cap: int) -> str:
    """CTEs that end in f (stream_id, flush_seq, last_seq, text, reason): the buffer's recurrence over ``source`` (stream_id, seq, chunk), chunk by chunk."""
    step = "CASE WHEN s.reason <> '' THEN {} ELSE {} END"
    text = f"({step.format("''", 's.text')} || n.chunk)"
    return f"""n AS (SELECT stream_id, seq, chunk, row_number() OVER (PARTITION BY stream_id ORDER BY seq) AS i, count(*) OVER (PARTITION BY stream_id) AS n FROM {source} WHERE chunk <> ''),
  walk AS (
    SELECT stream_id, CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS seq, '' AS text, 'begin' AS reason, -1 AS flush_seq FROM n GROUP BY stream_id
    UNION ALL
    SELECT n.stream_id, n.i, n.seq, {text}, CASE WHEN strlen({text}) >= {cap} THEN 'cap' WHEN regexp_matches(n.chunk, '[ \\n\\r\\t]') THEN 'boundary' WHEN n.i = n.n THEN 'end' ELSE '' END, s.flush_seq + CASE WHEN s.reason <> '' THEN 1 ELSE 0 END
    FROM walk s JOIN n ON n.stream_id = s.stream_id AND n.i = s.i + 1),
  f AS (SELECT stream_id, flush_seq, seq AS last_seq, text, reason FROM walk WHERE reason NOT IN ('', 'begin'))"""


#: Deltas of a text: what ends in a vowel.
_DELTAS = "regexp_extract_all({}, '(?s)[^aeiou]*[aeiou]|[^aeiou]+$')"


@query("stream_flush_capped", f"WITH RECURSIVE x AS (SELECT conv_id * 1000 + turn AS stream_id, {_DELTAS.format('text')} AS p FROM conversations), c AS (SELECT stream_id, unnest(range(len(p))) AS seq, unnest(p) AS chunk FROM x), {flush_ctes('c', 12)} SELECT stream_id, flush_seq, last_seq, text, reason FROM f")
def _(spark, d):
    return buffer.flush_capped(_chunks(spark, d), 12).drop("ended_at")


@query("stream_totals", "WITH c AS (SELECT conv_id, len(string_split(text, ' ')) AS n, octet_length(encode(replace(text, ' ', ''))) AS b FROM conversations) SELECT conv_id, CAST(sum(n) AS BIGINT) AS frames_received, CAST(sum(b) AS BIGINT) AS bytes_received FROM c GROUP BY conv_id")
def _(spark, d):
    f = table(spark, d, "conversations").select("conv_id", F.current_timestamp().alias("ts"), F.explode(F.split("text", " ")).alias("raw"), F.lit(True).alias("emitted"), F.lit("end").alias("flush_reason"), F.lit("allow").alias("verdict"))
    return frames.stream_stats(f, ["conv_id"]).select("conv_id", "frames_received", "bytes_received")


def _sse(provider: str, sql: str):
    @query(f"sse_{provider}", sql)
    def _(spark, d):
        c = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("x"))
        end = {"openai": "data: [DONE]\n\n", "anthropic": "event: message_stop\ndata: {}\n\n", "gemini": 'data: {"candidates":[{"finishReason":"STOP"}]}\n\n'}[provider]
        raw = F.concat(frames.encode_text(provider, F.col("x")), F.lit(end))
        events = c.select("conv_id", "turn", F.explode(F.filter(F.split(raw, "\n\n"), lambda e: e != "")).alias("e"))
        rows = events.select("conv_id", "turn", F.explode(frames.parse(F.col("e"), F.lit(provider))).alias("f"))
        return rows.select("conv_id", "turn", frames.text_delta(F.col("f.data")).alias("delta"), "f.is_done", "f.is_error")


for _p in ("openai", "anthropic", "gemini"):
    _sse(_p, "SELECT conv_id, turn, text AS delta, false AS is_done, false AS is_error FROM conversations UNION ALL SELECT conv_id, turn, NULL, true, false FROM conversations")


@query(
    "bedrock_frames",
    """SELECT conv_id, turn, 'contentBlockDelta' AS event, text AS data, contains(text, '"message_stop"') AS is_done, false AS is_error FROM conversations
    UNION ALL SELECT conv_id, turn, 'messageStop', '{}', true, false FROM conversations""",
)
def _(spark, d):
    @F.pandas_udf("binary")
    def encode(t: pd.Series) -> pd.Series:
        return t.map(lambda x: frames.encode_bedrock("contentBlockDelta", x.encode()) + frames.encode_bedrock("messageStop", b"{}"))

    c = table(spark, d, "conversations").select("conv_id", "turn", F.explode(frames.parse_bedrock(encode(F.col("text")))).alias("f"))
    return c.select("conv_id", "turn", "f.event", "f.data", "f.is_done", "f.is_error")


@query("stream_enforced", f"WITH c AS (SELECT conv_id, turn, min(turn) FILTER ({any_rx('text', DETECTORS['injection'])} OR turn = 4) OVER (PARTITION BY conv_id) AS stop FROM conversations) SELECT conv_id, turn, stop IS NULL OR turn < stop AS emitted FROM c")
def _(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.col("turn").alias("seq"), F.when(det.detected(F.col("text"), "injection") | (F.col("turn") == 4), "block").otherwise("allow").alias("verdict"))
    return frames.enforce(c, ["conv_id"]).select("conv_id", "turn", "emitted")


@query("tool_argument_deltas", "SELECT conv_id, CAST(0 AS INT) AS idx, string_agg('a' || turn, '' ORDER BY turn) AS arguments FROM conversations GROUP BY conv_id")
def _(spark, d):
    data = F.concat(F.lit('{"choices":[{"delta":{"tool_calls":[{"index":0,"function":{"arguments":"a'), F.col("turn").cast("string"), F.lit('"}}]}}]}'))
    c = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("seq"), data.alias("data"))
    return frames.tool_arguments(c, ["conv_id"]).select("conv_id", F.col("index").alias("idx"), "arguments")


# --- streams, scanned ------------------------------------------------------------------------

_STREAM_RULES = pol.parse(
    """
    permit(principal, action, resource);
    @id("pii-flag") @enforcement("flag") forbid(principal, action == Gov::Action::"llm.response", resource) when { context.pii_detected == true };
    @id("long-block") @enforcement("block") forbid(principal, action == Gov::Action::"llm.response", resource) when { context.pii_detected == true && context.tool_count > 3 };
    @id("tools-block") @enforcement("block") forbid(principal, action == Gov::Action::"tool.call", resource) when { context.tool_count > 1 && context.pii_detected == true };
    @id("tools-flag") @enforcement("flag") forbid(principal, action == Gov::Action::"tool.call", resource) when { context.tool_count > 1 };
    """
)


def _turns(spark, d) -> DataFrame:
    t = F.concat("text", F.lit(" "), pick(PROBES, F.col("conv_id") + F.col("turn")))
    return spread(table(spark, d, "conversations")).select("conv_id", "turn", t.alias("t"))


TURNS = f"turns AS (SELECT conv_id, turn, text || ' ' || {duck_pick(PROBES, '(conv_id + turn)')} AS t FROM conversations)"


@query(
    "stream_scan_enforced",
    f"""WITH {TURNS}, h AS (SELECT conv_id, turn, {any_rx('t', PII)} AS hit FROM turns), v AS (SELECT *, CASE WHEN hit AND turn >= 4 THEN 'block' WHEN hit THEN 'flag' ELSE 'allow' END AS verdict FROM h),
    s AS (SELECT *, sum(CASE WHEN verdict = 'block' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS stops FROM v)
    SELECT conv_id, turn, verdict, stops = 0 AS sent, CASE WHEN stops = 0 THEN 'text' WHEN stops = 1 AND verdict = 'block' THEN 'error' ELSE 'none' END AS kind FROM s""",
)
def _(spark, d):
    f = _turns(spark, d).select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("flush_seq"), F.col("t").alias("text"), F.col("turn").cast("long").alias("tool_count"))
    e = scan.enforce_flushes(f, _STREAM_RULES)
    kind = F.when(F.col("output").isNull(), "none").when(F.get_json_object(F.substring("output", 6, 1 << 30), "$.error").isNotNull(), "error").otherwise("text")
    return e.select(F.col("stream_id").alias("conv_id"), F.col("flush_seq").alias("turn"), "verdict", "sent", kind.alias("kind"))


_CAP = 24


@query(
    "stream_enforced_output",
    f"""WITH RECURSIVE {TURNS}, x AS (SELECT conv_id * 1000 + turn AS stream_id, {_DELTAS.format("t || ' '")} AS p FROM turns), c AS (SELECT stream_id, unnest(range(len(p))) AS seq, unnest(p) AS chunk FROM x),
    {flush_ctes('c', _CAP)}, ft AS (SELECT stream_id, flush_seq, reason, text AS t FROM f), {', '.join(redact_steps('ft', 'stream_id, flush_seq, reason'))},
    v AS (SELECT *, CASE WHEN r = t OR reason = 'end' THEN 'allow' WHEN stream_id % 3 = 0 THEN 'block' ELSE 'flag' END AS verdict FROM {REDACTED}),
    s AS (SELECT *, sum(CASE WHEN verdict = 'block' THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY flush_seq) AS stops FROM v)
    SELECT stream_id, CAST(row_number() OVER (PARTITION BY stream_id ORDER BY flush_seq) - 1 AS INT) AS place, reason, verdict, stops = 0 AS sent, CASE WHEN stops = 0 THEN r WHEN stops = 1 AND verdict = 'block' THEN 'long-block' END AS output, r <> t AS found FROM s""",
)
def _(spark, d):
    """Responses as providers send them, cut into chunks anywhere: what goes out of each flush, and why."""
    t = _turns(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("stream_id"), F.concat("t", F.lit(" ")).alias("t"))
    deltas = F.transform(F.regexp_extract_all("t", F.lit("(?s)[^aeiou]*[aeiou]|[^aeiou]+$"), F.lit(0)), lambda x: frames.encode_text("openai", x))
    body = t.select("stream_id", F.concat(F.array_join(deltas, ""), F.lit("data: [DONE]\n\n")).alias("b"))
    chunks = body.select("stream_id", F.posexplode(F.regexp_extract_all("b", F.lit("(?s).{1,97}"), F.lit(0))).alias("seq", "chunk"))
    facts = body.select("stream_id", F.when(F.col("stream_id") % 3 == 0, 4).otherwise(0).cast("long").alias("tool_count"))
    items = live.enforce(chunks, _STREAM_RULES, _CAP, facts=facts).where("kind = 'text'")
    data = F.substring("output", 7, 1 << 30)
    place = F.row_number().over(Window.partitionBy("stream_id").orderBy("at")) - 1
    output = F.coalesce(frames.text_delta(data), F.get_json_object(data, "$.error.message"))
    return items.select("stream_id", place.cast("int").alias("place"), "reason", "verdict", "sent", output.alias("output"), F.exists("findings", lambda f: f["location"] == "streaming_response").alias("found"))


_turn_hits = "(" + " + ".join(f"CASE WHEN {rx('t', p.regex)} THEN 1 ELSE 0 END" for p in PII) + ")"


@query(
    "stream_observed",
    f"""WITH {TURNS}, s AS (SELECT conv_id, count(*) AS n, sum({_turn_hits}) AS hits FROM turns GROUP BY conv_id),
    v AS (SELECT conv_id, hits, least(n, 3) AS tools, n > 1 AS many FROM s)
    SELECT conv_id, CAST(hits + CASE WHEN many THEN 1 ELSE 0 END AS BIGINT) AS n_findings, CAST(tools AS BIGINT) AS n_tools, CASE WHEN many AND hits > 0 THEN 'block' WHEN many OR hits > 0 THEN 'flag' ELSE 'allow' END AS verdict FROM v""",
)
def _(spark, d):
    t = _turns(spark, d)
    said = t.select("conv_id", (F.col("turn") * 2).alias("seq"), F.to_json(F.struct(F.array(F.struct(F.struct(F.col("t").alias("content")).alias("delta"))).alias("choices"))).alias("data"), F.lit(False).alias("is_done"))
    order = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    name = F.concat(F.lit("tool"), (order % 3).cast("string"))
    called = t.select("conv_id", (F.col("turn") * 2 + 1).alias("seq"), F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(F.struct(name.alias("name")).alias("function"))).alias("tool_calls")).alias("delta"))).alias("choices"))).alias("data"), F.lit(False).alias("is_done"))
    end = t.select("conv_id").distinct().select("conv_id", F.lit(1 << 30).alias("seq"), F.lit("[DONE]").alias("data"), F.lit(True).alias("is_done"))
    rows = said.union(called).union(end).withColumn("is_error", F.lit(False))
    o = scan.tools_at_end(scan.observe(rows, ["conv_id"]), _STREAM_RULES)
    return o.select("conv_id", F.size("findings").cast("long").alias("n_findings"), F.size("tools").cast("long").alias("n_tools"), "verdict")


@query("body_model_rewrite", "SELECT conv_id, turn, 'm\"' || conv_id AS model, md5(text) AS text_md5 FROM conversations")
def _(spark, d):
    body = F.to_json(F.struct(F.lit("old").alias("model"), F.array(F.struct(F.col("role"), F.col("text").alias("content"))).alias("messages")))
    c = table(spark, d, "conversations").select("conv_id", "turn", text.rewrite_model(body, F.concat(F.lit('m"'), F.col("conv_id").cast("string"))).alias("b"))
    return c.select("conv_id", "turn", text.model_of(F.col("b")).alias("model"), F.md5(F.get_json_object("b", "$.messages[0].content").cast("binary")).alias("text_md5"))


# The rest of the catalog registers itself.
from palisade import audit_queries  # noqa: E402, F401
