"""More of the query catalog: audit rows, payloads, control facts, sinks and the scanners' other forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.functions import detectors as det
from palisade.functions import pii, text
from palisade.functions.patterns import DETECTOR_VERSIONS, DETECTORS, PII
from palisade.operators import audit, rollups
from palisade.plans import policy as pol
from palisade.queries import _ALL, _STREAM_RULES, CTX, DOCS, EVENT_TOOLS, REQS, TURNS, _counts_sql, _decided, _decision_sql, _event_tools, _tool_cats, _turns, any_rx, documents, duck_list, duck_pick, flush_ctes, pick, q, query, requests, rx, table
from palisade.session import prepare
from palisade.sources import io
from palisade.streaming import frames, live

# --- payloads and identifiers -----------------------------------------------------------

_SHORT = 186


@query(
    "payloads_kept",
    f"""WITH c AS (SELECT conv_id, turn, text, ['allow', 'flag', 'block'][CAST((conv_id + turn) % 3 AS INT) + 1] AS action FROM conversations),
    s AS (SELECT *, CASE WHEN strlen(text) > 200 THEN left(text, list_max(list_filter(range(0, {_SHORT} + 1), lambda k: strlen(left(text, k)) <= {_SHORT}))) || '[…truncated]' ELSE text END AS short FROM c)
    SELECT conv_id, turn, CASE WHEN action <> 'allow' THEN short END AS payload, substr(sha256(conv_id || '|' || turn), 1, 16) AS audit_id FROM s""",
)
def _(spark, d):
    c = table(spark, d, "conversations").withColumn("action", pick(("allow", "flag", "block"), F.col("conv_id") + F.col("turn")))
    kept = F.when(text.keeps_payload("on_enforcement", F.col("action")), text.truncate_payload(F.col("text"), 200))
    return c.select("conv_id", "turn", kept.alias("payload"), text.audit_id(F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("audit_id"))


_PATHS = (*text.PATH_ACTIONS, "/other")


@query("path_actions", f"SELECT event_id, {duck_list([text.PATH_ACTIONS.get(p, 'llm.request') for p in _PATHS])}[CAST(event_id % {len(_PATHS)} AS INT) + 1] AS action, CASE WHEN user_id % 4 <> 0 THEN 'srv-' || user_id END AS mcp_id FROM events")
def _(spark, d):
    header = F.when(F.col("user_id") % 4 == 0, F.concat(F.lit("bad id "), F.col("user_id").cast("string"))).otherwise(F.concat(F.lit("srv-"), F.col("user_id").cast("string")))
    return table(spark, d, "events").select("event_id", text.action_of_path(pick(_PATHS, F.col("event_id"))).alias("action"), text.mcp_id(header).alias("mcp_id"))


@query(
    "policy_input_header",
    "SELECT conv_id, turn, CASE WHEN strlen(text) > 1500 THEN 'a' || conv_id ELSE text END AS seen, strlen(text) > 1500 AS short FROM conversations",
)
def _(spark, d):
    """The header that tells what was decided on: without its context where that is long."""
    long = F.octet_length("text") > 1500
    body = F.when(long, F.repeat("text", 4)).otherwise(F.col("text"))
    h = text.input_header(F.concat(F.lit("a"), F.col("conv_id").cast("string")), F.lit("llm.request"), F.lit("model"), body)
    seen = F.coalesce(F.get_json_object("h", "$.context"), F.get_json_object("h", "$.principal"))
    return table(spark, d, "conversations").withColumn("h", h).select("conv_id", "turn", seen.alias("seen"), F.get_json_object("h", "$.context").isNull().alias("short"))


# --- scanners' other forms ------------------------------------------------------------------


@query("pii_scan_bytes", f"WITH {DOCS}, c AS ({_counts_sql}) SELECT doc_id, pattern, n FROM c WHERE n > 0 AND doc_id % 5 <> 0")
def _(spark, d):
    """Findings of raw bytes; those of every fifth document are broken and have none."""
    raw = F.when(F.col("doc_id") % 5 == 0, F.concat(F.col("t").cast("binary"), F.lit(bytearray(b"\xff\xfe")))).otherwise(F.col("t").cast("binary"))
    found = documents(spark, d).select("doc_id", F.explode(pii.scan_bytes(raw, "body")).alias("f"))
    return found.select("doc_id", F.col("f.pattern").alias("pattern"), F.col("f.count").cast("long").alias("n"))


@query("pii_pattern_names", f"WITH {DOCS} SELECT doc_id, array_to_string(list_filter([{', '.join(f'CASE WHEN {rx("t", p.regex)} THEN {q(p.name)} END' for p in PII)}], lambda v: v IS NOT NULL), ',') AS names FROM docs")
def _(spark, d):
    return documents(spark, d).select("doc_id", F.array_join(pii.pattern_names(F.col("t")), ",").alias("names"))


_LOUD = ("injection", "threat", "bias")


@query("detectors_run", f"WITH {DOCS} SELECT doc_id, " + ", ".join(f"{any_rx('t', DETECTORS[n])} AS {n}, len(list_filter([{', '.join(rx('t', p.regex) for p in DETECTORS[n])}], lambda x: x)) AS n_{n}" for n in _LOUD) + ", strlen(t) > 3000 AS size FROM docs")
def _(spark, d):
    """Several detectors at once, one of them the caller's own."""
    own = {"size": lambda t: det.scored(F.octet_length(t) / 6000, "size", 0.5000001)}
    r = documents(spark, d).select("doc_id", det.run_detectors(F.col("t"), _LOUD, own).alias("r"))
    return r.select("doc_id", *(c for n in _LOUD for c in (F.col(f"r.{n}.detected").alias(n), F.size(f"r.{n}.findings").cast("long").alias(f"n_{n}"))), F.col("r.size.detected").alias("size"))


@query("scored_detector", "SELECT doc_id, toxic = 1 AS detected, CAST(toxic AS DOUBLE) AS confidence, CAST(round(toxic * 100) AS BIGINT) AS score_pct FROM labels WHERE toxic IS NOT NULL")
def _(spark, d):
    """A detection by a score from elsewhere."""
    rows = table(spark, d, "labels").where("toxic is not null").withColumn("s", det.scored(F.col("toxic").cast("double"), "toxicity"))
    return rows.select("doc_id", "s.detected", "s.confidence", det.threat_score_pct(F.col("s.confidence")).alias("score_pct"))


@query(
    "tool_text_findings",
    f"""WITH {EVENT_TOOLS}, x AS (SELECT event_id, unnest(tools) AS name, unnest([1, 2, 3]) AS i FROM et), n AS (SELECT *, {_tool_cats('name')} AS cats FROM x)
    SELECT event_id, coalesce(string_agg(name, ',' ORDER BY i) FILTER (len(cats) > 0), '') AS names FROM n GROUP BY event_id""",
)
def _(spark, d):
    """Risky tools in the text of a response that calls them."""
    body = F.concat(F.lit('{"tool_calls":['), F.array_join(F.transform("tools", lambda t: F.concat(F.lit('{"function":{"name":"'), t, F.lit('"}}'))), ","), F.lit("]}"))
    found = _event_tools(spark, d).select("event_id", det.tool_text_findings(body).alias("f"))
    return found.select("event_id", F.array_join(F.transform("f", lambda f: f["matched_text"]), ",").alias("names"))


@query("many_tool_names", f"WITH n AS (SELECT conv_id, list(DISTINCT 'sudo_' || turn) AS names FROM conversations GROUP BY conv_id) SELECT conv_id, len(names) * 2 AS n_called, least(len(names) * 2, 10) AS n_listed FROM n")
def _(spark, d):
    """At most ten flagged names are listed."""
    name = F.concat(F.lit("sudo_"), F.col("turn").cast("string"))
    both = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_set(name).alias("a")).withColumn("tools", F.concat("a", F.transform("a", lambda x: F.concat(F.lit("run_shell_"), x))))
    return both.select("conv_id", F.size("tools").cast("long").alias("n_called"), F.size(det.tool_governance(F.col("tools"))["unauthorized_names"]).cast("long").alias("n_listed"))


# --- decisions and audit rows ---------------------------------------------------------------


@query("strictest_action", "SELECT conv_id, ['allow', 'transform', 'flag', 'hold', 'block'][CAST(max((conv_id + turn) % 5) AS INT) + 1] AS action FROM conversations WHERE turn < 3 GROUP BY conv_id")
def _(spark, d):
    """The strictest of a conversation's first actions."""
    act = F.concat(F.lit(""), pick(tuple(pol.RANKS), F.col("conv_id") + F.col("turn")))
    rows = table(spark, d, "conversations").where("turn < 3").groupBy("conv_id").pivot("turn", [0, 1, 2]).agg(F.first(act))
    return rows.select("conv_id", pol.resolve(F.col("0"), F.col("1"), F.col("2")).alias("action"))


@query(
    "control_facts",
    f"WITH {REQS} SELECT conv_id, CAST({any_rx('t', DETECTORS['injection'])} AS VARCHAR) AS detected, CASE WHEN {any_rx('t', DETECTORS['injection'])} THEN '100' ELSE '0' END AS score, {q(DETECTOR_VERSIONS['injection'])} AS version, CAST(len(regexp_extract_all(t, 'https?://')) > 0 AS VARCHAR) AS any_url FROM reqs",
)
def _(spark, d):
    inj, exf = (det.signal(F.col("t"), n) for n in ("injection", "exfiltration"))
    rows = requests(spark, d).select("conv_id", inj.alias("i"), audit.control_facts(inj, "injection").alias("a"), audit.control_facts(exf, "exfiltration").alias("b"))
    url = (F.col("b")["data_protection.exfiltration_url_count"].cast("long") > 0).cast("string")
    return rows.select("conv_id", F.col("a")["agent_integrity.injection_detected"].alias("detected"), F.col("a")["agent_integrity.injection_score"].alias("score"), F.col("i.version").alias("version"), url.alias("any_url"))


def _audited(spark, d) -> DataFrame:
    found = pii.scan_only(F.col("t"), "request")
    scanned = requests(spark, d).select("conv_id", found.alias("findings"))
    rows = _decided(spark, d).join(scanned, "conv_id").withColumns(
        {
            "audit_id": text.audit_id(F.col("conv_id").cast("string")),
            "request_id": F.col("conv_id").cast("string"),
            "ts": F.lit("2024-01-20").cast("timestamp"),
            "tenant_id": F.lit("t"),
            "agent_id": F.lit("a"),
            "path": F.lit("/v1/messages"),
            "status_code": F.lit(200),
            "upstream_ms": F.lit(1.0),
            "overhead_ms": F.lit(0.5),
        }
    )
    return audit.audit_rows(rows)


@query(
    "audit_rows",
    f"""WITH {REQS}, {CTX}, x AS ({_decision_sql(_ALL)}) SELECT conv_id AS request_id, substr(sha256(CAST(conv_id AS VARCHAR)), 1, 16) AS audit_id, decided, rule_id, model, len(pii_findings) AS n_findings, injection_detected AS injected FROM x JOIN ctx USING (conv_id)""",
)
def _(spark, d):
    a = _audited(spark, d)
    injected = F.get_json_object("context_snapshot", "$.injection_detected").cast("boolean")
    return a.select(F.col("request_id").cast("long").alias("request_id"), "audit_id", F.col("enforcement.action").alias("decided"), "enforcement.rule_id", "request.model", F.size("findings").cast("long").alias("n_findings"), injected.alias("injected"))


@query(
    "audit_labels",
    f"""WITH {REQS}, {CTX}, x AS ({_decision_sql(_ALL)}), l AS (SELECT ctx.conv_id, unnest(list_concat(pii_findings, CASE WHEN decided <> 'allow' THEN [rule_id] ELSE [] END)) AS detector FROM ctx JOIN x USING (conv_id))
    SELECT conv_id, string_agg(detector, ',' ORDER BY detector) AS detectors, count(*) AS n FROM l GROUP BY conv_id""",
)
def _(spark, d):
    none = F.array().cast("array<struct<detected:boolean,detector_type:string,confidence:double,findings:array<struct<pattern_name:string,category:string,confidence:double>>>>")
    a = _audited(spark, d).select(F.col("request_id").cast("long").alias("conv_id"), F.explode(audit.labels(none, F.col("findings"), F.col("enforcement.action"), F.col("enforcement.rule_id"))).alias("l"))
    return a.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list("l.detector")), ",").alias("detectors"), F.count("*").alias("n"))


@query(
    "enrichment_joined",
    f"WITH {REQS} SELECT conv_id, CASE WHEN {any_rx('t', DETECTORS['threat'])} THEN 'ENRICH' END AS kind FROM reqs",
)
def _(spark, d):
    """Audit rows with what was found after the decision, and the line that tells of it."""
    rows = requests(spark, d).select(F.col("conv_id").cast("string").alias("audit_id"), F.lit("2024-01-20").cast("timestamp").alias("ts"), F.create_map(F.lit("threat"), det.detect(F.col("t"), "threat")).alias("detections"), F.array().cast("array<struct<pattern:string>>").alias("findings"))
    joined = audit.with_enrichment(rows.select("audit_id"), audit.enrichment(rows))
    line = F.when(F.col("detector_snapshot").isNotNull(), audit.compact_enrichment(F.col("audit_id")))
    return joined.select(F.col("audit_id").cast("long").alias("conv_id"), F.regexp_extract(line, r"^\[(\w+)\] parent=\d+$", 1).alias("kind"))


@query("control_families", "SELECT doc_id, CASE WHEN quality = 1 THEN 'true' ELSE 'false' END AS injected, CAST(toxic AS VARCHAR) AS score FROM labels")
def _(spark, d):
    facts = F.create_map(F.lit("agent_integrity.injection_detected"), (F.col("quality") == 1).cast("string"), F.lit("content_safety.toxicity_score"), F.col("toxic").cast("string"), F.lit("plain"), F.lit("x"))
    rows = table(spark, d, "labels").select("doc_id", audit.families(facts).alias("f"))
    return rows.select("doc_id", F.col("f")["agent_integrity"]["injection_detected"].alias("injected"), F.col("f")["content_safety"]["toxicity_score"].alias("score"))


# --- streams' audit ---------------------------------------------------------------------------


@query(
    "stream_audit",
    f"""WITH RECURSIVE {TURNS}, x AS (SELECT conv_id * 1000 + turn AS stream_id, string_split(t, ' ') AS p FROM turns), c AS (SELECT stream_id, unnest(range(len(p))) AS seq, unnest(list_transform(p, lambda w: w || ' ')) AS chunk FROM x),
    {flush_ctes('c', 1 << 20)}, ft AS (SELECT stream_id, flush_seq, text AS t FROM f), h AS (SELECT stream_id, flush_seq, {any_rx('t', PII)} AS hit FROM (SELECT * FROM ft WHERE strlen(t) >= 5)),
    s AS (SELECT stream_id, bool_or(hit) AS hit FROM h GROUP BY stream_id)
    SELECT f.stream_id, coalesce(any_value(s.hit), false) AS pii_detected, CASE WHEN coalesce(any_value(s.hit), false) THEN 'flag' ELSE 'allow' END AS streaming_action, count(*) AS flushes, CAST(count(*) + 1 AS BIGINT) AS frames_emitted FROM f LEFT JOIN s ON s.stream_id = f.stream_id GROUP BY f.stream_id""",
)
def _(spark, d):
    """Audit rows of responses: what their streams held and became."""
    t = _turns(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("stream_id"), "t")
    deltas = F.transform(F.split("t", " "), lambda w: frames.encode_text("openai", F.concat(w, F.lit(" "))))
    chunks = t.select("stream_id", F.posexplode(F.concat(deltas, F.array(F.lit("data: [DONE]\n\n")))).alias("seq", "chunk")).withColumn("ts", F.timestamp_seconds(F.col("seq")))
    totals = live.totals(live.enforce(chunks, _STREAM_RULES, 1 << 20), chunks)
    finding = pii.FINDING
    asked = t.select(F.col("stream_id").cast("string").alias("request_id"), F.array().cast(f"array<{finding}>").alias("findings"), F.struct(F.lit("allow").alias("action")).alias("enforcement"), F.lit('{"pii_detected":false}').alias("context_snapshot"))
    a = audit.stream_audit(asked, totals)
    flushes = F.col("streaming.buffer_flushes.on_boundary") + F.col("streaming.buffer_flushes.on_cap") + F.col("streaming.buffer_flushes.on_end")
    return a.select(F.col("request_id").cast("long").alias("stream_id"), F.get_json_object("context_snapshot", "$.pii_detected").cast("boolean").alias("pii_detected"), "enforcement.streaming_action", flushes.alias("flushes"), "streaming.frames_emitted")


@query("stream_modes", "SELECT conv_id, turn, CASE WHEN conv_id % 7 = 0 THEN 'passthrough' WHEN (conv_id + turn) % 5 IN (1, 3, 4) THEN 'enforce' ELSE 'observe' END AS mode FROM conversations")
def _(spark, d):
    mode = frames.mode_of(F.col("conv_id") % 7 != 0, pick(tuple(pol.RANKS), F.col("conv_id") + F.col("turn")))
    return table(spark, d, "conversations").select("conv_id", "turn", mode.alias("mode"))


@query(
    "sse_reassembled",
    "SELECT conv_id, CAST(i - 1 AS INT) AS event_seq, md5(text) AS text_md5 FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations)",
)
def _(spark, d):
    """Events of responses that arrive in chunks of 61 characters, whatever lies on their borders."""
    c = table(spark, d, "conversations").select("conv_id", "turn", frames.encode_text("anthropic", F.col("text")).alias("e"))
    body = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "e"))), lambda x: x["e"]), "").alias("b"))
    chunks = body.select("conv_id", F.posexplode(F.regexp_extract_all("b", F.lit("(?s).{1,61}"), F.lit(0))).alias("seq", "chunk"))
    events = frames.reassemble(chunks, ["conv_id"]).where("complete")
    found = events.select("conv_id", "event_seq", F.explode(frames.parse_anthropic(F.col("event"))).alias("f"))
    return found.select("conv_id", "event_seq", F.md5(frames.text_delta(F.col("f.data")).cast("binary")).alias("text_md5"))


# --- sinks, holds and time ------------------------------------------------------------------------


@query("jsonl_log", "SELECT event_type, count(*) AS n, min(event_id) AS first_id, round(sum(value), 6) AS total FROM events GROUP BY event_type")
def _(spark, d):
    """Events written as JSON lines and read back."""
    import uuid

    prepare(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/log-{uuid.uuid4().hex}"
    io.write_jsonl(table(spark, d, "events").select("event_id", "event_type", "value"), path)
    back = io.read_jsonl(spark, path, "event_id long, event_type string, value double").where("_corrupt_record is null")
    return back.groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.round(F.sum("value"), 6).alias("total"))


@query("audit_lines", "SELECT event_id, CAST(event_id AS VARCHAR) AS id_in_line, event_type AS type_in_line FROM events")
def _(spark, d):
    line = io.lines(table(spark, d, "events").select("event_id", "event_type")).select("line")
    return line.select(F.get_json_object("line", "$.event_id").cast("long").alias("event_id"), F.get_json_object("line", "$.event_id").alias("id_in_line"), F.get_json_object("line", "$.event_type").alias("type_in_line"))


@query("tenant_hold_page", "WITH h AS (SELECT event_id AS hold_id, ts, count(*) OVER () AS total FROM events WHERE user_id % 3 = 1 AND event_type = 'error') SELECT hold_id, total, total > 25 AS has_more FROM h ORDER BY ts, hold_id LIMIT 20 OFFSET 5")
def _(spark, d):
    h = table(spark, d, "events").select(F.col("event_id").alias("hold_id"), F.col("ts").alias("created_at"), F.col("event_type").alias("status"), F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("tenant_id"))
    return audit.page(h, tenant="t1", status="error", limit=20, offset=5).select("hold_id", "total", "has_more")


@query("phases_timed", "SELECT event_id, 'auth_ms' AS phase, value * 0.5 AS ms FROM events UNION ALL SELECT event_id, 'parse_ms', value * 0.25 FROM events WHERE event_id % 2 = 0")
def _(spark, d):
    v = F.col("value")
    s = table(spark, d, "events").select("event_id", (v * 0.5).alias("auth_ms"), F.when(F.col("event_id") % 2 == 0, v * 0.25).alias("parse_ms"))
    return rollups.phases_long(s, ["event_id"], ("auth_ms", "parse_ms"))


@query(
    "hour_anomalies",
    """WITH h AS (SELECT event_type AS model, date_trunc('hour', ts) AS hour, avg(value) AS mean FROM events GROUP BY ALL), s AS (SELECT model, avg(mean) AS m, stddev_samp(mean) AS s FROM h GROUP BY model)
    SELECT model, strftime(hour, '%Y-%m-%d %H') AS hour, round(mean, 6) AS mean FROM h JOIN s USING (model) WHERE abs(mean - m) > 2 * s""",
)
def _(spark, d):
    s = table(spark, d, "events").select("ts", F.col("event_type").alias("model"), F.col("value").alias("v"))
    return rollups.anomalies(s, "v", ["model"], 2.0).select("model", F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), F.round("mean", 6).alias("mean"))


@query("tenant_settings", "SELECT c_custkey AS request_id, r_name AS tenant_region, r_name IN ('EUROPE') AS data_residency_compliant FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def _(spark, d):
    from palisade.operators import routing

    tenants = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("tenant_id"), F.col("r_name").alias("tenant_region"))
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("request_id"), F.col("c_nationkey").alias("tenant_id"), F.lit("Europe").alias("route_region"))
    return routing.with_tenant(asked, tenants).select("request_id", "tenant_region", "data_residency_compliant")
