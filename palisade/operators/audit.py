"""Audit and enrichment rows, their listings and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LABEL = "array<struct<label_type:string,detector:string,confidence:double,location:string,metadata:map<string,string>>>"


def labels(detections: Column, pii: Column, action: Column, rule_id: Column) -> Column:
    """One label for each detector finding (array of detect() structs) and each personal-data finding, and one for a policy that acted."""
    of_detectors = F.flatten(F.transform(detections, lambda d: F.transform(d["findings"], lambda f: F.struct(F.lit("detector").alias("label_type"), d["detector_type"].alias("detector"), f["confidence"].alias("confidence"), F.lit("request").alias("location"), F.create_map(F.lit("category"), f["category"], F.lit("pattern"), f["pattern_name"]).alias("metadata")))))
    of_pii = F.transform(pii, lambda f: F.struct(F.lit("pii").alias("label_type"), f["pattern"].alias("detector"), F.lit(1.0).alias("confidence"), f["location"].alias("location"), F.create_map(F.lit("count"), f["count"].cast("string"), F.lit("redacted_to"), f["redacted_to"]).alias("metadata")))
    of_policy = F.when(action != "allow", F.array(F.struct(F.lit("policy").alias("label_type"), F.coalesce(rule_id, F.lit("")).alias("detector"), F.lit(1.0).alias("confidence"), F.lit("request").alias("location"), F.create_map(F.lit("action"), action).alias("metadata")))).otherwise(F.array().cast(_LABEL))
    return F.concat(F.coalesce(of_detectors, F.array().cast(_LABEL)), F.coalesce(of_pii, F.array().cast(_LABEL)), of_policy)


def audit_rows(df: DataFrame) -> DataFrame:
    """Nested audit rows from decided requests (columns as ``fact_rows`` and ``evaluate`` leave them)."""
    d = F.col("decision")
    return df.select(
        "audit_id",
        "request_id",
        F.col("ts").alias("timestamp"),
        "tenant_id",
        "agent_id",
        F.struct(F.lit("POST").alias("method"), F.col("path"), F.col("model"), F.col("streaming")).alias("request"),
        F.struct(F.col("status_code")).alias("response"),
        F.struct(F.col("upstream_ms"), F.col("overhead_ms")).alias("latency"),
        "findings",
        F.struct(d["action"].alias("action"), d["rule_id"].alias("rule_id"), d["description"].alias("description"), d["regulatory_mapping"].alias("regulatory_mapping"), d["matched_rules"].alias("matched_rules")).alias("enforcement"),
        F.to_json(F.struct(*(F.col(c) for c in ("model", "streaming", "pii_detected", "pii_findings", "injection_detected", "jailbreak_detected", "exfiltration_detected", "tool_names")))).alias("context_snapshot"),
    )


def stream_audit(audit: DataFrame, totals: DataFrame, provider: str = "openai", scanned: bool = True) -> DataFrame:
    """Audit rows of streams, from those of their requests and ``streaming.live.totals`` (request_id for stream_id).

    Findings of the stream that replaced something join the request's; the others
    stay with the stream.  Adds streaming; enforcement gets streaming_action, and
    a snapshot says that personal data was found if the stream held any.
    """
    t = totals.select(F.col("stream_id").cast("string").alias("_stream"), *(F.col(c).alias(f"_{c}") for c in totals.columns if c != "stream_id"))
    joined = audit.join(t, audit["request_id"].cast("string") == t["_stream"], "left")
    found = F.coalesce(F.filter("_findings", lambda f: f["redacted_to"] != ""), F.expr("slice(_findings, 1, 0)"))
    own = next(f.dataType for f in audit.schema if f.name == "findings")
    more = F.coalesce(F.concat("findings", found.cast(own)), F.col("findings"))
    streaming = F.when(
        F.col("_stream").isNotNull(),
        F.struct(
            F.lit(provider).alias("provider"),
            F.col("_verdict").alias("action"),
            F.lit("enabled" if scanned else "disabled").alias("streaming_scan"),
            F.col("_findings").alias("findings"),
            *(F.col(f"_{c}").alias(c) for c in ("bytes_received", "bytes_emitted", "frames_emitted")),
            F.struct(*(F.col(f"_flushes_{c}").alias(f"on_{c}") for c in ("boundary", "cap", "end"))).alias("buffer_flushes"),
            F.struct(*(F.col(f"_{c}").alias(c) for c in ("first_byte_ms", "stream_duration_ms"))).alias("latency"),
        ),
    )
    enforcement = F.col("enforcement").withField("streaming_action", F.col("_verdict")).withField("observed", F.col("enforcement.action") == "flag")
    patched = F.regexp_replace("context_snapshot", '"pii_detected":false', '"pii_detected":true')
    snapshot = F.when(F.size(more) > 0, patched).otherwise(F.col("context_snapshot"))
    return joined.withColumns({"findings": more, "enforcement": enforcement, "context_snapshot": snapshot, "streaming": streaming}).select(*audit.columns, "streaming")


def compact_enrichment(parent: Column) -> Column:
    """The line of an enrichment row."""
    return F.concat(F.lit("[ENRICH] parent="), parent)


def compact_line(action: Column, method: Column, path: Column, model: Column, matched: Column, patterns: Column, rule_id: Column, latency_ms: Column) -> Column:
    """One line: action, request, rules by action (strictest first), matched patterns and latency."""

    def of(name: str) -> Column:
        ids = F.transform(F.filter(matched, lambda r: r["action"] == name), lambda r: r["rule_id"])
        return F.when(F.size(ids) > 0, F.concat(F.lit(f"{name}="), F.array_join(ids, ",")))

    rules = [of(a) for a in ("block", "hold", "flag", "transform", "allow")]
    fallback = F.when((F.coalesce(F.size(matched), F.lit(0)) <= 0) & rule_id.isNotNull(), F.concat(F.lit("rule="), rule_id))
    seen = F.array_distinct(patterns)
    return F.concat_ws(" ", F.concat(F.lit("["), F.upper(action), F.lit("]")), method, path, F.concat(F.lit("model="), model), *rules, fallback, F.when(F.size(seen) > 0, F.concat(F.lit("matched="), F.array_join(seen, ","))), F.concat(F.lit("latency="), F.format_string("%.1f", latency_ms), F.lit("ms")))


def enrichment(df: DataFrame) -> DataFrame:
    """Rows for what ran after the decision (column detections: map of name to detect() struct), where it found something."""
    hit = F.exists(F.map_values("detections"), lambda d: d["detected"]) | (F.size("findings") > 0)
    snapshot = F.transform_values("detections", lambda _, d: F.struct(d["detected"].alias("detected"), d["confidence"].alias("confidence"), F.size(d["findings"]).alias("findings_count")))
    return df.where(hit).select(F.substring(F.sha2(F.concat(F.lit("e:"), "audit_id"), 256), 1, 16).alias("audit_id"), F.col("audit_id").alias("parent_audit_id"), F.lit("enrichment").alias("type"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), snapshot.alias("detector_snapshot"))


def with_enrichment(audit: DataFrame, enriched: DataFrame) -> DataFrame:
    side = enriched.select(F.col("parent_audit_id").alias("_p"), F.col("detector_snapshot"))
    return audit.join(side, audit["audit_id"] == side["_p"], "left").drop("_p")


# --- control facts ------------------------------------------------------------------

# Facts by detector; "flag", "score" (as whole percent) or a metadata key.
CONTROL_FACTS: dict[str, tuple[tuple[str, str], ...]] = {
    "injection": (("agent_integrity.injection_detected", "flag"), ("agent_integrity.injection_score", "score"), ("agent_integrity.injection_type", "type")),
    "jailbreak": (("agent_integrity.jailbreak_detected", "flag"), ("agent_integrity.jailbreak_score", "score")),
    "confidential": (("data_protection.confidential_detected", "flag"),),
    "exfiltration": (("data_protection.exfiltration_detected", "flag"), ("data_protection.exfiltration_risk", "score"), ("data_protection.exfiltration_url_count", "url_count")),
    "threat": (("content_safety.threat_detected", "flag"), ("content_safety.threat_score", "score")),
    "toxicity": (("content_safety.toxicity_score", "score"),),
    "identity_claim": (("identity_safety.disclosure_detected", "flag"),),
    "bias": (("content_safety.bias_detected", "flag"), ("content_safety.bias_score", "score")),
    "tool_governance": (("tool_governance.unauthorized_detected", "flag"), ("tool_governance.unauthorized_tools", "tool_names"), ("tool_governance.highest_risk", "risk_category")),
}


def control_facts(signal: Column, detector: str) -> Column:
    """Map of dotted names to values of one detector's signal struct."""
    pairs = []
    for name, what in CONTROL_FACTS.get(detector, ()):
        value = signal["flag"].cast("string") if what == "flag" else (signal["score"] * 100).cast("long").cast("string") if what == "score" else F.coalesce(signal["metadata"][what], F.lit("0" if what == "url_count" else ""))
        pairs += [F.lit(name), value]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")


def evidence_labels(facts: Column) -> Column:
    """Families of the facts and the stems of true ``_detected`` and ``_present`` facts, sorted."""
    families = F.transform(F.filter(F.map_keys(facts), lambda k: k.contains(".")), lambda k: F.substring_index(k, ".", 1))
    on = F.map_filter(facts, lambda k, v: (v == "true") & k.rlike("_(detected|present)$"))
    stems = F.transform(F.map_keys(on), lambda k: F.regexp_replace(F.substring_index(k, ".", -1), "_(detected|present)$", ""))
    return F.array_sort(F.array_distinct(F.concat(families, stems)))


def families(facts: Column) -> Column:
    """Map of family to a map of its fields."""
    names = F.array_distinct(F.transform(F.filter(F.map_keys(facts), lambda k: k.contains(".")), lambda k: F.substring_index(k, ".", 1)))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n, F.transform_keys(F.map_filter(facts, lambda k, _: F.substring_index(k, ".", 1) == n), lambda k, _: F.regexp_replace(k, r"^[^.]*\.", "")))))


# --- listings and retention -----------------------------------------------------------


def retained(rows: DataFrame, now: str, days: int, ts: str = "timestamp") -> DataFrame:
    """Rows of the last days by their timestamp string, and those without one."""
    cutoff = F.date_format(F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"), "yyyy-MM-dd'T'HH:mm:ss")
    return rows.where(F.coalesce(F.col(ts) >= cutoff, F.lit(True)))


def purge(rows: DataFrame, now: str, days: int, ts: str = "timestamp") -> tuple[DataFrame, DataFrame]:
    """(rows that stay, one row with the number that go)."""
    cutoff = F.date_format(F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"), "yyyy-MM-dd'T'HH:mm:ss")
    return retained(rows, now, days, ts), rows.agg(F.count_if(F.coalesce(F.col(ts) < cutoff, F.lit(False))).alias("purged"))


def page(holds: DataFrame, tenant: str | None = None, status: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of holds by creation time (at most 200), with total and has_more on each row."""
    limit = max(0, min(limit, 200))
    rows = holds
    if tenant is not None:
        rows = rows.where(F.col("tenant_id") == tenant)
    if status is not None:
        rows = rows.where(F.col("status") == status)
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy("created_at", "hold_id").offset(offset).limit(limit).join(F.broadcast(total), F.lit(True)).withColumn("has_more", F.col("total") > offset + limit)


def resolve_holds(created: DataFrame, decided: DataFrame, now: Column, timeout_s: int = 30) -> DataFrame:
    """Holds with their state: the first decision in time, else expired after the timeout, else pending."""
    d = decided.select(F.col("hold_id").alias("_h"), "verdict", "decided_at")
    end = F.col("created_at") + F.make_interval(secs=F.lit(timeout_s))
    in_time = (F.col("decided_at") >= F.col("created_at")) & (F.col("decided_at") < end)
    joined = created.join(d, (F.col("hold_id") == F.col("_h")) & in_time, "left").groupBy(*created.columns).agg(F.min_by("verdict", "decided_at").alias("verdict"))
    return joined.withColumn("status", F.coalesce("verdict", F.when(now >= end, F.lit("expired")).otherwise("pending"))).drop("verdict")


def capacity(holds: DataFrame, most: int) -> DataFrame:
    return holds.agg(F.count_if(F.col("status") == "pending").alias("active")).withColumn("full", F.col("active") >= most)
