"""Scalar projections over requests and responses, as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MESSAGES = "array<struct<role:string,content:string>>"
MAX_BODY_BYTES = 10 * 1024 * 1024

# Request paths and provider names.
PATH_ACTIONS = {"/v1/chat/completions": "llm.request", "/v1/messages": "llm.request", "/v1/embeddings": "embedding.create", "/v1/images/generations": "image.generate", "/v1/models": "models.list"}
PROVIDER_ALIASES = {"google": "gemini", "aws-bedrock": "bedrock", "azure": "openai", "azure-openai": "openai", "openai": "openai", "anthropic": "anthropic", "gemini": "gemini", "bedrock": "bedrock"}


def model_of(body: Column) -> Column:
    return F.get_json_object(body, "$.model")


def rewrite_model(body: Column, model: Column) -> Column:
    """The body with its model replaced; keys come out sorted.  A body that is no JSON object, or that repeats a key, stays as it is."""
    fields = F.map_filter(F.try_parse_json(body).try_cast("map<string,variant>"), lambda k, _: k != "model")
    quoted = F.try_parse_json(F.to_json(F.struct(model.alias("m")))).try_cast("map<string,variant>")["m"]
    return F.coalesce(F.to_json(F.map_concat(fields, F.create_map(F.lit("model"), quoted))), body)


def stream_of(body: Column) -> Column:
    return F.coalesce(F.get_json_object(body, "$.stream").cast("boolean"), F.lit(False))


def user_text(body: Column) -> Column:
    """String contents of user messages joined by a space; else ``input``, else ``prompt``."""
    messages = F.from_json(F.get_json_object(body, "$.messages"), "array<map<string,string>>")
    # Multi-part contents are arrays in the body and are left out.
    texts = F.filter(messages, lambda m: (m["role"] == "user") & m["content"].isNotNull() & ~F.coalesce(m["content"], F.lit("")).rlike(r"^\s*[\[{]"))
    joined = F.array_join(F.transform(texts, lambda m: m["content"]), " ")
    return F.coalesce(F.when(F.size(texts) > 0, joined), F.get_json_object(body, "$.input"), F.get_json_object(body, "$.prompt"), F.lit(""))


def requested_tools(body: Column) -> Column:
    tools = F.from_json(F.get_json_object(body, "$.tools"), "array<struct<type:string,function:struct<name:string>>>")
    names = F.transform(tools, lambda t: t["function"]["name"])
    return F.coalesce(F.filter(names, lambda n: n.isNotNull()), F.array().cast("array<string>"))


def response_tools(body: Column) -> Column:
    """Tool names of a response, in the first of the three shapes that has any."""
    empty = F.array().cast("array<string>")

    def some(names: Column) -> Column:
        return F.coalesce(F.filter(names, lambda n: n.isNotNull()), empty)

    blocks = F.from_json(F.get_json_object(body, "$.content"), "array<struct<type:string,name:string>>")
    anthropic = some(F.transform(F.filter(blocks, lambda b: b["type"] == "tool_use"), lambda b: b["name"]))
    parts = F.from_json(F.get_json_object(body, "$.candidates"), "array<struct<content:struct<parts:array<struct<functionCall:struct<name:string>>>>>>")
    gemini = some(F.flatten(F.transform(parts, lambda c: F.transform(c["content"]["parts"], lambda p: p["functionCall"]["name"]))))
    choices = F.from_json(F.get_json_object(body, "$.choices"), "array<struct<message:struct<tool_calls:array<struct<function:struct<name:string>>>>>>")
    openai = some(F.flatten(F.transform(choices, lambda c: F.coalesce(F.transform(c["message"]["tool_calls"], lambda t: t["function"]["name"]), empty))))
    return F.when(F.size(anthropic) > 0, anthropic).when(F.size(gemini) > 0, gemini).otherwise(openai)


def action_of_path(path: Column) -> Column:
    return reduce(lambda acc, kv: acc.when(path == kv[0], kv[1]), PATH_ACTIONS.items(), F.when(F.lit(False), "")).otherwise("llm.request")


def response_action(tools: Column) -> Column:
    return F.when(F.size(tools) > 0, "tool.call").otherwise("llm.response")


def data_residency(tenant_region: Column, route_region: Column) -> Column:
    return F.when(tenant_region.isNull(), True).when(route_region.isNull(), False).when(route_region == "global", True).otherwise(F.lower(tenant_region) == F.lower(route_region))


def business_hours(ts: Column, window: Column, zone: Column) -> Column:
    """Whether a UTC time falls in a ``HH:MM-HH:MM`` window, end exclusive, in a zone."""
    p = r"^([01]?\d|2[0-3]):([0-5]\d)-([01]?\d|2[0-3]):([0-5]\d)$"

    def part(i: int) -> Column:
        return F.when(window.rlike(p), F.regexp_extract(window, p, i)).cast("int")

    start, end = part(1) * 60 + part(2), part(3) * 60 + part(4)
    local = F.when(zone.rlike(r"^(UTC|[A-Z][A-Za-z_]+/[A-Za-z_/+-]+)$"), F.from_utc_timestamp(ts, zone))
    now = F.hour(local) * 60 + F.minute(local)
    inside = F.when(start <= end, (now >= start) & (now < end)).otherwise((now >= start) | (now < end))
    return F.coalesce(inside, F.lit(False))


def principal_of(bound: Column, header: Column, reserved: Sequence[str] = ()) -> Column:
    """Agent id: the bound prefix wins; unbound ids lose one of the reserved prefixes."""
    free = header
    for name in reserved:
        free = F.when(header.startswith(f"{name}:"), F.substr(header, F.lit(len(name) + 2))).otherwise(free)
    return F.coalesce(F.when(bound.isNotNull(), F.when(header.isNull(), bound).when(header.startswith(F.concat(bound, F.lit(":"))) | (header == bound), header).otherwise(F.concat(bound, F.lit(":"), header))), F.when(free != "", free), F.lit("anonymous"))


def mcp_id(header: Column) -> Column:
    return F.when(header.rlike(r"^[A-Za-z0-9_.-]{1,255}$"), header)


def first_bytes(text: Column, most: int) -> Column:
    """The characters that lie in the first ``most`` bytes."""
    # A cut inside a character leaves a broken tail of up to three bytes.
    raw = text.cast("binary")
    return F.coalesce(*(F.try_validate_utf8(F.substring(raw, 1, most - k).cast("string")) for k in range(4)), F.substring(raw, 1, most).cast("string"))


def truncate_payload(text: Column, most: int) -> Column:
    """At most ``most`` bytes: cut at ``most`` - 14 on a character border, then a mark."""
    return F.when(F.octet_length(text) > most, F.concat(first_bytes(text, most - 14), F.lit("[…truncated]"))).otherwise(text)


def keeps_payload(mode: str, action: Column) -> Column:
    return {"never": F.lit(False), "always": F.lit(True), "on_enforcement": action != "allow"}[mode]


def trace_context(header: Column) -> Column:
    p = r"^00-([0-9a-fA-F]{32})-([0-9a-fA-F]{16})-([0-9a-fA-F]{2})$"
    trace, span = F.regexp_extract(header, p, 1), F.regexp_extract(header, p, 2)
    ok = header.rlike(p) & ~trace.rlike("^0+$") & ~span.rlike("^0+$")
    return F.when(ok, F.struct(F.lower(trace).alias("trace_id"), F.lower(span).alias("span_id")))


def provider_of(name: Column, path: Column) -> Column:
    low = F.lower(name)
    named = reduce(lambda acc, kv: acc.when(low == kv[0], kv[1]), PROVIDER_ALIASES.items(), F.when(F.lit(False), ""))
    by_path = F.when(path.contains("/v1/messages"), "anthropic").when(path.contains("generateContent"), "gemini").when(path.contains("converse") | path.contains("invoke"), "bedrock").otherwise("openai")
    return F.coalesce(named, by_path)


def key_hash(key: Column) -> Column:
    return F.sha2(key, 256)


def input_header(principal: Column, action: Column, resource: Column, context: Column) -> Column:
    full = F.to_json(F.struct(principal.alias("principal"), action.alias("action"), resource.alias("resource"), context.alias("context")))
    short = F.to_json(F.struct(principal.alias("principal"), action.alias("action"), resource.alias("resource")))
    return F.when(F.octet_length(full) > 4096, short).otherwise(full)


def audit_id(*keys: Column) -> Column:
    """Sixteen hex digits, the same whenever the row is computed again."""
    return F.substring(F.sha2(F.concat_ws("|", *keys), 256), 1, 16)
