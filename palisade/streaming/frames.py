"""Response frames: reassembly, parsing, encoding and totals.

Server-sent events are text and are handled by built-in expressions; the binary
event stream is parsed and made by Arrow-batched functions.
"""

from __future__ import annotations

import json
import struct
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FRAME = "struct<event:string,data:string,is_done:boolean,is_error:boolean>"


def reassemble(chunks: DataFrame, keys: list[str], seq: str = "seq", chunk: str = "chunk") -> DataFrame:
    """Complete events of each stream in order: (keys, event_seq, event, complete).

    A stream's own chunks are joined; the part after the last blank line is its
    remainder and is not complete.
    """
    joined = chunks.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(seq, chunk))), lambda x: x[chunk]), "").alias("_all"))
    parts = joined.select(*keys, F.split("_all", "\n\n", -1).alias("_p"))
    rows = parts.select(*keys, F.posexplode("_p").alias("event_seq", "event"), F.size("_p").alias("_n"))
    return rows.withColumn("complete", F.col("event_seq") < F.col("_n") - 1).where((F.col("event") != "") | F.col("complete")).drop("_n")


def _lines(event: Column, prefix: str) -> Column:
    hit = F.filter(F.split(event, "\r?\n"), lambda x: x.startswith(prefix))
    return F.transform(hit, lambda x: F.trim(F.substring(x, len(prefix) + 1, 1 << 30)))


def parse_openai(event: Column) -> Column:
    """Array of frames: one for each data line; [DONE] ends, an error key is an error."""
    return F.transform(_lines(event, "data:"), lambda d: F.struct(F.lit(None).cast("string").alias("event"), d.alias("data"), (d == "[DONE]").alias("is_done"), F.get_json_object(d, "$.error").isNotNull().alias("is_error")).cast(_FRAME))


def parse_anthropic(event: Column) -> Column:
    name = F.get(_lines(event, "event:"), F.lit(0))
    return F.transform(_lines(event, "data:"), lambda d: F.struct(name.alias("event"), d.alias("data"), F.coalesce(name == "message_stop", F.get_json_object(d, "$.type") == "message_stop", F.lit(False)).alias("is_done"), F.coalesce(name == "error", F.lit(False)).alias("is_error")).cast(_FRAME))


def parse_gemini(event: Column) -> Column:
    """Comments and data that is no JSON are dropped; a final finish or block reason ends."""

    def frame(d: Column) -> Column:
        finish, blocked = F.get_json_object(d, "$.candidates[0].finishReason"), F.get_json_object(d, "$.promptFeedback.blockReason")
        done = (F.coalesce(finish, F.lit("FINISH_REASON_UNSPECIFIED")) != "FINISH_REASON_UNSPECIFIED") | blocked.isNotNull()
        return F.struct(F.lit(None).cast("string").alias("event"), d.alias("data"), done.alias("is_done"), F.get_json_object(d, "$.error").isNotNull().alias("is_error")).cast(_FRAME)

    return F.transform(F.filter(_lines(event, "data:"), lambda d: F.get_json_object(d, "$").isNotNull()), frame)


PARSERS = {"openai": parse_openai, "anthropic": parse_anthropic, "gemini": parse_gemini}


def parse(event: Column, provider: Column) -> Column:
    out = F.when(F.lit(False), F.array().cast(f"array<{_FRAME}>"))
    for name, parser in PARSERS.items():
        out = out.when(provider == name, parser(event))
    return out.otherwise(parse_openai(event))


def text_delta(data: Column) -> Column:
    """Text that a frame adds, in any provider's shape; null where it adds none."""
    gemini = F.from_json(F.get_json_object(data, "$.candidates[0].content.parts"), "array<struct<text:string>>")
    joined = F.array_join(F.filter(F.transform(gemini, lambda p: p["text"]), lambda t: t.isNotNull()), "")
    return F.coalesce(F.get_json_object(data, "$.choices[0].delta.content"), F.get_json_object(data, "$.delta.text"), F.get_json_object(data, "$.delta.thinking"), F.when(joined != "", joined))


def tool_names(data: Column) -> Column:
    empty = F.array().cast("array<string>")
    openai = F.transform(F.from_json(F.get_json_object(data, "$.choices[0].delta.tool_calls"), "array<struct<function:struct<name:string>>>"), lambda t: t["function"]["name"])
    anthropic = F.when(F.get_json_object(data, "$.content_block.type") == "tool_use", F.array(F.get_json_object(data, "$.content_block.name")))
    gemini = F.transform(F.from_json(F.get_json_object(data, "$.candidates[0].content.parts"), "array<struct<functionCall:struct<name:string>>>"), lambda p: p["functionCall"]["name"])
    return F.filter(F.concat(*(F.coalesce(x, empty) for x in (openai, anthropic, gemini))), lambda n: n.isNotNull())


def tool_arguments(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Argument fragments (columns seq, data) joined by call index."""
    calls = F.from_json(F.get_json_object("data", "$.choices[0].delta.tool_calls"), "array<struct<index:int,function:struct<arguments:string>>>")
    openai = F.transform(calls, lambda t: F.struct(t["index"].alias("index"), t["function"]["arguments"].alias("fragment")))
    anthropic = F.array(F.struct(F.get_json_object("data", "$.index").cast("int").alias("index"), F.get_json_object("data", "$.delta.partial_json").alias("fragment")))
    rows = frames.select(*keys, "seq", F.explode(F.coalesce(openai, anthropic)).alias("c")).where("c.fragment is not null")
    return rows.groupBy(*keys, F.col("c.index").alias("index")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("seq"), F.col("c.fragment").alias("f")))), lambda x: x["f"]), "").alias("arguments"))


def distinct_tools(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Tool names of a stream, in the order they first appear."""
    rows = frames.select(*keys, "seq", F.posexplode(tool_names(F.col("data"))).alias("i", "name"))
    first = rows.groupBy(*keys, "name").agg(F.min(F.struct("seq", "i")).alias("at"))
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("tools"))


def stream_stats(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Totals of each stream (columns ts, raw, emitted, flush_reason, verdict)."""
    size = F.octet_length("raw")
    return frames.groupBy(*keys).agg(
        F.count("*").alias("frames_received"),
        F.count_if("emitted").alias("frames_emitted"),
        F.sum(size).cast("long").alias("bytes_received"),
        F.coalesce(F.sum(F.when(F.col("emitted"), size)), F.lit(0)).cast("long").alias("bytes_emitted"),
        *(F.count_if(F.col("flush_reason") == r).alias(f"flushes_{r}") for r in ("boundary", "cap", "end")),
        F.max(F.struct(_rank(F.col("verdict")).alias("r"), F.col("verdict").alias("v")))["v"].alias("verdict"),
        (F.unix_millis(F.max("ts")) - F.unix_millis(F.min("ts"))).alias("duration_ms"),
    )


def _rank(verdict: Column) -> Column:
    from palisade.plans.policy import _rank as rank

    return F.coalesce(rank(verdict), F.lit(0))


def enforce(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Adds emitted: frames after the first block or hold of a stream (column verdict) are not, nor is that frame."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return frames.withColumn("emitted", F.max(F.col("verdict").isin("block", "hold").cast("int")).over(w) == 0)


def mode_of(enabled: Column, request_action: Column) -> Column:
    """How a stream is handled: passthrough, observe or enforce."""
    return F.when(~enabled, "passthrough").when(request_action.isin("transform", "hold", "block"), "enforce").otherwise("observe")


# --- encoding ----------------------------------------------------------------------


def encode_text(provider: str, text: Column) -> Column:
    if provider == "anthropic":
        body = F.to_json(F.struct(F.lit("content_block_delta").alias("type"), F.lit(0).alias("index"), F.struct(F.lit("text_delta").alias("type"), text.alias("text")).alias("delta")))
        return F.concat(F.lit("event: content_block_delta\ndata: "), body, F.lit("\n\n"))
    if provider == "gemini":
        return F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(text.alias("text"))).alias("parts"), F.lit("model").alias("role")).alias("content"))).alias("candidates"))), F.lit("\n\n"))
    return F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.lit(0).alias("index"), F.struct(text.alias("content")).alias("delta"))).alias("choices"))), F.lit("\n\n"))


def encode_error(provider: str, message: Column) -> Column:
    """An error frame; the message of a blocked stream is the id of the rule that blocked it."""
    body = F.to_json(F.struct(F.struct(message.alias("message"), F.lit("policy_violation").alias("type")).alias("error")))
    head = "event: error\ndata: " if provider == "anthropic" else "data: "
    return F.concat(F.lit(head), body, F.lit("\n\n"))


def encode_hold(provider: str, text: Column) -> Column:
    """A last message in place of an answer, and the provider's end of stream."""
    if provider == "anthropic":
        return F.concat(encode_text(provider, text), F.lit('event: message_stop\ndata: {"type":"message_stop"}\n\n'))
    if provider == "gemini":
        content = F.struct(F.array(F.struct(text.alias("text"))).alias("parts"), F.lit("model").alias("role"))
        return F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(content.alias("content"), F.lit("STOP").alias("finishReason"))).alias("candidates"))), F.lit("\n\n"))
    choice = F.struct(F.lit(0).alias("index"), F.struct(text.alias("content")).alias("delta"), F.lit("stop").alias("finish_reason"))
    body = F.to_json(F.struct(F.lit("chatcmpl-hold").alias("id"), F.lit("chat.completion.chunk").alias("object"), F.array(choice).alias("choices")))
    return F.concat(F.lit("data: "), body, F.lit("\n\ndata: [DONE]\n\n"))


def encode_frame(provider: str, event: Column, data: Column) -> Column:
    """A frame as it came, with the line breaks that parsing took."""
    line = F.concat(F.lit("data: "), data, F.lit("\n\n"))
    return F.when(event.isNotNull(), F.concat(F.lit("event: "), event, F.lit("\n"), line)).otherwise(line) if provider == "anthropic" else line


def encode_bedrock(event: str, payload: bytes) -> bytes:
    """One binary event-stream message with its checksums."""
    headers = b""
    for k, v in ((":event-type", event), (":content-type", "application/json"), (":message-type", "event")):
        headers += struct.pack(">B", len(k)) + k.encode() + b"\x07" + struct.pack(">H", len(v)) + v.encode()
    prelude = struct.pack(">II", 16 + len(headers) + len(payload), len(headers))
    head = prelude + struct.pack(">I", zlib.crc32(prelude))
    return head + headers + payload + struct.pack(">I", zlib.crc32(head + headers + payload))


def split_bedrock(raw: bytes) -> tuple[list[bytes], bytes]:
    """Complete messages and the rest, which may be less than a prelude.  A length below 12 drops one byte and tries again."""
    out, at = [], 0
    while len(raw) - at >= 12:
        (size,) = struct.unpack_from(">I", raw, at)
        if size < 12:
            at += 1
        elif len(raw) - at < size:
            break
        else:
            out.append(raw[at : at + size])
            at += size
    return out, raw[at:]


def parse_bedrock_message(m: bytes) -> dict:
    """event, data, is_done and is_error of one message; a damaged message is an error that says why."""

    def bad(why: str) -> dict:
        return {"event": "malformed", "data": json.dumps({"error": why}), "is_done": False, "is_error": True}

    if len(m) < 16:
        return bad("too short")
    total, n = struct.unpack_from(">II", m)
    if zlib.crc32(m[:8]) != struct.unpack_from(">I", m, 8)[0]:
        return bad("prelude checksum")
    if total != len(m) or 16 + n > total or zlib.crc32(m[:-4]) != struct.unpack_from(">I", m, total - 4)[0]:
        return bad("message checksum")
    headers, at, end = {}, 12, 12 + n
    while at < end:
        k = m[at + 1 : at + 1 + m[at]].decode("utf-8", "replace")
        at += 1 + m[at]
        kind = m[at]
        at += 1
        if kind == 7 or kind == 6:
            (size,) = struct.unpack_from(">H", m, at)
            headers[k] = m[at + 2 : at + 2 + size].decode("utf-8", "replace")
            at += 2 + size
        elif kind in (0, 1):
            headers[k] = str(kind == 0).lower()
        else:
            at += {2: 1, 3: 2, 4: 4, 5: 8, 8: 8, 9: 16}.get(kind, end)
    event = headers.get(":event-type") or headers.get(":exception-type")
    data = m[12 + n : -4].decode("utf-8", "replace")
    done = event in ("messageStop", "message_stop") or '"message_stop"' in data
    return {"event": event, "data": data, "is_done": done, "is_error": headers.get(":message-type") in ("exception", "error")}


def parse_bedrock(raw: Column) -> Column:
    """Array of frames of a binary stream."""

    @F.pandas_udf(f"array<{_FRAME}>")
    def run(chunks: pd.Series) -> pd.Series:
        return chunks.map(lambda b: [parse_bedrock_message(m) for m in split_bedrock(bytes(b))[0]] if b is not None else None)

    return run(raw)
