"""What happens to a stream's text and tool calls: enforcement of flushes, observation of frames, tools at the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions import pii
from palisade.plans import policy as pol
from palisade.streaming import frames as fr

STOPS = ("block", "hold")
# Where findings of streams were made, and names for rules that have none, as they stand in audit rows.
TEXT, TEXT_POLICY, ARGUMENTS, TOOLS = "streaming_response", "streaming_response_policy", "streaming_tool_args", "streaming_response_tool_calls"
UNNAMED, UNNAMED_TOOLS = "streaming_policy", "streaming_tool_policy"
#: Said in place of a held answer where the rule says nothing.
_HELD = "This answer is held for review."
#: In place of a rule's id where it has none.
_BLOCKED = "policy_block"


def _one(pattern: Column, count: Column, location: str) -> Column:
    """A finding of a policy: it has no token, for nothing is replaced."""
    return F.array(F.struct(pattern.alias("pattern"), F.lit("").alias("redacted_to"), count.cast("int").alias("count"), F.lit(location).alias("location")))


def decide(rows: DataFrame, policies: str | list[pol.Policy], provider: str = "openai") -> DataFrame:
    """Scans each text, decides on it and says what would go out: adds findings, verdict, rule_id, stops and output.

    Personal data is replaced whatever the verdict; a transform replaces its
    pattern after that; a block or hold puts an error (the rule's id) or the hold
    message in the text's place.  Decisions see the facts given and whether this
    text holds personal data.  Where there is a column ``reason``, what is flushed
    at the end is scanned but not decided on.  A null text is empty.
    """
    own = rows.columns
    scanned = pii.scan_and_redact(rows.withColumn("text", F.coalesce("text", F.lit(""))), "text", TEXT, findings="findings", redacted="_scanned")
    facts = scanned.drop("pii_findings", "action").withColumns({"action": F.lit("llm.response"), "streaming": F.lit(True), "pii_detected": F.size("findings") > 0})
    d = F.col("decision")
    asked = F.col("reason") != "end" if "reason" in own else F.lit(True)
    decided = pol.evaluate(policies, facts).withColumns({"verdict": F.when(asked, d["action"]).otherwise("allow"), "rule_id": F.when(asked, d["rule_id"])})
    verdict = F.col("verdict")
    changed = F.when((verdict == "transform") & d["transform_pattern"].isNotNull(), F.replace("_scanned", d["transform_pattern"], d["transform_replace"])).otherwise(F.col("_scanned"))
    output = (
        F.when(verdict == "hold", fr.encode_hold(provider, F.coalesce(d["hold_message"], F.lit(_HELD))))
        .when(verdict == "block", fr.encode_error(provider, F.coalesce("rule_id", F.lit(_BLOCKED))))
        .otherwise(fr.encode_text(provider, changed))
    )
    flagged = F.when(verdict == "flag", F.concat("findings", _one(F.coalesce("rule_id", F.lit(UNNAMED)), F.lit(1), TEXT_POLICY))).otherwise(F.col("findings"))
    return decided.withColumns({"stops": verdict.isin(*STOPS), "output": output, "findings": flagged}).select(*own, "findings", "verdict", "rule_id", "stops", "output")


def enforce_flushes(flushes: DataFrame, policies: str | list[pol.Policy], provider: str = "openai") -> DataFrame:
    """Decides on each flush (stream_id, flush_seq, text, any facts): adds findings, verdict, rule_id, sent and output.

    The first block or hold of a stream sends an error or the hold message in its
    place and nothing after it.  Flushes are decided one by one; only the search
    for a stream's first stop orders the flushes of one stream.
    """
    own = flushes.columns
    up_to_now = Window.partitionBy("stream_id").orderBy("flush_seq").rowsBetween(Window.unboundedPreceding, 0)
    stops = F.sum(F.col("stops").cast("int")).over(up_to_now)
    gated = decide(flushes, policies, provider).withColumn("_stops", stops)
    output = F.when((F.col("_stops") == 0) | ((F.col("_stops") == 1) & F.col("stops")), F.col("output"))
    return gated.withColumns({"sent": F.col("_stops") == 0, "output": output}).select(*own, "findings", "verdict", "rule_id", "sent", "output")


def stream_verdicts(decided: DataFrame) -> DataFrame:
    """The verdict of each stream: its last one that is not allow, among flushes up to the first stop."""
    acted = (F.col("verdict") != "allow") & (F.col("sent") | F.col("output").isNotNull())
    last = F.max_by(F.when(acted, F.col("verdict")), F.when(acted, F.col("flush_seq")))
    return decided.groupBy("stream_id").agg(F.coalesce(last, F.lit("allow")).alias("verdict"))


def observe(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Findings of each stream (keys, seq, data, is_done, is_error) that is sent as it came.

    Every frame's text is scanned by itself, so a match that two frames share is
    not seen; joined tool arguments are scanned when the stream is done.  Returns
    keys, findings, tools, done and verdict (flag or allow).  Only findings are
    gathered by stream, not its text.
    """
    text = F.when(~F.col("is_done") & ~F.col("is_error"), fr.text_delta(F.col("data")))
    found = frames.select(*keys, "seq", "is_done", F.coalesce(pii.scan_only(text, TEXT), F.array().cast(f"array<{pii.FINDING}>")).alias("f"))
    hits = F.collect_list(F.when(F.size("f") > 0, F.struct("seq", "f")))
    per = found.groupBy(*keys).agg(F.flatten(F.transform(F.array_sort(hits), lambda x: x["f"])).alias("_text"), F.bool_or("is_done").alias("done"))
    args = fr.tool_arguments(frames, keys).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", "arguments"))), lambda x: x["arguments"]), " ").alias("_args"))
    out = per.join(args, keys, "left").join(fr.distinct_tools(frames, keys), keys, "left")
    none = F.array().cast(f"array<{pii.FINDING}>")
    late = F.when(F.col("done"), pii.scan_only(F.coalesce("_args", F.lit("")), ARGUMENTS)).otherwise(none)
    out = out.withColumn("findings", F.concat("_text", late)).withColumn("tools", F.coalesce("tools", F.array().cast("array<string>")))
    return out.select(*keys, "findings", "tools", "done", F.when(F.size("findings") > 0, "flag").otherwise("allow").alias("verdict"))


def tools_at_end(streams: DataFrame, policies: str | list[pol.Policy]) -> DataFrame:
    """Decides on the tools that a finished stream called (findings, tools, done, verdict, any facts).

    Flag and block become the stream's verdict and add a finding that counts the
    tools; what was sent cannot be taken back.  Streams without tools, or that
    never ended, keep what they have.
    """
    own = streams.columns
    here = F.col("done") & (F.size("tools") > 0)
    facts = streams.withColumns(
        {
            "action": F.lit("tool.call"),
            "streaming": F.lit(True),
            "pii_detected": F.size("findings") > 0,
            "pii_findings": F.transform("findings", lambda f: f["pattern"]),
            "tool_names": F.col("tools"),
            "tool_count": F.size("tools").cast("long"),
        }
    )
    acted = here & F.col("decision.action").isin("flag", "block")
    finding = _one(F.coalesce("decision.rule_id", F.lit(UNNAMED_TOOLS)), F.size("tools"), TOOLS)
    out = pol.evaluate(policies, facts).withColumns({"verdict": F.when(acted, F.col("decision.action")).otherwise(F.col("verdict")), "findings": F.when(acted, F.concat("findings", finding)).otherwise(F.col("findings"))})
    return out.select(*own)
