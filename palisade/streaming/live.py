"""Responses enforced as they stream: frames put together, text buffered, scanned, decided on and stopped.

One plan, in batch and on a stream.  Frames are parsed, texts are scanned and
policies decide in projections; only three steps depend on what came before, and
each is a small recurrence by stream: the part of a frame that a chunk leaves
over, the text that waits for a blank or the cap, and whether the stream has been
stopped.  In batch they are joins, sums and a window; on a stream they are keyed
states.  The same items come out of both:

    stream_id, at, part (the place among what is sent), kind ("text" or "frame"),
    text, reason, findings, verdict, rule_id, sent, output

Text frames wait in the buffer, every other frame goes on at once.  A frame that
ends the stream, or an error, first flushes what waits; that, and what waits when
a stream breaks off, is scanned but not decided on.  What follows the last blank
line when the stream ends is read as a frame and goes on as it is.  After the
first block or hold nothing is sent.

Chunks have stream_id, seq (a whole number, unique in its stream), chunk and, on
a stream, done: true in the last row of a response.  A stream from which nothing
comes for ``idle`` is over as well.  Rows of a stream are taken in the order of
seq within a micro-batch, and in the order of arrival between them.  Null chunks
are empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from palisade.plans import policy as pol
from palisade.streaming import frames as fr
from palisade.streaming import scan
from palisade.streaming.buffer import Buffer, flush_capped

#: Frames of one event have places of their own.
_FRAMES = 1 << 16
#: Events whose texts are flushed together.
_BLOCK = 512
#: The place of what waits when a stream ends.
LAST = (1 << 63) - 1
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _parsed(events: DataFrame, provider: str) -> DataFrame:
    """stream_id, at, event, data, text, ends, whole and over of the frames of events (stream_id, event_seq, event, complete, over)."""
    none = F.lit(None).cast(fr._FRAME)
    found = F.when(F.col("over"), F.array(none)).otherwise(fr.parse(F.col("event"), F.lit(provider)))
    rows = events.select("stream_id", "event_seq", F.col("complete").alias("whole"), "over", F.posexplode(found).alias("i", "f"))
    ends = F.coalesce(F.col("f.is_done") | F.col("f.is_error"), F.lit(False))
    # The tail of a broken stream isn't buffered.
    text = F.when(F.col("whole") & ~ends, fr.text_delta(F.col("f.data")))
    return rows.select("stream_id", (F.col("event_seq") * _FRAMES + F.col("i")).alias("at"), "f.event", "f.data", text.alias("text"), (ends & F.col("whole")).alias("ends"), "whole", "over")


def _decided(items: DataFrame, policies: str | list[pol.Policy], provider: str, facts: DataFrame | None) -> DataFrame:
    """Items (stream_id, at, part, kind, text, reason, event, data) with what each would send."""
    rows = items if facts is None else items.join(facts, "stream_id", "left")
    out = scan.decide(rows, policies, provider)
    text = F.col("kind") == "text"
    none = F.expr("slice(findings, 1, 0)")
    return out.select(
        "stream_id",
        "at",
        "part",
        "kind",
        F.when(text, F.col("text")).alias("text"),
        F.when(text, F.col("reason")).alias("reason"),
        F.when(text, F.col("findings")).otherwise(none).alias("findings"),
        F.when(text, F.col("verdict")).alias("verdict"),
        F.when(text, F.col("rule_id")).alias("rule_id"),
        (text & F.col("stops")).alias("stops"),
        F.when(text, F.col("output")).when(F.col("kind") == "frame", fr.encode_frame(provider, F.col("event"), F.col("data"))).alias("output"),
    )


def enforce(chunks: DataFrame, policies: str | list[pol.Policy], cap: int, provider: str = "openai", facts: DataFrame | None = None) -> DataFrame:
    """The items of whole responses (stream_id, seq, chunk); ``facts`` has the facts of each stream_id."""
    text = chunks.select("stream_id", "seq", F.coalesce("chunk", F.lit("")).alias("chunk"))
    frames = _parsed(fr.reassemble(text, ["stream_id"]).withColumn("over", F.lit(False)), provider)
    waiting = frames.where("ends or text is not null").select("stream_id", F.col("at").alias("seq"), F.col("text").alias("chunk"), "ends")
    flushes = flush_capped(waiting, cap, F.col("ends"), _FRAMES * _BLOCK)
    place = F.when(F.col("reason") == "end", F.coalesce("ended_at", F.lit(LAST))).otherwise(F.col("last_seq"))
    null = F.lit(None).cast("string")
    texts = flushes.select("stream_id", place.alias("at"), F.lit(0).alias("part"), F.lit("text").alias("kind"), "text", "reason", null.alias("event"), null.alias("data"))
    others = frames.where("text is null").select("stream_id", "at", F.lit(1).alias("part"), F.lit("frame").alias("kind"), null.alias("text"), F.lit("end").alias("reason"), "event", "data")
    rows = _decided(texts.unionByName(others), policies, provider, facts)
    w = Window.partitionBy("stream_id").orderBy("at", "part").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_stops", F.sum(F.col("stops").cast("int")).over(w))
    goes = (F.col("_stops") == 0) | ((F.col("_stops") == 1) & F.col("stops"))
    return rows.withColumns({"sent": F.col("_stops") == 0, "output": F.when(goes, F.col("output"))}).drop("_stops", "stops")


# --- the same on a stream -----------------------------------------------------------


class _Step(StatefulProcessor):
    """A recurrence over the rows of a stream, whose state is one tuple; a state of None ends the stream."""

    schema: str
    columns: list[str]
    order: list[str]
    start: tuple

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, out = self.state.get() if self.state.exists() else self.start, []
        for row in pd.concat(list(rows)).sort_values(self.order, kind="stable").itertuples(index=False):
            state = self.step(self.start if state is None else state, row, out)
        state = self.settle(state, timerValues)
        if state is None:
            self.state.clear()
        else:
            self.state.update(state)
        yield self.frame(key, out)

    def frame(self, key, out: list) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in out], columns=["stream_id", *self.columns])

    def settle(self, state, timers):
        return state

    def step(self, state: tuple, row, out: list) -> tuple | None:
        raise NotImplementedError

    def close(self) -> None:
        pass


class _Reassemble(_Step):
    """Chunks to events; what a stream leaves over is an event when it ends or nothing has come for a while."""

    schema = "rest string, n long, due long"
    columns = ["event_seq", "event", "complete", "over"]
    order = ["seq"]
    start = ("", 0, None)

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def step(self, state, row, out):
        rest, n, due = state
        *events, rest = (rest + (row.chunk or "")).split("\n\n")
        out += [(n + i, e, True, False) for i, e in enumerate(events)]
        n += len(events)
        if not row.done:
            return rest, n, due
        out += self.tail(rest, n)
        if due is not None:
            self.handle.deleteTimer(due)
        return None

    @staticmethod
    def tail(rest: str, n: int) -> list[tuple]:
        return [*([(n, rest, False, False)] if rest else []), (n + 1, None, False, True)]

    def settle(self, state, timers):
        if state is None:
            return None
        rest, n, due = state
        if due is not None:
            self.handle.deleteTimer(due)
        due = timers.getCurrentProcessingTimeInMs() + self.idle_ms
        self.handle.registerTimer(due)
        return rest, n, due

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rest, n, _ = self.state.get() if self.state.exists() else self.start
        self.state.clear()
        yield self.frame(key, self.tail(rest, n))


class _Wait(_Step):
    """Frames to items: texts wait in the buffer, others go on."""

    schema = "held string, n int, last long"
    columns = ["at", "part", "kind", "text", "reason", "event", "data"]
    order = ["at"]
    start = ("", 0, -1)

    def __init__(self, cap: int):
        self.cap = cap

    def step(self, state, row, out):
        buffer = Buffer(self.cap, *state)
        if row.over or row.ends:
            if got := buffer.end():
                out.append((LAST if row.over else row.at, 0, "text", got[2], "end", None, None))
            if row.over:
                out.append((LAST, 1, "over", None, "end", None, None))
                return None
        if row.text is not None:
            if got := buffer.push(row.text, row.at):
                out.append((row.at, 0, "text", got[2], got[3], None, None))
        else:
            out.append((row.at, 1, "frame", None, "end", row.event, row.data))
        return buffer.state


class _Gate(_Step):
    """Lets items through up to the first that stops the stream; its last row tells the stream's verdict."""

    schema = "stopped boolean, verdict string"
    columns = ["at", "part", "kind", "text", "reason", "findings", "verdict", "rule_id", "sent", "output"]
    order = ["at", "part"]
    start = (False, "allow")

    def step(self, state, row, out):
        stopped, verdict = state
        if row.kind == "over":
            out.append((row.at, row.part, "over", None, None, [], verdict, None, False, None))
            return None
        goes = not stopped
        if goes and row.verdict not in (None, "allow"):
            verdict = row.verdict
        stopped = stopped or bool(row.stops)
        out.append((row.at, row.part, row.kind, row.text, row.reason, list(row.findings), row.verdict, row.rule_id, not stopped, row.output if goes else None))
        return stopped, verdict


_ITEM = "stream_id long, at long, part int, kind string, text string, reason string"


def enforce_stream(chunks: DataFrame, policies: str | list[pol.Policy], cap: int, provider: str = "openai", facts: DataFrame | None = None, idle_ms: int = 60_000) -> DataFrame:
    """The items on a streaming DataFrame (stream_id, seq, chunk, done), as they become known.

    A row of kind "over" closes each stream with its verdict.  The query needs the
    state store ``STATE_STORE`` and append mode.
    """
    kept = {"outputMode": "append", "timeMode": "ProcessingTime"}
    events = chunks.select("stream_id", "seq", "chunk", F.coalesce("done", F.lit(False)).alias("done")).groupBy("stream_id").transformWithStateInPandas(_Reassemble(idle_ms), "stream_id long, event_seq long, event string, complete boolean, over boolean", **kept)
    frames = _parsed(events, provider)
    items = frames.groupBy("stream_id").transformWithStateInPandas(_Wait(cap), f"{_ITEM}, event string, data string", **kept)
    rows = _decided(items, policies, provider, facts)
    findings = next(f.dataType.simpleString() for f in rows.schema if f.name == "findings")
    return rows.groupBy("stream_id").transformWithStateInPandas(_Gate(), f"{_ITEM}, findings {findings}, verdict string, rule_id string, sent boolean, output string", **kept)


def totals(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row for each stream (chunks with ts): counts of frames, flushes and bytes, findings, verdict and times.

    Frames are those that were parsed and sent; first_byte_ms counts from a
    column ``asked_at`` where the chunks have one.
    """
    acted = (F.col("verdict") != "allow") & (F.col("sent") | F.col("output").isNotNull())
    text = F.col("kind") == "text"
    of_items = items.where("kind <> 'over'").groupBy("stream_id").agg(
        F.count("output").alias("frames_emitted"),
        F.coalesce(F.sum(F.octet_length("output")), F.lit(0)).cast("long").alias("bytes_emitted"),
        *(F.count_if(text & (F.col("reason") == r)).alias(f"flushes_{r}") for r in ("boundary", "cap", "end")),
        F.coalesce(F.max_by(F.when(acted, F.col("verdict")), F.when(acted, F.struct("at", "part"))), F.lit("allow")).alias("verdict"),
        F.max_by(F.when(acted, F.col("rule_id")), F.when(acted, F.struct("at", "part"))).alias("rule_id"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.when((F.size("findings") > 0) & (F.col("sent") | F.col("output").isNotNull()), F.struct("at", "part", "findings")))), lambda x: x["findings"])).alias("findings"),
    )
    first = F.min("ts")
    asked = F.min("asked_at") if "asked_at" in chunks.columns else first
    of_chunks = chunks.groupBy("stream_id").agg(
        F.count("*").alias("chunks_received"),
        F.coalesce(F.sum(F.octet_length("chunk")), F.lit(0)).cast("long").alias("bytes_received"),
        (F.unix_millis(first) - F.unix_millis(asked)).alias("first_byte_ms"),
        (F.unix_millis(F.max("ts")) - F.unix_millis(asked)).alias("stream_duration_ms"),
    )
    none = F.array().cast(next(f.dataType for f in items.schema if f.name == "findings"))
    counts = ("frames_emitted", "bytes_emitted", "flushes_boundary", "flushes_cap", "flushes_end")
    joined = of_chunks.join(of_items, "stream_id", "left")
    return joined.withColumns({**{c: F.coalesce(c, F.lit(0).cast("long")) for c in counts}, "verdict": F.coalesce("verdict", F.lit("allow")), "findings": F.coalesce("findings", none)})
