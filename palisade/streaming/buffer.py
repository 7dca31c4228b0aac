"""The word-boundary buffer, in batch and as a stateful stream operator.

Text is appended; the whole buffer is flushed when it reaches the cap, else when
what was just appended holds a space, newline, return or tab, and at the end.
Chunks without text change nothing.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

_BLANK = r"[ \n\r\t]"
_BLANKS = np.frombuffer(b" \n\r\t", np.uint8)
FLUSH = "stream_id long, flush_seq int, last_seq long, text string, reason string"
#: Values of seq that share a block, and about the most bytes of text that one row of it has.
_BLOCK = 512
_PIECE = 32 << 10


def flush_groups(chunks: DataFrame) -> DataFrame:
    """Flushes of each stream (stream_id, seq, chunk) where no buffer reaches a cap: plain windows and groups."""
    w = Window.partitionBy("stream_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    blank = F.col("chunk").rlike(_BLANK)
    rows = chunks.withColumn("flush_seq", F.coalesce(F.sum(blank.cast("int")).over(w), F.lit(0)).cast("int"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk"))), lambda x: x["chunk"]), "")
    return rows.groupBy("stream_id", "flush_seq").agg(joined.alias("text"), F.max("seq").alias("last_seq"), F.when(F.bool_or(blank), "boundary").otherwise("end").alias("reason"))


class Buffer:
    """The recurrence for one stream."""

    def __init__(self, cap: int, held: str = "", n: int = 0, last: int = -1):
        self.cap, self.held, self.n, self.last = cap, held, n, last

    def push(self, text: str, seq: int) -> tuple[int, int, str, str] | None:
        if not text:
            return None
        self.held, self.last = self.held + text, seq
        if len(self.held.encode()) >= self.cap:
            return self._flush("cap")
        if any(c in text for c in " \n\r\t"):
            return self._flush("boundary")
        return None

    def end(self) -> tuple[int, int, str, str] | None:
        return self._flush("end") if self.held else None

    @property
    def state(self) -> tuple[str, int, int]:
        return self.held, self.n, self.last

    def _flush(self, reason: str) -> tuple[int, int, str, str]:
        out = self.n, self.last, self.held, reason
        self.held, self.n = "", self.n + 1
        return out


def _pack(block: int):
    """(stream_id, seq, chunk, over) to pieces of blocks: neighbouring rows of one block as a row."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            seq, over = batch.column(1).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)
            raw = batch.column(2).cast(pa.binary())
            off = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1]
            ids = batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy()
            b = seq // block
            part = off[:-1].astype(np.int64) // _PIECE
            first = np.append(True, (ids[1:] != ids[:-1]) | (b[1:] != b[:-1]) | (part[1:] != part[:-1]))
            starts = np.flatnonzero(first)
            at = seq - b * block
            steps = np.where(first, at, at - np.roll(at, 1)).astype(np.int32)
            sizes = np.where(over, -1, np.diff(off)).astype(np.int32)
            bounds = np.append(starts, len(seq)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(x)) for x in (steps, sizes)]
            text = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.ascontiguousarray(off[bounds])), raw.buffers()[2]])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(starts)), pa.array(b[starts]), *lists, text], names=["stream_id", "_b", "steps", "sizes", "text"])

    return run


class _Block:
    """The chunks of a block in order: where each ends, which of them flush whatever is held, and the text."""

    def __init__(self, block: int, b: int, pieces: list[tuple[np.ndarray, np.ndarray, bytes]], cap: int):
        at = np.concatenate([np.cumsum(steps, dtype=np.int64) for steps, _, _ in pieces])
        sizes = np.concatenate([x for _, x, _ in pieces])
        self.text = b"".join(t for _, _, t in pieces)
        if (at[1:] < at[:-1]).any():
            to = np.cumsum(np.maximum(sizes, 0), dtype=np.int64)
            order = np.argsort(at, kind="stable")
            self.text = b"".join(self.text[to[i] - max(sizes[i], 0) : to[i]] for i in order.tolist())
            at, sizes = at[order], sizes[order]
        self.cap, self.seq, self.over = cap, at + b * block, sizes < 0
        size = np.maximum(sizes, 0)
        self.to = np.cumsum(size, dtype=np.int64)
        blanks = np.append(0, np.cumsum(np.isin(np.frombuffer(self.text, np.uint8), _BLANKS)))
        breaks = self.over | (blanks[self.to] > blanks[self.to - size])
        n = len(size)
        places = np.where(breaks, np.arange(n), n)
        self.breaks = np.minimum.accumulate(places[::-1])[::-1]
        # The chunk that ends the flush that begins with each; n where none does.
        reach = np.maximum(np.searchsorted(self.to, self.to - size + cap), np.arange(n))
        self.next = np.minimum(reach, self.breaks).tolist()
        said = np.flatnonzero(~self.over)
        self.last = int(self.seq[said[-1]]) if len(said) else None

    def first(self, held: int) -> int:
        """The chunk that ends the flush of what is held; the number of chunks where none does."""
        return int(min(np.searchsorted(self.to, self.cap - held), self.breaks[0]))

    def summary(self) -> tuple[list[int], list[int], list[int], bool, bytes]:
        """What comes out for any bytes held before: for each chunk that can end the first flush its end, the flushes after it and the bytes then held.

        Last, whether one of them does in any case, and as much text from the end as can be held.
        """
        n, stop = len(self.next), int(self.breaks[0])
        m = self.first(0)
        sure, m = m < n, min(m, n - 1)
        size, over = int(self.to[-1]), self.over

        def walk(i: int) -> tuple[int, int]:
            count = 0
            while i < n:
                k = self.next[i]
                if k == n:
                    return count, i
                count += not (k == i and over[i])
                i = k + 1
            return count, n

        after = {min(stop, n - 1) + 1: walk(min(stop, n - 1) + 1)}
        for i in range(min(stop, n - 1), 0, -1):
            k = self.next[i]
            count, rest = after[k + 1] if k < n else (0, i)
            after[i] = count + (k < n and not (k == i and bool(over[i]))), rest
        tails = [after[k + 1] for k in range(m + 1)]
        held = [size - (int(self.to[i - 1]) if i else 0) if i < n else 0 for _, i in tails]
        keep = max(held) if sure else size
        return self.to[: m + 1].tolist(), [c for c, _ in tails], held, sure, self.text[size - keep :]

    def flushes(self, held: bytes, n: int, last: int | None, final: bool) -> Iterator[tuple[int, int, bytes, str, int | None]]:
        """(flush_seq, last_seq, text, reason, ended_at) of the flushes that end here."""
        count, begin, k, i = len(self.next), 0, self.first(len(held)), 0
        seq, over, to, text = self.seq.tolist(), self.over.tolist(), self.to.tolist(), self.text
        while k < count or final:
            end = k < count
            said = held + text[begin : to[k]] if end else held + text[begin:]
            stop = k if end and not over[k] else k - 1
            if stop >= i:
                last = seq[stop]
            if said:
                reason = "cap" if len(said) >= self.cap else "end" if not end or over[k] else "boundary"
                yield n, last, said, reason, seq[k] if end and over[k] else None
                n += 1
            if not end:
                return
            held, begin, i = b"", to[k], k + 1
            k = self.next[i] if i < count else count


def _blocks(batches, block: int, cap: int):
    """(stream_id, b, further columns, block) from sorted pieces."""
    key, pieces = None, []
    for batch in batches:
        ids, bs, more = batch.column(0).to_pylist(), batch.column(1).to_pylist(), [c.to_pylist() for c in batch.columns[5:]]
        lists = [(batch.column(c).offsets.to_numpy(), batch.column(c).values.to_numpy()) for c in (2, 3)]
        texts = batch.column(4)
        for r, have in enumerate(zip(ids, bs, *more, strict=True)):
            if have != key:
                if pieces:
                    yield *key[:2], key[2:], _Block(block, key[1], pieces, cap)
                key, pieces = have, []
            # A block may go on in the next batch, whose memory is another.
            pieces.append((*(v[o[r] : o[r + 1]].copy() for o, v in lists), texts[r].as_py()))
    if pieces:
        yield *key[:2], key[2:], _Block(block, key[1], pieces, cap)


def _frames_of(rows: Iterator[tuple], schema: pa.Schema, most: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size."""
    while some := list(islice(rows, most)):
        columns = zip(*some, strict=True)
        made = [pa.array(c, pa.binary()).view(pa.string()) if f.type == pa.string() and f.name == "text" else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
        yield pa.RecordBatch.from_arrays(made, schema=schema)


def _carried(batches, cap: int) -> Iterator[tuple[object, int, bytes, int, int | None, bool]]:
    """Sorted summaries (stream_id, b, to, count, rest, sure, tail, last) to what each block of a stream of several begins with.

    (stream_id, b, held, flushes so far, seq of the last chunk held, whether it is the last block.)
    """
    stream, waits, several, held, n, last = None, None, False, b"", 0, None
    for batch in batches:
        for sid, b, to, count, rest, sure, tail, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if waits is None or sid != stream:
                if several:
                    yield *waits, True
                stream, several, held, n, last = sid, False, b"", 0, None
            else:
                yield *waits, False
                several = True
            waits = sid, b, held, n, last
            k = bisect_left(to, cap - len(held))
            if k == len(to) and not sure:
                held, last = held + tail, last if own is None else own
                continue
            k = min(k, len(to) - 1)
            n += (len(held) + to[k] > 0) + count[k]
            held, last = tail[len(tail) - rest[k] :], own
    if several:
        yield *waits, True


def flush_capped(chunks: DataFrame, cap: int, ends: Column | None = None, block: int = _BLOCK) -> DataFrame:
    """The same with a cap: (stream_id, flush_seq, last_seq, text, reason, ended_at).

    seq is a whole number, unique in its stream.  Rows for which ``ends`` holds
    have no text of their own and flush what is held; ended_at is the seq of such
    a row for the flush that it ends.

    ``block`` values of seq are a block.  Chunks travel once, packed by blocks.
    What a block leaves to the next depends only on the bytes held before it, so
    each says that for any number of them in a small row; these rows alone are
    followed in order by stream, and then every block is flushed by itself.
    """
    cap = max(cap, 1)
    sid = chunks.schema["stream_id"].dataType
    named = f"stream_id {sid.simpleString()}"
    over = F.coalesce(ends, F.lit(False)) if ends is not None else F.lit(False)
    rows = chunks.select("stream_id", F.col("seq").cast("long"), F.coalesce("chunk", F.lit("")).alias("chunk"), over.alias("over"))
    rows = rows.where("over or chunk <> ''").withColumn("chunk", F.when(F.col("over"), "").otherwise(F.col("chunk")))
    packed = rows.mapInArrow(_pack(block), f"{named}, _b long, steps array<int>, sizes array<int>, text binary").repartition("stream_id", "_b")
    own = to_arrow_type(sid)

    def summaries(batches):
        schema = pa.schema([("stream_id", own), ("_b", pa.int64()), ("to", pa.list_(pa.int64())), ("count", pa.list_(pa.int32())), ("rest", pa.list_(pa.int32())), ("sure", pa.bool_()), ("tail", pa.binary()), ("last", pa.int64())])
        yield from _frames_of(((s, b, *x.summary(), x.last) for s, b, _, x in _blocks(batches, block, cap)), schema, 1000)

    def carried(batches):
        schema = pa.schema([("stream_id", own), ("_b", pa.int64()), ("held", pa.binary()), ("n", pa.int32()), ("last", pa.int64()), ("final", pa.bool_())])
        yield from _frames_of(_carried(batches, cap), schema, 1000)

    def flushed(batches):
        schema = pa.schema([("stream_id", own), ("flush_seq", pa.int32()), ("last_seq", pa.int64()), ("text", pa.string()), ("reason", pa.string()), ("ended_at", pa.int64())])

        def found():
            for s, _, (held, n, last, final), x in _blocks(batches, block, cap):
                for row in x.flushes(held or b"", n or 0, last, final is not False):
                    yield s, *row

        yield from _frames_of(found(), schema)

    said = packed.sortWithinPartitions("stream_id", "_b").mapInArrow(summaries, f"{named}, _b long, to array<long>, count array<int>, rest array<int>, sure boolean, tail binary, last long")
    begins = said.repartition("stream_id").sortWithinPartitions("stream_id", "_b").mapInArrow(carried, f"{named}, _b long, held binary, n int, last long, final boolean")
    met = packed.join(begins, ["stream_id", "_b"], "left").select("stream_id", "_b", "steps", "sizes", "text", "held", "n", "last", "final")
    return met.sortWithinPartitions("stream_id", "_b").mapInArrow(flushed, f"{named}, flush_seq int, last_seq long, text string, reason string, ended_at long")


def flush_stream(chunks: DataFrame, cap: int) -> DataFrame:
    """The same on a streaming DataFrame (stream_id, seq, chunk, done); a row with ``done`` ends its stream."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buffer = Buffer(cap, *state.get) if state.exists else Buffer(cap)
        out, over = [], False
        for row in pd.concat(list(frames)).sort_values("seq").itertuples():
            if got := buffer.push(row.chunk or "", row.seq):
                out.append((key[0], *got))
            if row.done:
                over = True
                if got := buffer.end():
                    out.append((key[0], *got))
        if over:
            state.remove()
        else:
            state.update(buffer.state)
        yield pd.DataFrame(out, columns=["stream_id", "flush_seq", "last_seq", "text", "reason"])

    return chunks.groupBy("stream_id").applyInPandasWithState(step, FLUSH, "held string, n int, last long", "append", GroupStateTimeout.NoTimeout)


def usage_by_window(usages: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Cost by event-time window and model, with a watermark."""
    return usages.withWatermark("ts", late).groupBy(F.window("ts", width), "model").agg(F.count("*").alias("n"), F.sum("cost_usd").alias("cost_usd"))
