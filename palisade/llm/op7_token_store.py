"""Token ids on disk in patched frame-of-reference blocks.

A store is a folder of shards in ascending document order.  A shard is a run of
segments; a segment is one self-contained binary record of whole documents:

    "PFR1"  u32 documents  u32 ids  u32 blocks
    i64 document ids (with a bitmap of nulls before them)  u32 ids per document
    u32 byte offset of each block                (the block index)
    blocks: u32 minimum, u8 width, u16 ids, u16 exceptions,
            packed low bits, u16 exception places, u32 exception residuals

A block holds up to ``BLOCK`` ids less their minimum, packed at the bit width
that covers ``PERCENTILE`` of them; the others are stored whole in the exception
list.  All integers are little-endian.  The records are carried as the binary
column of a Parquet folder, so writes go through Spark's committer to whatever
store the path names, a lost executor's task is simply run again, and readers
need no local files.

Documents are ordered by id and, for repeated ids, by a hash of the text; null
ids come first.  Shards are ranges of that order, so neither many null nor many
repeated ids meet in one.  Null and empty texts hold the end id alone.  An empty table makes an
empty store.  Other columns, whatever their names, are not stored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.llm._spark import parts, prepare, shared_path, table

MODEL = "byte_bpe_50k.json"
BLOCK = 256
PERCENTILE = 0.9
SEGMENT_IDS = 1 << 17
END_ID = 0
_HEAD = struct.Struct("<4sIII")
_BLOCK = np.dtype([("min", "<u4"), ("width", "u1"), ("n", "<u2"), ("exc", "<u2")])


def pack_blocks(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> list[bytes]:
    """Each block of ids as bytes; blocks of one width are packed together."""
    n = len(ids) // block
    out = _packed(ids[: n * block].reshape(n, block).astype(np.uint32), percentile) if n else []
    if n * block < len(ids):
        out += _packed(ids[n * block :].reshape(1, -1).astype(np.uint32), percentile)
    return out


def _packed(x: np.ndarray, percentile: float) -> list[bytes]:
    """The rows of x as blocks."""
    size = x.shape[1]
    low = x.min(axis=1)
    rest = x - low[:, None]
    bound = np.partition(rest, k := min(size - 1, int(percentile * size)), axis=1)[:, k]
    width = np.frexp(bound.astype(np.float64))[1].astype(np.uint32)
    row, place = np.nonzero(rest.astype(np.uint64) >> width[:, None].astype(np.uint64))
    n_over = np.bincount(row, minlength=len(x))
    head = np.zeros(len(x), _BLOCK)
    head["min"], head["width"], head["n"], head["exc"] = low, width, size, n_over
    heads, places, wholes = head.tobytes(), place.astype("<u2").tobytes(), rest[row, place].astype("<u4").tobytes()
    bodies = [b""] * len(x)
    for w in np.unique(width[width > 0]).tolist():
        of = np.flatnonzero(width == w)
        bits = np.unpackbits(rest[of].astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, count=w, bitorder="little")
        packed = np.packbits(bits.reshape(len(of), -1), axis=1, bitorder="little")
        for i, body in zip(of.tolist(), packed, strict=True):
            bodies[i] = body.tobytes()
    ends = np.cumsum(n_over).tolist()
    each = _BLOCK.itemsize
    return [
        b"".join((heads[i * each : i * each + each], bodies[i], places[2 * (e - k) : 2 * e], wholes[4 * (e - k) : 4 * e]))
        for i, (k, e) in enumerate(zip(n_over.tolist(), ends, strict=True))
    ]


def unpack_blocks(raw: bytes, at: np.ndarray) -> np.ndarray:
    """The ids of the blocks that begin at these bytes, in turn."""
    heads = np.frombuffer(b"".join([raw[a : a + _BLOCK.itemsize] for a in at.tolist()]), _BLOCK)
    n, width, exc = heads["n"].astype(np.int64), heads["width"].astype(np.int64), heads["exc"].astype(np.int64)
    out = np.zeros(int(n.sum()), np.uint32)
    first = np.cumsum(n) - n
    body = at + _BLOCK.itemsize
    for size, w in sorted(set(zip(n.tolist(), width.tolist(), strict=True))):
        if not w:
            continue
        of = np.flatnonzero((n == size) & (width == w))
        length = (size * w + 7) // 8
        rows = np.frombuffer(b"".join([raw[a : a + length] for a in body[of].tolist()]), np.uint8).reshape(len(of), length)
        # Each value lies within the few bytes after the one that its first bit is in.
        bit = np.arange(size) * w
        deep = 4 if w <= 25 else 5
        kind = np.uint32 if deep == 4 else np.uint64
        rows = np.pad(rows, ((0, 0), (0, deep)))
        got = np.zeros((len(of), size), kind)
        for k in range(deep):
            got |= rows[:, (bit >> 3) + k].astype(kind) << kind(8 * k)
        got = (got >> (bit & 7).astype(kind)) & kind((1 << w) - 1)
        out[(first[of][:, None] + np.arange(size)).ravel()] = got.ravel()
    tail = body + (n * width + 7) // 8
    for f, a, k in zip(first[exc > 0].tolist(), tail[exc > 0].tolist(), exc[exc > 0].tolist(), strict=True):
        out[f + np.frombuffer(raw, "<u2", k, a).astype(np.int64)] = np.frombuffer(raw, "<u4", k, a + 2 * k)
    return out + np.repeat(heads["min"], n)


def pack_segment(doc_ids: list[int | None], sizes: list[int], ids: np.ndarray) -> bytes:
    blocks = pack_blocks(ids)
    index = np.cumsum([0, *map(len, blocks)])[:-1] if blocks else np.zeros(0)
    nulls = np.packbits(np.array([x is None for x in doc_ids], np.uint8), bitorder="little").tobytes()
    return b"".join([_HEAD.pack(b"PFR1", len(doc_ids), len(ids), len(blocks)), nulls, np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.array(sizes, "<u4").tobytes(), index.astype("<u4").tobytes(), *blocks])


class Segment:
    """Random access to a packed segment through its block index."""

    def __init__(self, raw: bytes):
        self.raw = raw
        magic, docs, self.n, blocks = _HEAD.unpack_from(raw)
        if magic != b"PFR1":
            raise ValueError("not a segment")
        at = _HEAD.size
        nulls = np.unpackbits(np.frombuffer(raw, np.uint8, (docs + 7) // 8, at), count=docs, bitorder="little")
        at += (docs + 7) // 8
        self.doc_ids = [None if z else x for x, z in zip(np.frombuffer(raw, "<i8", docs, at).tolist(), nulls.tolist(), strict=True)]
        at += 8 * docs
        self.sizes = np.frombuffer(raw, "<u4", docs, at).astype(np.int64)
        at += 4 * docs
        self.index = np.frombuffer(raw, "<u4", blocks, at).astype(np.int64)
        self.body = at + 4 * blocks

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        stop = self.n if stop is None else min(stop, self.n)
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK, (stop - 1) // BLOCK
        got = unpack_blocks(self.raw, self.body + self.index[first : last + 1])
        return got[start - first * BLOCK : stop - first * BLOCK]


def write_store(docs: DataFrame, path: str, model_path: str | None = None, shards: int | None = None) -> None:
    """Encode every document, end id appended, and write the store to ``path``."""
    spark = prepare(docs.sparkSession)
    model = model_path or public_tokenizers.path(MODEL)
    fields = [("shard", pa.int32()), ("segment", pa.int32()), ("start_in_shard", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())]

    def run(batches):
        from pyspark import TaskContext

        from palisade.llm._bpe import Encoder

        encoder, shard = Encoder.of(model), TaskContext.get().partitionId()
        segment = start = held = 0
        doc_ids, sizes, ids = [], [], []

        def flush():
            nonlocal segment, start, held
            raw = pack_segment(doc_ids, sizes, np.concatenate(ids))
            row = pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip((shard, segment, start, held, raw), fields, strict=True)], names=[f for f, _ in fields])
            segment, start, held = segment + 1, start + held, 0
            for x in (doc_ids, sizes, ids):
                x.clear()
            return row

        end = np.array([END_ID], np.uint32)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for key, (_, got) in zip(keys, encoder.encode(pc.fill_null(batch.column(1), "").to_pylist()), strict=True):
                doc_ids.append(key)
                sizes.append(len(got) + 1)
                ids += [got, end]
                held += len(got) + 1
                if held >= SEGMENT_IDS:
                    yield flush()
        if doc_ids:
            yield flush()

    # Narrow keys, since a sample of them goes to the driver; the last one parts even rows that are alike.
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    keyed = source.select("*", F.xxhash64("text").alias("hash"), F.spark_partition_id().alias("part"))
    ordered = keyed.repartitionByRange(shards or parts(spark), "doc_id", "hash", "part").sortWithinPartitions("doc_id", "hash", "part")
    ordered.mapInArrow(run, "shard int, segment int, start_in_shard long, n_ids long, payload binary").write.parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids before it in the whole store), n_tokens and ids, as read from the files."""
    stored = spark.read.parquet(path)
    # One row for each shard, so their number is that of the writing tasks.
    shards = stored.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = shards.select("shard", before.alias("base"))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                seg = Segment(row["payload"])
                ends = np.cumsum(seg.sizes)
                starts = ends - seg.sizes
                ids = seg.ids()
                little = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(little[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(seg.doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["shard"]] * n, pa.int32()),
                        pa.array(seg.doc_ids, pa.int64()),
                        pa.array(starts + row["start_in_shard"], pa.int64()),
                        pa.array(seg.sizes, pa.int64()),
                        pa.array(crc, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(np.append(starts, len(ids)), pa.int32()), pa.array(ids.astype(np.int32))),
                    ],
                    names=["shard", "doc_id", "local", "n_tokens", "ids_crc32", "ids"],
                )

    read = stored.select("shard", "start_in_shard", "payload").mapInArrow(run, "shard int, doc_id long, local long, n_tokens long, ids_crc32 long, ids array<int>")
    return read.join(F.broadcast(bases), "shard").select("doc_id", (F.col("local") + F.col("base")).alias("start"), "n_tokens", "ids_crc32", "ids")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    write_store(table(spark, sf_dir, "documents"), path)
    return read_store(spark, path).drop("ids")
