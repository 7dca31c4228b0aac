"""Best-fit packing of documents into token sequences, in bounded space.

Documents become narrow rows: the lengths and checksums of their pieces.  The
rows are dealt out to shares of about ``SHARE_ROWS``, and each task packs its
share online: of the open sequences the one with the least free space that still
takes the piece gets it.
Open sequences are keyed by their free space in a bitset, so the best fit is the
lowest bit set at or above the length.  At most ``OPEN`` are open at once; to
open one more, the fullest closes first.  Pieces arrive in windows of ``WINDOW``
rows, the longest of a window first, which keeps large pieces from coming last.

Sequences still open when a share ends are pieces of the next level, ``FAN``
shares to one, until one share is left; so nothing grows with the input but the
rows dealt out, and the number of sequences hardly depends on that of the tasks.

Only documents beyond the capacity are cut: into whole sequences, of which the
first piece may be shorter.  Null and empty texts are the end id alone; a null
document id stays null.  Repeated rows and ids are documents of their own.  An
empty table gives no pieces.  Columns other than doc_id and text, whatever their
names, are left out.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm._spark import cut, prepare, table

MODEL = "byte_bpe_50k.json"
CAPACITY = 2048
END_ID = 0
#: Open sequences of one task.
OPEN = 4096
#: Pieces that arrive together, the longest first.
WINDOW = 4096
#: Shares whose open sequences meet in one share of the next level.
FAN = 8
#: Pieces of one share: the fewer there are, the worse they fit.
SHARE_ROWS = 1 << 16
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


class OpenBins:
    """Open sequences by free space: a bitset of the sizes there are, and a stack of each size."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.sizes = self.n_open = self.n_bins = 0
        self.of: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        stack = self.of[free]
        got = stack.pop()
        if not stack:
            self.sizes ^= 1 << free
        self.n_open -= 1
        return got

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) for a piece; a full sequence closes."""
        fitting = self.sizes >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            got = self._take(free)
        else:
            free, got = self.capacity, self.n_bins
            self.n_bins += 1
            if self.n_open == self.most and length < self.capacity:
                self._take((self.sizes & -self.sizes).bit_length() - 1)
        offset, free = self.capacity - free, free - length
        if free:
            if not self.of[free]:
                self.sizes |= 1 << free
            self.of[free].append(got)
            self.n_open += 1
        return got, offset

    def left(self) -> list[tuple[int, int]]:
        """(sequence, ids in it) of all that are open."""
        return [(b, self.capacity - free) for free, stack in enumerate(self.of) for b in stack]


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first), *((a, capacity) for a in range(first, n, capacity))]


def pieces(docs: DataFrame, capacity: int = CAPACITY, model_path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every document, end id included."""
    prepare(docs.sparkSession)
    model = model_path or public_tokenizers.path(MODEL)
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches):
        from palisade.llm._bpe import Encoder

        encoder, end = Encoder.of(model), END_ID.to_bytes(4, "little")
        for batch in batches:
            rows = []
            texts = pc.fill_null(batch.column(1), "").to_pylist()
            for key, (n, ids) in zip(batch.column(0).to_pylist(), encoder.encode(texts), strict=True):
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B") if n else b""
                for i, (a, size) in enumerate(cuts(n + 1, capacity)):
                    last = a + size > n
                    crc = zlib.crc32(raw[4 * a : 4 * (a + size - last)])
                    rows.append((key, i, a, size, zlib.crc32(end, crc) if last else crc))
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECE)


def _packer(level: int, capacity: int, most: int, window: int, last: bool):
    """A function over Arrow batches: their rows with bin and offset, and then a row of bin and used for each bin left open.

    The batches' last column holds lengths.  With ``last`` no bins are reported.
    """

    def run(batches):
        from pyspark import TaskContext

        bins = OpenBins(capacity, most)
        base = (level << 58) | (TaskContext.get().partitionId() << 32)

        def pack(rows):
            length = rows.column(rows.num_columns - 1).combine_chunks().to_numpy()
            got = np.zeros((len(length), 2), np.int64)
            for i in np.argsort(-length, kind="stable").tolist():
                got[i] = bins.place(int(length[i]))
            columns = [*rows.columns, pa.array(got[:, 0] + base), pa.array(got[:, 1]), pa.nulls(len(length), pa.int64())]
            return pa.Table.from_arrays(columns, names=[*rows.column_names, "bin", "offset", "used"]).combine_chunks().to_batches()

        held, n, schema = [], 0, None
        for batch in batches:
            schema = batch.schema
            held.append(batch)
            n += batch.num_rows
            if n >= window:
                rows = pa.Table.from_batches(held)
                for a in range(0, n - n % window, window):
                    yield from pack(rows.slice(a, window))
                held, n = rows.slice(n - n % window).to_batches(), n % window
        if n:
            yield from pack(pa.Table.from_batches(held))
        left = [] if last else bins.left()
        if left:
            number, used = (np.array(x, np.int64) for x in zip(*left, strict=True))
            blank = [pa.nulls(len(left), f.type) for f in schema]
            yield pa.RecordBatch.from_arrays([*blank, pa.array(number + base), pa.nulls(len(left), pa.int64()), pa.array(used)], names=[*schema.names, "bin", "offset", "used"])

    return run


def pack(rows: DataFrame, capacity: int = CAPACITY, most: int = OPEN, window: int = WINDOW, shares: int | None = None) -> DataFrame:
    """The pieces with sequence_id and offset; ``rows`` are as ``pieces`` gives them.

    Rows are dealt out by a hash and come in a fixed order, so a task that is
    run again packs alike.
    """
    prepare(rows.sparkSession)
    order = ["doc_id", "piece", "start", "ids_crc32", "length"]
    rows = cut(rows.select(*order), "pieces")  # counted, then dealt out; the texts are encoded once
    n = shares or max(1, -(-rows.count() // SHARE_ROWS))
    dealt = rows.withColumn("at", F.xxhash64(*order)).repartition(n, "at").sortWithinPartitions("at", *order).select(*order)
    packed = cut(dealt.mapInArrow(_packer(0, capacity, most, window, n == 1), "doc_id long, piece int, start long, ids_crc32 long, length long, bin long, offset long, used long"), "packed")
    out = packed.where("bin is not null and length is not null").drop("used").withColumnRenamed("bin", "sequence_id")
    level, left = 0, packed.where("length is null").select("bin", F.col("used").alias("length"))
    while n > 1:
        n, level = -(-n // FAN), level + 1
        dealt = left.withColumnRenamed("bin", "part").repartition(n, F.xxhash64("part")).sortWithinPartitions(F.col("length").desc(), "part")
        moved = cut(dealt.mapInArrow(_packer(level, capacity, most, window, n == 1), "part long, length long, bin long, offset long, used long"), "moved")
        to = moved.where("part is not null").select(F.col("part").alias("sequence_id"), F.col("bin").alias("to"), F.col("offset").alias("by"))
        out = out.join(to, "sequence_id", "left").select(*order, F.coalesce("to", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("by", F.lit(0))).alias("offset"))
        left = moved.where("part is null").select("bin", F.col("used").alias("length"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents")))
