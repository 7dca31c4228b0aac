"""The prefix trie of conversations: a Cartesian tree over the LCP array of sorted conversations.

A conversation is a row of 16-byte turn keys (MD5 of role and text), so texts
are read once and never shuffled.  Conversations are sorted by their keys in
ranges, ties by id, so copies are neighbours and may span ranges.  A task cuts
its range into blocks of at most ``BLOCK`` rows and scans each with a stack: the
length of the prefix that a conversation shares with the one before closes all
runs that are deeper, equal lengths fall to one run, and a run stands for all the
depths between its ends.  What is closed inside a block is final.

Only paths of the first and of the last conversation of a block can go on beyond
it.  Their depths are pieces.  A block's minimum is the least prefix length in it
and at its border; the piece of depth d began in the nearest earlier block whose
minimum is below d.  One row of numbers for each block, so a bounded table, goes
to all tasks; pieces are then summed by the block and depth in which they began.

Sums over an interval of conversations give every column, saved tokens too: the
words of all members less those of the distinct nodes.  Ids of equal
conversations are hashed in order as they stream by, block by block.

Null roles and texts are empty, null turns come first, turns of equal number go
by their keys, so repeated turns stay and their order is fixed.  Rows without
conv_id belong to no conversation.  An empty table has no conversations, hence no
root.  Other columns, whatever their names, are left out.  One conversation is
one row of 20 bytes a turn; nothing else has to fit together.
"""

from __future__ import annotations

import hashlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.llm._spark import cut, empty_sha, parts, prepare, table

GROUP = 20
HEADS = 4
#: Conversations of one block; bounds what a task holds.
BLOCK = 1 << 16
_KEY = 16
_WORD = r"[^\x20\x09-\x0D]+"

_NODE, _PIECE, _BLOCK = 0, 1, 2
_FIRST, _LAST, _BOTH = 0, 1, 2
#: What a scan gives: nodes, pieces of nodes, and a summary of each block.
_SCAN = [
    ("kind", pa.int32(), "int"),
    ("block", pa.int64(), "long"),
    ("conv_id", pa.int64(), "long"),
    ("depth", pa.int64(), "long"),
    ("parent_conv_id", pa.int64(), "long"),
    ("n_convs", pa.int64(), "long"),
    ("n_children", pa.int64(), "long"),
    ("n_leaves", pa.int64(), "long"),
    ("saved_tokens", pa.int64(), "long"),  # of a piece: the words of its members
    ("ends", pa.string(), "string"),  # the hash of a node, the ids of a piece
    ("side", pa.int32(), "int"),  # of a piece, or of the piece that is a node's parent
    ("distinct_words", pa.int64(), "long"),
    ("before", pa.int64(), "long"),  # words above a piece
    ("first_key", pa.binary(), "binary"),
    ("last_key", pa.binary(), "binary"),
    ("least", pa.int64(), "long"),
    ("first_words", pa.list_(pa.int64()), "array<long>"),
]


def sequences(convs: DataFrame) -> DataFrame:
    """conv_id, key (16 bytes a turn) and words (of each turn) of every conversation, in the order of its turns."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn = F.struct(
        F.col("turn").isNotNull().alias("known"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        F.md5(F.concat_ws(":", F.length(role), F.concat(role, text)).cast("binary")).alias("key"),
        F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words"),
    )
    c = F.col("conv_id").cast("long")
    turns = convs.where("conv_id is not null").select(c.alias("conv_id"), (c - c % GROUP).alias("base"), turn.alias("turn"))
    # One exchange: conversations that share a base are dealt together.
    return turns.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """conv_id, key and words of the conversations, each begun with turns of the first one of its group."""
    base = F.first(F.when(F.col("conv_id") == F.col("base"), F.slice("turns", 1, HEADS - 1)), ignorenulls=True).over(Window.partitionBy("base"))
    with_base = sequences(convs).select("conv_id", "turns", base.alias("head")).withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int"))
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    turns = with_base.select("conv_id", F.when(F.col("head").isNull(), own).otherwise(F.concat(F.slice("head", F.lit(1), F.col("h")), own)).alias("turns"))
    return turns.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["key"]), "")).alias("key"), F.transform("turns", lambda t: t["words"]).alias("words"))


def shared(a: bytes, b: bytes) -> int:
    """The number of turns that both begin with."""
    n = min(len(a), len(b)) // _KEY
    if a[: n * _KEY] == b[: n * _KEY]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low * _KEY : mid * _KEY] == b[low * _KEY : mid * _KEY]:
            low = mid
        else:
            high = mid
    return low


class _Run:
    """Nodes of depths low + 1 to high with the same members, from conversation ``start`` of the block on."""

    __slots__ = ("first", "low", "high", "length", "upto", "n", "least", "leaves", "words", "distinct", "forks", "ends", "waiting")

    def __init__(self, first: bool, low: int, conv_id: int, upto: list[int]):
        self.first, self.low, self.high, self.length, self.upto = first, low, len(upto) - 1, len(upto) - 1, upto
        self.n, self.least, self.leaves, self.words, self.distinct, self.forks = 1, conv_id, 0, upto[-1], 0, 0
        self.ends, self.waiting = [conv_id], []

    def above(self, depth: int) -> int:
        """Words of the turns before this depth."""
        return self.upto[max(depth - 1, 0)]

    def children(self, depth: int) -> int:
        return 1 if depth < self.high else self.forks + (self.high < self.length)


class _Block:
    """The stack of one block; ``rows`` collects what it gives."""

    def __init__(self, number: int, rows: list[list]):
        self.number, self.rows = number, rows
        self.stack: list[_Run] = []
        self.n = 0
        self.last = b""

    def add(self, conv_id: int, key: bytes, words: list[int]) -> None:
        upto = [0, *accumulate(words)]
        if not self.n:
            self.first_key, self.first_words = key, upto
            self.stack.append(_Run(True, -1, conv_id, upto))
        else:
            lcp = shared(self.last, key)
            stack = self.stack
            stack[-1].leaves += lcp < len(self.last) // _KEY
            while stack[-1].low >= lcp:
                run = stack.pop()
                self._emit(run, run.least, None)
                self._merge(run)
                stack[-1].waiting.append(self._kept(run))
            top = stack[-1]
            if lcp < top.high:
                self._split(top, lcp)
            if len(upto) - 1 > lcp:
                top.forks += 1
                stack.append(_Run(False, lcp, conv_id, upto))
            else:  # a copy of the one before
                top.n += 1
                top.least = min(top.least, conv_id)
                top.words += upto[-1]
                top.ends.append(conv_id)
        self.n += 1
        self.last = key

    def _merge(self, run: _Run) -> None:
        into = self.stack[-1]
        into.n += run.n
        into.least = min(into.least, run.least)
        into.leaves += run.leaves
        into.words += run.words
        into.distinct += run.distinct + run.upto[-1] - run.upto[run.low]

    def _split(self, top: _Run, lcp: int) -> None:
        """Close what of the run is deeper than the prefix."""
        low, top.low = top.low, lcp
        if top.first:
            self._pieces(top, _FIRST)
            kept = []
        else:
            self._emit(top, top.least, None)
            kept = [self._kept(top)]
        top.low, top.high, top.forks, top.ends, top.waiting = low, lcp, 0, [], kept

    @staticmethod
    def _kept(run: _Run) -> tuple:
        sha = hashlib.sha256(",".join(map(str, run.ends)).encode()).hexdigest() if run.ends else None
        saved = [run.words - run.distinct - run.upto[-1] - (run.n - 1) * run.above(d) for d in range(run.low + 1, run.high + 1)]
        return run.low, run.high, run.least, run.n, run.children(run.high), run.leaves, saved, sha

    def _emit(self, run: _Run, parent: int | None, side: int | None) -> None:
        """Give the nodes of runs that waited for this one, their parent."""
        for low, high, least, n, children, leaves, saved, sha in run.waiting:
            for d in range(low + 1, high + 1):
                end = d == high
                top = d == low + 1
                self.rows.append([_NODE, self.number, least, d, parent if top else least, n, children if end else 1, leaves, saved[d - low - 1], sha if end else None, side if top else None, *[None] * 6])
        run.waiting = []

    def _pieces(self, run: _Run, side: int) -> None:
        self._emit(run, None, side)
        for d in range(run.low + 1, run.high + 1):
            # What the first conversation adds depends on the block before.
            distinct = run.distinct + (0 if run.first else run.upto[-1] - run.above(d))
            children = run.children(d) if not run.first else run.forks if d == run.high else 0
            ends = ",".join(map(str, run.ends)) if d == run.high and run.ends else None
            self.rows.append([_PIECE, self.number, run.least, d, None, run.n, children, run.leaves, run.words, ends, side, distinct, run.above(d), *[None] * 4])

    def end(self) -> None:
        least = self.stack[0].high
        while self.stack:
            run = self.stack.pop()
            self._pieces(run, _BOTH if run.first else _LAST)
            if self.stack:
                self._merge(run)
        self.rows.append([_BLOCK, self.number, *[None] * 11, self.first_key, self.last, least, self.first_words])


def _scan(batches):
    """Nodes, pieces and block summaries of conversations that come sorted by key and id."""
    from pyspark import TaskContext

    number, rows, block = TaskContext.get().partitionId() << 32, [], None

    def out():
        columns = [pa.array(c, t) for c, (_, t, _) in zip(zip(*rows, strict=True), _SCAN, strict=True)]
        rows.clear()
        return pa.RecordBatch.from_arrays(columns, names=[n for n, _, _ in _SCAN])

    for batch in batches:
        for conv_id, key, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            block = block or _Block(number, rows)
            block.add(conv_id, key, words)
            if block.n == BLOCK:
                block.end()
                number, block = number + 1, None
            if len(rows) >= 1 << 14:
                yield out()
    if block:
        block.end()
    if rows:
        yield out()


class _Borders:
    """Of every block: the prefix shared with the block before, and where what goes on in it began."""

    def __init__(self, rows: list):
        rows = sorted(rows)
        self.at = {r["block"]: i for i, r in enumerate(rows)}
        self.least, self.shared, self.shared_words, self.first_words, self.first_length, last_length = (np.array([r[c] for r in rows], np.int64) for c in ("least", "shared", "shared_words", "first_words", "first_length", "last_length"))
        self.leaf = np.append(self.shared[1:] < last_length[:-1], True).astype(np.int64)
        low = np.minimum(self.least, self.shared)
        self.low = low.tolist()
        # The nearest earlier block with a smaller minimum.
        self.smaller, stack = [], []
        for i, x in enumerate(self.low):
            while stack and self.low[stack[-1]] >= x:
                stack.pop()
            self.smaller.append(stack[-1] if stack else -1)
            stack.append(i)

    def began(self, i: int, side: int, depth: int) -> tuple[int, int]:
        """(block, whether it is closed in it at both ends) in which the node of this depth began."""
        if side == _LAST or depth > self.shared[i]:
            return i, int(side == _FIRST)
        i -= 1
        while self.low[i] >= depth:
            i = self.smaller[i]
        return i, 0


def _border_rows(batches):
    for batch in batches:
        out = []
        for block, before, first, last, least, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n = -1 if before is None else shared(before, first)
            out.append((block, least, n, words[max(n, 0)], words[-1], len(first) // _KEY, len(last) // _KEY))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["block", "least", "shared", "shared_words", "first_words", "first_length", "last_length"])


def _joiner(borders: _Borders):
    """A function over pieces: their nodes' keys, their parents' keys, and what the borders add."""
    names = ["block", "side", "depth", "start", "closed", "up_start", "up_closed", "conv_id", "n_convs", "n_children", "n_leaves", "words", "distinct_words", "before", "ends"]

    def run(batches):
        for batch in batches:
            out = []
            for block, side, d, conv_id, n, children, leaves, words, distinct, before, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                i = borders.at[block]
                start, closed = borders.began(i, side, d)
                up = borders.began(i, side if d - 1 > borders.least[i] else _BOTH, d - 1) if d else (None, None)
                if side != _LAST:
                    opened = d <= borders.shared[i]
                    distinct += int(borders.first_words[i]) - (int(borders.shared_words[i]) if opened else before)
                    children += int(borders.first_length[i] > d >= borders.shared[i])
                if side != _FIRST:
                    leaves += int(borders.leaf[i])
                out.append((block, side, d, start, closed, *up, conv_id, n, children, leaves, words, distinct, before, ends))
            kinds = [pa.int64()] * (len(names) - 1) + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return run, ", ".join(f"{n} {'string' if n == 'ends' else 'long'}" for n in names)


def _hashes(batches):
    """The hash of each node's ids, which come in order in parts."""
    key, state = None, None
    for batch in batches:
        out = []
        for *at, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != key:
                if key:
                    out.append((*key, state.hexdigest()))
                key, state = at, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if out:
            yield _hash_batch(out)
    if key:
        yield _hash_batch([(*key, state.hexdigest())])


def _hash_batch(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 3 + [pa.string()], strict=True)], names=["start", "closed", "depth", "ends"])


def trie(sequences: DataFrame) -> DataFrame:
    """The nodes of the trie over conv_id, key and words, as ``rebuilt`` gives them."""
    spark = prepare(sequences.sparkSession)
    ordered = sequences.select("conv_id", "key", "words").repartitionByRange(parts(spark), "key", "conv_id").sortWithinPartitions("key", "conv_id")
    scanned = cut(ordered.mapInArrow(_scan, ", ".join(f"{n} {t}" for n, _, t in _SCAN)), "trie")

    summary = scanned.where(F.col("kind") == _BLOCK)
    before = summary.select("block", F.lag("last_key").over(Window.orderBy("block")).alias("prior"), "first_key", "last_key", "least", "first_words")
    borders = _Borders(before.mapInArrow(_border_rows, "block long, least long, shared long, shared_words long, first_words long, first_length long, last_length long").collect())

    run, schema = _joiner(borders)
    pieces = scanned.where(F.col("kind") == _PIECE).select("block", "side", "depth", "conv_id", "n_convs", "n_children", "n_leaves", F.col("saved_tokens").alias("words"), "distinct_words", "before", "ends")
    pieces = cut(pieces.mapInArrow(run, schema), "pieces")
    at = ["start", "closed", "depth"]
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "words", "distinct_words")]
    whole = pieces.groupBy(*at).agg(F.min("conv_id").alias("conv_id"), *sums, F.min("before").alias("before"), F.min("up_start").alias("up_start"), F.min("up_closed").alias("up_closed"))
    whole = cut(whole.withColumn("saved_tokens", F.col("words") - F.col("n_convs") * F.col("before") - F.col("distinct_words")), "whole")
    # The parts of one node come in the order of their blocks; long lists of ids stream through.
    parts_of = pieces.where("ends is not null").select(*at, "block", "ends").repartition(*at).sortWithinPartitions(*at, "block").select(*at, "ends")
    ends = parts_of.mapInArrow(_hashes, "start long, closed long, depth long, ends string")

    least = whole.select(*at, F.col("conv_id").alias("parent_conv_id"))
    above = least.select(F.col("start").alias("up_start"), F.col("closed").alias("up_closed"), (F.col("depth") + 1).alias("depth"), "parent_conv_id")
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    spanning = whole.join(above, ["up_start", "up_closed", "depth"], "left").join(ends, at, "left").select(*out)
    nodes = scanned.where(F.col("kind") == _NODE)
    below = pieces.join(least, at).select("block", "side", (F.col("depth") + 1).alias("depth"), "parent_conv_id")
    under = nodes.where("side is not null").drop("parent_conv_id").withColumn("side", F.col("side").cast("long")).join(below, ["block", "side", "depth"]).select(*out)
    every = nodes.where("side is null").select(*out).unionByName(under).unionByName(spanning)
    return every.withColumn("ends", F.coalesce("ends", F.lit(empty_sha()))).withColumnRenamed("ends", "ends_sha256")


#: The same nodes from plain prefixes: a turn is the MD5 of its role and text, a node the string of its turns.
SQL = rf"""
WITH RECURSIVE
bits(i, k, v) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT i, k + 1, xor(v >> 1, 3988292384 * (v & 1)) FROM bits WHERE k < 8),
crc_table AS (SELECT i, v FROM bits WHERE k = 8),
ids AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
crc(conv_id, k, c) AS (
  SELECT conv_id, 0, 4294967295 FROM ids
  UNION ALL
  SELECT conv_id, k + 1, xor(c >> 8, v) FROM crc JOIN crc_table ON i = xor(c & 255, ascii(substr(CAST(conv_id AS VARCHAR), k + 1, 1))) WHERE k < length(CAST(conv_id AS VARCHAR))),
heads AS (SELECT conv_id, conv_id - conv_id % {GROUP} AS base, xor(c, 4294967295) % {HEADS} AS h FROM crc WHERE k = length(CAST(conv_id AS VARCHAR))),
keyed AS (
  SELECT conv_id, turn, md5(concat_ws(':', length(coalesce(role, '')), coalesce(role, '') || coalesce(text, ''))) AS key, length(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
turns AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) AS pos FROM keyed),
again AS (
  SELECT h.conv_id, 0 AS part, t.pos, t.key, t.words FROM heads h JOIN turns t ON t.conv_id = h.base AND t.pos <= h.h
  UNION ALL
  SELECT h.conv_id, 1, t.pos, t.key, t.words FROM heads h JOIN turns t ON t.conv_id = h.conv_id AND t.pos > h.h),
whole AS (SELECT h.conv_id, coalesce(string_agg(key, '' ORDER BY part, pos), '') AS key, coalesce(list(words ORDER BY part, pos) FILTER (WHERE key IS NOT NULL), []) AS words FROM heads h LEFT JOIN again a ON a.conv_id = h.conv_id GROUP BY h.conv_id),
prefixes AS (SELECT conv_id, length(key) // 32 AS size, unnest(range(length(key) // 32 + 1)) AS depth, key, words FROM whole),
nodes AS (
  SELECT substr(key, 1, 32 * depth) AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(CASE WHEN depth = 0 THEN 0 ELSE words[depth] END) AS words,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE size = depth), '')) AS ends_sha256
  FROM prefixes GROUP BY 1, 2),
children AS (SELECT substr(node, 1, 32 * depth - 32) AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
counted AS (SELECT t.*, coalesce(c.n, 0) AS n_children FROM nodes t LEFT JOIN children c ON c.node = t.node),
up AS (SELECT substr(node, 1, 32 * k) AS node, n_convs, words, n_children FROM (SELECT *, unnest(range(depth + 1)) AS k FROM counted)),
sums AS (SELECT node, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens FROM up GROUP BY node)
SELECT t.conv_id, CAST(t.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, t.n_convs, t.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, t.ends_sha256
FROM counted t JOIN sums s ON s.node = t.node LEFT JOIN nodes p ON t.depth > 0 AND p.node = substr(t.node, 1, 32 * t.depth - 32)
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(table(spark, sf_dir, "conversations")))
