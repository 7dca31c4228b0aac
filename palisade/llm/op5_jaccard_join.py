"""Exact n-gram Jaccard join over count-vector R-trees.

A document's set holds its distinct word shingles.  Shingles are hashed into
groups; the counts of the groups are a point, and the points of documents that
can be similar are indexed in R-trees.  A tree is searched with the bound that
two sets share at most the sum of the minima of their coordinates; what survives
is verified on the shingles themselves.

Which documents meet in a tree is decided by the groups as well.  With
100 * intersection >= t * union, two sets of a and b shingles differ in at most
(100 - t) * (a + b) / (100 + t) of them.  So among the first that many plus one
groups that are not empty, one holds the same shingles in both.  A document
enters one cell for each of those groups, and two similar documents share a cell.

Equal sets form a class first, so exact copies cost one point.  Then:

1. The tree of each cell splits it into the parts that the bound connects.  Only
   the parts go on, as cells of their own; parts with the same members are one.
   (Cells beyond ``BLOCK`` members go on whole.)
2. Two rounds send each member, with its set, to one of its cells: the most
   crowded, then the next one.  There a task searches the tree, verifies pairs
   of different components at once and returns the edges of a spanning forest:
   fewer rows than members, however alike a group is.
3. A last search takes the cells that still hold several components and returns
   the pairs within the bound whose components differ; they are verified once.
   In a cell beyond ``BLOCK`` members its largest component is never dealt
   against itself.

So no pair is dropped and components are exact.  Nothing is gathered by key
without a bound: a block has at most about ``BLOCK`` members and
``BLOCK_SHINGLES`` shingles (or one document that has more by itself).

Null texts and texts without words have no set and link with nothing.  Fewer
than ``k`` words are one shingle.  Rows are judged by their text, whatever their
id; repeated rows are copies; null ids name no component and keep a null one
where no row of it has an id.  An empty table gives an empty table.  Other
columns, whatever their names, are left out of the report and kept by
``keep_one``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm._graph import components
from palisade.llm._rtree import CountTree
from palisade.llm._spark import cut, discard, fresh, lean, parts, plain_names, prepare, release, table
from palisade.llm._text import LOWER, NON_BLANK, buffers, chunks, hash_words, mix, signed, windows

SHINGLE = 4
PERCENT = 85
#: Most members of a cell that one tree holds, and most shingles of the sets sent to one.
BLOCK = 1024
BLOCK_SHINGLES = 4 << 20
#: Members up to which a cell is one leaf: all of its pairs meet the bound at once.
LEAF = 48
#: Entries of small cells that are handled together.
CHUNK = 8192
#: Coordinates that all points can be folded to.
COARSE = 64

_BASE = "doc_id long, key binary, n long, k1 long, k2 long, vec binary, cells array<long>"


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Distinct shingle hashes of a word sequence, sorted."""
    if not len(h):
        return np.zeros(0, np.uint64)
    return np.unique(windows(h, min(k, len(h)), 7))


def _dims(n: int) -> int:
    """Coordinates of a set's point: a power of two, a shingle or less each."""
    return max(COARSE, 1 << n.bit_length())


def count_vector(s: np.ndarray) -> bytes:
    counts = np.bincount((s & np.uint64(_dims(len(s)) - 1)).astype(np.int64), minlength=_dims(len(s)))
    # An entry beyond a byte leaves the set without a point: nothing prunes it.
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


@cache
def _groups(top: int, percent: int) -> int:
    """Groups for sets of fewer than ``top`` shingles: more are not empty than shingles can differ.

    Sets of that size differ in at most (100 - percent) / percent of it, and about
    x * (1 - exp(-1 / x)) of it are groups with a shingle where x of it are groups.
    Where that leaves something to chance, in small sets and where nearly all or
    more than all may differ, every shingle is a group: 0.
    """
    need = 1.22 * (100 - percent) / percent
    if top <= 64 or need >= 0.98:
        return 0
    if percent == PERCENT:
        return int(top / 4.6)
    low, high = 0.01, 32.0
    for _ in range(40):
        x = (low + high) / 2
        low, high = (x, high) if x * -math.expm1(-1 / x) < need else (low, x)
    return math.ceil(top * high)


def cells(s: np.ndarray, percent: int) -> np.ndarray:
    """Keys of the first groups of a set, enough to meet every similar set."""
    n = len(s)
    most = (100 - percent) * (n + 100 * n // percent) // (100 + percent) + 1
    out = []
    band = n.bit_length()
    # Its own band and those of all the larger sets that it can be similar to.
    for b in range(band, (100 * n // percent).bit_length() + 1):
        top = 1 << b
        g = mix(s ^ np.uint64(b))
        if groups := _groups(top, percent):
            g %= np.uint64(groups)
        order = np.argsort(g, kind="stable")
        g, x = g[order], mix(s[order] + np.uint64(b))
        first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        with np.errstate(over="ignore"):
            content = np.add.reduceat(x, first)
            out.append(mix(content ^ mix(g[first] + (np.uint64(b) << np.uint64(40))))[:most])
    return np.concatenate(out)


def _sets_of(texts: pa.Array, k: int):
    """The set of each text in turn."""
    data, off = buffers(texts)
    for i, j in chunks(off):
        _, _, h, at = hash_words(data[off[i] : off[j]], off[i : j + 1] - off[i], NON_BLANK, LOWER)
        for r in range(j - i):
            yield shingles(h[at[r] : at[r + 1]], k)


def _documents(k: int, percent: int):
    """(doc_id, key, text) to _BASE."""
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
    names = ["doc_id", "key", "n", "k1", "k2", "vec", "cells"]

    def run(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in types]
            for s in _sets_of(batch.column(2), k):
                n = len(s)
                if n:
                    a, b = windows(s, n, 1), windows(s, n, 2)
                    row = n, int(signed(a)[0]), int(signed(b)[0]), count_vector(s), signed(cells(s, percent))
                else:
                    row = 0, 0, 0, b"", []
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            made = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=names)

    return run


def _sets(k: int):
    """(c, text) to (c, set)."""

    def run(batches):
        for batch in batches:
            sets = [s.tobytes() for s in _sets_of(batch.column(1), k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["c", "set"])

    return run


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    same = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * same >= percent * (len(x) + len(y) - same)


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                keep.append(_similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keep, pa.bool_())], names=["a", "b", "linked"])

    return run


def _folded(v: bytes, dims: int) -> np.ndarray:
    """Counts of ``dims`` groups in as wide a type as they need; above all counts for a set without a point."""
    x = np.frombuffer(v, np.uint8)
    if not len(x):
        return np.full(dims, np.iinfo(np.uint32).max, np.uint32)
    if len(x) == dims:
        return x
    sums = x.reshape(-1, dims).sum(axis=0, dtype=np.int64)
    return sums.astype(np.min_scalar_type(sums.max()))


def _points(vecs: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """Points of a cell with as many coordinates as its smallest set has."""
    dims = _dims(int(sizes.min()))
    return np.stack([_folded(v, dims) for v in vecs])


def _connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that each of n nodes is connected to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def _bound_pairs(starts: np.ndarray, counts: np.ndarray, sizes: np.ndarray, vecs: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs within the bound of cells that are one leaf each."""
    left, right = [], []
    for m in np.unique(counts).tolist():
        i, j = np.triu_indices(m, 1)
        at = starts[counts == m]
        left.append((at[:, None] + i).ravel())
        right.append((at[:, None] + j).ravel())
    a, b = np.concatenate(left), np.concatenate(right)
    fits = 100 * np.minimum(sizes[a], sizes[b]) >= percent * np.maximum(sizes[a], sizes[b])
    a, b = a[fits], b[fits]
    coarse = np.stack([_folded(v, COARSE) for v in vecs])
    ok = np.zeros(len(a), bool)
    for x in range(0, len(a), 1 << 16):
        u, v = a[x : x + (1 << 16)], b[x : x + (1 << 16)]
        overlap = np.minimum(coarse[u], coarse[v]).sum(axis=1, dtype=np.int64)
        ok[x : x + (1 << 16)] = (100 + percent) * overlap >= percent * (sizes[u] + sizes[v])
    a, b = a[ok], b[ok]
    ok = np.ones(len(a), bool)
    for x, (u, v) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        dims = _dims(int(min(sizes[u], sizes[v])))
        if dims > COARSE:
            overlap = int(np.minimum(_folded(vecs[u], dims), _folded(vecs[v], dims)).sum(dtype=np.int64))
            ok[x] = (100 + percent) * overlap >= percent * int(sizes[u] + sizes[v])
    return a[ok], b[ok]


def _split(percent: int):
    """Sorted (cell, c, n, vec) to (cell, part, c, n, vec): the parts of cells that the bound connects."""

    def parts_of(cell: np.ndarray, c: np.ndarray, n: np.ndarray, vecs: list[bytes]):
        starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        counts = np.diff(np.append(starts, len(cell)))
        part = np.arange(len(cell))
        small = (counts > 1) & (counts <= LEAF)
        if small.any():
            a, b = _bound_pairs(starts[small], counts[small], n, vecs, percent)
            part = _connected(len(cell), a, b)
        for at, m in zip(starts[counts > LEAF].tolist(), counts[counts > LEAF].tolist(), strict=True):
            sizes = n[at : at + m]
            points = _points(vecs[at : at + m], sizes)
            tree = CountTree(points, sizes, percent)
            seen = np.zeros(m, bool)
            for i in range(m):
                if seen[i]:
                    continue
                seen[i] = True
                todo = [i]
                while todo:
                    x = todo.pop()
                    part[at + x] = at + i
                    hit = tree.search(points[x], int(sizes[x]))
                    hit = hit[~seen[hit]]
                    seen[hit] = True
                    todo += hit.tolist()
        kept = np.flatnonzero(np.bincount(part, minlength=len(part))[part] > 1)
        if len(kept):
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell[kept]), pa.array(c[part[kept]]), pa.array(c[kept]), pa.array(n[kept]), pa.array([vecs[i] for i in kept.tolist()], pa.binary())],
                names=["cell", "part", "c", "n", "vec"],
            )

    def run(batches):
        held: list[list] = [[], [], [], []]
        for batch in batches:
            for have, col in zip(held, batch.columns, strict=True):
                have += col.to_pylist()
            if len(held[0]) >= CHUNK:
                cell = np.array(held[0])
                cut_at = int(np.searchsorted(cell != cell[-1], False)) if cell[0] == cell[-1] else int(np.flatnonzero(cell != cell[-1])[-1]) + 1
                if cut_at:
                    yield from parts_of(cell[:cut_at], np.array(held[1][:cut_at]), np.array(held[2][:cut_at]), held[3][:cut_at])
                    held = [x[cut_at:] for x in held]
        if held[0]:
            yield from parts_of(np.array(held[0]), np.array(held[1]), np.array(held[2]), held[3])

    return run


def _groups_of(batches, keys: int):
    """Rows of sorted batches, group by group of their first ``keys`` columns."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != key:
                if len(rows) > 1:
                    yield rows
                rows, key = [], row[:keys]
            rows.append(row)
    if len(rows) > 1:
        yield rows


def _edges(batches, found) -> Iterator[pa.RecordBatch]:
    """The pairs of a generator as batches of bounded size."""
    a, b = [], []
    for x, y in found(batches):
        a.append(x)
        b.append(y)
        if len(a) >= 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            a, b = [], []
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _forest(percent: int):
    """Sorted (cell, block, c, label, set) to verified pairs that join components: fewer than members."""

    def found(batches):
        for rows in _groups_of(batches, 2):
            _, root = np.unique([r[3] for r in rows], return_inverse=True)
            if not root.any():
                continue
            sets = [np.frombuffer(r[4], np.uint64) for r in rows]
            sizes = np.array([len(s) for s in sets])
            points = _points([count_vector(s) for s in sets], sizes)
            tree = CountTree(points, sizes, percent)
            for i in range(len(rows)):
                hit = tree.search(points[i], int(sizes[i]))
                hit = hit[root[hit] != root[i]]
                while len(hit):
                    j = int(hit[0])
                    if _similar(sets[i], sets[j], percent):
                        root[root == root[j]] = root[i]
                        yield rows[i][2], rows[j][2]
                    hit = hit[1:]
                    hit = hit[root[hit] != root[i]]

    return lambda batches: _edges(batches, found)


def _candidates(percent: int):
    """Sorted (cell, i, j, cross, side, c, label, n, vec) to the pairs within the bound whose labels differ.

    With ``cross`` only pairs of different sides count.
    """

    def found(batches):
        for rows in _groups_of(batches, 3):
            label = np.array([r[6] for r in rows])
            if (label == label[0]).all():
                continue
            side, cross = np.array([r[4] for r in rows]), rows[0][3]
            sizes = np.array([r[7] for r in rows], np.int64)
            points = _points([r[8] for r in rows], sizes)
            tree = CountTree(points, sizes, percent)
            for i in range(len(rows)):
                if cross and side[i]:
                    continue
                hit = tree.search(points[i], int(sizes[i]))
                hit = hit[(label[hit] != label[i]) & ((side[hit] == 1) if cross else (hit > i))]
                for j in hit.tolist():
                    yield rows[i][5], rows[j][5]

    return lambda batches: _edges(batches, found)


class _Join:
    """One join: classes of equal sets, the cells they share, and their labels.

    ``drop`` deletes the tables that nothing still to run reads.
    """

    def __init__(self, docs: DataFrame, k: int, percent: int):
        self.spark = prepare(docs.sparkSession)
        self.k, self.percent = k, percent
        text = F.col("text").cast("string")
        self.source = docs.select(F.col("doc_id").cast("long"), F.unhex(F.md5(F.coalesce(text, F.lit("")))).alias("key"), text.alias("text"))
        base = cut(self.source.mapInArrow(lean(_documents(k, percent)), _BASE), "sets")
        wide = base.where("n > 0").groupBy("k1", "k2").agg(
            F.min("doc_id").alias("rep"),
            F.min("key").alias("key"),
            F.any_value("n").alias("n"),
            F.any_value("vec").alias("vec"),
            F.any_value("cells").alias("cells"),
        )
        # Numbers are unique and, once written, fixed.
        wide = cut(wide.withColumn("c", F.monotonically_increasing_id()), "classes")
        self.rows = cut(base.select("doc_id", "key", "n", "k1", "k2"), "rows")
        discard(base)
        release(self.spark)
        entries = wide.select("c", F.explode("cells").alias("cell"))
        shared = entries.groupBy("cell").agg(F.count("*").alias("m")).where("m > 1").select("cell")
        met = cut(entries.join(shared, "cell", "left_semi"), "met")
        self.classes = cut(wide.select("c", "k1", "k2", "rep", "key", "n", "vec"), "classes")
        discard(wide)
        release(self.spark)
        self.met = self._parts(met)
        self.links: list[DataFrame] = []
        self.labels: DataFrame | None = None

    @staticmethod
    def _alike(met: DataFrame, *by: str) -> DataFrame:
        """Of groups with the same members one, with their number m and their shingles."""
        seen = met.groupBy(*by).agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("c")).alias("x"), F.bit_xor(F.xxhash64("c", F.lit(1))).alias("y"))
        return seen.groupBy("m", "x", "y").agg(F.min(F.struct(*by)).alias("one")).select(*(F.col(f"one.{b}").alias(b) for b in by), "m")

    def _parts(self, met: DataFrame) -> DataFrame:
        """(cell, m, c): the cells after the first search."""
        small = cut(met.join(self._alike(met, "cell"), "cell"), "met")
        discard(met)
        points = small.where(F.col("m") <= BLOCK).join(self.classes.select("c", "n", "vec"), "c").select("cell", "c", "n", "vec")
        found = points.repartition(parts(self.spark), "cell").sortWithinPartitions("cell").mapInArrow(lean(_split(self.percent)), "cell long, part long, c long, n long, vec binary")
        split = cut(found.select(F.xxhash64("cell", "part").alias("cell"), "c"), "parts")
        all_ = split.unionByName(small.where(F.col("m") > BLOCK).select("cell", "c"))
        out = cut(all_.join(self._alike(all_, "cell"), "cell"), "cells")
        discard(split)
        discard(small)
        release(self.spark)
        return out

    def _open(self) -> DataFrame:
        """(cell, m, c, label) of the cells that hold several components."""
        if self.labels is None:
            return self.met.withColumn("label", F.col("c"))
        m = self.met.join(self.labels.withColumnRenamed("node", "c"), "c", "left").select("cell", "m", "c", F.coalesce("component", "c").alias("label"))
        several = m.groupBy("cell").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("cell")
        return m.join(several, "cell", "left_semi")

    def _add(self, links: DataFrame) -> None:
        self.links.append(links)
        if self.labels is not None:
            discard(self.labels)
        self.labels = components(reduce(DataFrame.unionByName, self.links))
        release(self.spark)

    def _members(self) -> DataFrame:
        """(c, set) of all classes that share a cell; texts are met by their MD5, each once."""
        reps = self.classes.join(self.met.select("c").distinct(), "c", "left_semi").select("c", "key")
        texts = self.source.groupBy("key").agg(F.any_value("text").alias("text"))
        return cut(texts.join(reps, "key").select("c", "text").mapInArrow(lean(_sets(self.k)), "c long, set binary"), "members")

    def link_in_cells(self, turn: int) -> None:
        """Each member meets the others of one of its cells: the next most crowded in each turn."""
        each = self._open().groupBy("c").agg(F.sort_array(F.collect_list(F.struct("m", "cell")), asc=False).alias("s"), F.any_value("label").alias("label"))
        picked = cut(each.select("c", "label", F.expr(f"s[{turn} % size(s)].cell").alias("cell")), "picked")
        size = picked.join(self.classes.select("c", "n"), "c").groupBy("cell").agg(F.count("*").alias("m"), F.sum("n").alias("w")).where("m > 1")
        blocks = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("w") / BLOCK_SHINGLES))
        block = F.pmod(F.xxhash64("c", F.lit(turn)), F.col("blocks")).cast("int")
        dealt = picked.join(size.select("cell", blocks.alias("blocks")), "cell").select("cell", block.alias("block"), "c", "label").join(self.sets, "c")
        dealt = dealt.select("cell", "block", "c", "label", "set").repartition(parts(self.spark), "cell", "block").sortWithinPartitions("cell", "block")
        links = cut(dealt.mapInArrow(lean(_forest(self.percent)), "a long, b long"), "links")
        discard(picked)
        self._add(links)

    def link_the_rest(self) -> None:
        """The pairs that no turn has met."""
        open_ = cut(self._open(), "open")
        major = open_.where(F.col("m") > BLOCK).groupBy("cell", "label").agg(F.count("*").alias("count"))
        major = major.groupBy("cell").agg(F.max(F.struct("count", "label")).alias("x")).select("cell", "x.*")
        whole = open_.where(F.col("m") <= BLOCK).select("cell", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(False).alias("cross"), F.lit(0).alias("side"), "c", "label")
        large = open_.join(major.withColumnRenamed("label", "most"), "cell")
        of_most = F.col("label") == F.col("most")
        many, few = F.ceil(F.col("count") / BLOCK).cast("int"), F.ceil((F.col("m") - F.col("count")) / BLOCK).cast("int")
        own = F.pmod(F.xxhash64("c"), F.when(of_most, many).otherwise(few)).cast("int")
        large = large.select("cell", "c", "label", of_most.alias("of_most"), many.alias("many"), few.alias("few"), own.alias("own"))
        dealt = large.withColumn(
            "to",
            F.expr("""
                case when of_most then transform(sequence(0, few - 1), x -> named_struct('i', own, 'j', x, 'cross', true, 'side', 0))
                else concat(
                    transform(sequence(0, many - 1), x -> named_struct('i', x, 'j', own, 'cross', true, 'side', 1)),
                    transform(sequence(0, few - 1), x -> named_struct('i', -1 - least(x, own), 'j', greatest(x, own), 'cross', x <> own, 'side', if(own > x, 1, 0))))
                end"""),
        )
        dealt = dealt.select("cell", F.explode("to").alias("to"), "c", "label").select("cell", "to.*", "c", "label")
        met = whole.unionByName(dealt).join(self.classes.select("c", "n", "vec"), "c").select("cell", "i", "j", "cross", "side", "c", "label", "n", "vec")
        met = met.repartition(parts(self.spark), "cell", "i", "j").sortWithinPartitions("cell", "i", "j")
        pairs = met.mapInArrow(lean(_candidates(self.percent)), "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = cut(pairs.distinct(), "pairs")
        discard(open_)
        one = pairs.join(self.sets.select(F.col("c").alias("b"), F.col("set").alias("y")), "b")
        both = one.join(self.sets.select(F.col("c").alias("a"), F.col("set").alias("x")), "a").select("a", "b", "x", "y")
        links = cut(both.mapInArrow(lean(_verify(self.percent)), "a long, b long, linked boolean").where("linked").select("a", "b"), "links")
        discard(pairs)
        self._add(links)

    def run(self) -> DataFrame:
        """Every row: doc_id, key, n and the number of its component (null without a set)."""
        self.sets = self._members()
        for turn in range(2):
            self.link_in_cells(turn)
        self.link_the_rest()
        for t in (self.sets, self.met, *self.links):
            discard(t)
        named = self.classes.join(self.labels.withColumnRenamed("node", "c"), "c", "left").select("k1", "k2", F.coalesce("component", "c").alias("component"))
        out = cut(self.rows.join(named, ["k1", "k2"], "left").select("doc_id", "key", "n", "component"), "linked")
        for t in (self.rows, self.classes, self.labels):
            discard(t)
        release(self.spark)
        return out


def link_components(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs``."""
    rows = _Join(docs, k, percent).run()
    least = rows.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "component", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


@plain_names
def keep_one(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of each component, unchanged: the one with the least id, then the least MD5 of its text.

    Null ids come last.  Rows without a set stay, all of them; of rows that repeat
    both id and text one stays.
    """
    rows = _Join(docs, k, percent).run()
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    firsts = rows.where("component is not null").groupBy("component").agg(F.min(order).alias("first"))
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key") == F.col("first")
    judged = rows.join(firsts, "component", "left").groupBy("doc_id", "key").agg(F.count("*").alias("n"), F.bool_and(F.coalesce(first, F.lit(True))).alias("stays"), F.max("component").alias("component"))
    names = fresh(docs, "id", "key", "mine")
    judged = cut(judged.select(F.col("doc_id").alias(names[0]), F.col("key").alias(names[1]), "n", "stays", "component"), "judged")
    held = docs.withColumn(names[2], F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))))
    here = held["doc_id"].cast("long").eqNullSafe(F.col(names[0])) & (held[names[2]] == F.col(names[1]))
    kept = held.join(judged.where("not stays").select(*names[:2]), here, "left_anti")
    twice = judged.where("stays and n > 1 and component is not null").select(*names[:2])
    if twice.isEmpty():
        return kept.select(*docs.columns)
    again = kept.join(twice, here, "left_semi").dropDuplicates(["doc_id", names[2]])
    return kept.join(twice, here, "left_anti").unionByName(again).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(table(spark, sf_dir, "documents"))


#: All pairs that share a shingle, by brute force, and their transitive closure.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r(doc_id, q) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.q)
SELECT r.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(q) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
