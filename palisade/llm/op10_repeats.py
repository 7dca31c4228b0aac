"""Substring dedup by level-wise doubling.

A window of ``length`` words that occurs twice contains shorter windows that
occur twice.  The search starts from windows of about a quarter of the length,
keeps those that repeat, doubles them, and so on up to the full length:

* Level 1 counts anchors only: the window of ``n1`` words with the least hash in
  each full window.  Equal full windows have equal anchors, so none is missed,
  while only about 2 in ``length - n1 + 2`` positions are counted.
* Level 2 doubles the surviving anchors to either side, within the document, and
  keeps the sides that repeat.  Its hashes only ever exclude, so 32 bits do.
* The last level hashes the full windows around what survived to 128 bits, counts
  them exactly, and marks the words that repeated windows cover.

Texts with equal word sequences form a class.  A class with several rows repeats
as a whole; one row of it stands for it in the search, so huge groups of copies
cost one text.  Counts are pre-aggregated before each shuffle.  They are joined
back by the window, so the occurrences of one that very many texts share stream
through one task's join (as narrow rows, none held); no group is collected.

Null and empty texts have no words.  Rows are judged by their text, whatever
their id; repeated rows are copies of each other, and null or repeated ids match
no other rows.  Texts shorter than a window are kept whole.  An empty table gives
an empty report.  Other columns, whatever their names, are left out of it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm._spark import cut, discard, prepare, release, table
from palisade.llm._text import NON_BLANK, buffers, chunks, hash_words, mix, signed, windows

LENGTH = 35

_BASE = "doc_id long, key binary, n_words long, k1 long, k2 long, kept_sha256 string, h array<long>, ext array<long>, pos array<int>"


def _key(h: np.ndarray) -> tuple[int, int]:
    """128 bits of a word sequence."""
    n = len(h)
    if not n:
        return 0, 0
    a, b = windows(h, n, 1), windows(h, n, 2)
    return int(signed(a)[0]), int(signed(b)[0])


def levels(length: int) -> tuple[int, int]:
    """Lengths of the first two levels; twice the second reaches the full length."""
    second = (length + 1) // 2
    return (second + 1) // 2, second


def anchor_positions(short: np.ndarray, span: int) -> np.ndarray:
    """Leftmost least position of every run of ``span`` hashes."""
    view = np.lib.stride_tricks.sliding_window_view(short, span)
    return np.unique(view.argmin(axis=1) + np.arange(len(view)))


def _side(long_: np.ndarray, at: np.ndarray) -> np.ndarray:
    """32 bits of the windows that begin at these positions; 0 where there is none."""
    ok = (at >= 0) & (at < len(long_))
    out = np.zeros(len(at), np.uint64)
    out[ok] = (mix(long_[at[ok]]) >> np.uint64(32)) | np.uint64(1)
    return out


def _documents(length: int):
    n1, n2 = levels(length)

    def run(batches):
        for batch in batches:
            data, off = buffers(batch.column(2))
            cols: list[list] = [[] for _ in range(7)]
            for i, j in chunks(off):
                part, cutoff = data[off[i] : off[j]], off[i : j + 1] - off[i]
                _, _, h, at = hash_words(part, cutoff, NON_BLANK)
                for r in range(j - i):
                    x = h[at[r] : at[r + 1]]
                    k1, k2 = _key(x)
                    kept = b" ".join(part[cutoff[r] : cutoff[r + 1]].tobytes().split())
                    if len(x) >= length:
                        short, double = windows(x, n1, 3), windows(x, n2, 4)
                        p = anchor_positions(short, length - n1 + 1)
                        ext = (_side(double, p) << np.uint64(32)) | _side(double, p - (n2 - n1))
                        row = signed(short[p]), signed(ext), p.astype(np.int32)
                    else:
                        row = [], [], []
                    for c, v in zip(cols, (len(x), k1, k2, hashlib.sha256(kept).hexdigest(), *row), strict=True):
                        c.append(v)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
            made = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["doc_id", "key", "n_words", "k1", "k2", "kept_sha256", "h", "ext", "pos"])

    return run


def _full_windows(length: int):
    """(text, spots, class) to the full windows around surviving anchors: (128 bits of hash, class, first word)."""
    n1, n2 = levels(length)

    def run(batches):
        for batch in batches:
            data, off = buffers(batch.column(0))
            spots, number = batch.column(1), batch.column(2).to_numpy()
            for i, j in chunks(off):
                _, _, h, at = hash_words(data[off[i] : off[j]], off[i : j + 1] - off[i], NON_BLANK)
                for r in range(j - i):
                    x = h[at[r] : at[r + 1]]
                    spot = np.asarray(spots[i + r].values, np.int64)
                    right, left = np.zeros(len(x), bool), np.zeros(len(x), bool)
                    right[spot[spot >= 0]] = True
                    left[-1 - spot[spot < 0]] = True
                    short = windows(x, n1, 3)
                    view = np.lib.stride_tricks.sliding_window_view(short, length - n1 + 1)
                    offset = view.argmin(axis=1)
                    p = offset + np.arange(len(view))
                    # A side counts where the window holds all of it.
                    ok = (right[p] | (offset > length - n2)) & (left[p] | (offset < n2 - n1)) & (right[p] | left[p])
                    first = np.flatnonzero(ok)
                    if len(first):
                        w, v = (pa.array(signed(windows(x, length, salt)[first])) for salt in (5, 6))
                        c = pa.array(np.full(len(first), number[i + r]))
                        yield pa.RecordBatch.from_arrays([w, v, c, pa.array(first.astype(np.int32))], names=["w", "v", "c", "first"])

    return run


def _removal(length: int):
    """(text, first words of repeated windows, class) to (class, words removed, kept text)."""

    def run(batches):
        for batch in batches:
            removed, texts = [], []
            for text, first in zip(batch.column(0), batch.column(1), strict=True):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                tokens = raw.split()
                step = np.zeros(len(tokens) + 1, np.int64)
                at = np.asarray(first.values, np.int64)
                np.add.at(step, at, 1)
                np.add.at(step, at + length, -1)
                gone = np.cumsum(step[:-1]) > 0
                removed.append(int(gone.sum()))
                texts.append(b" ".join([w for w, g in zip(tokens, gone.tolist(), strict=True) if not g]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], names=["c", "n_removed", "kept"])

    return run


def _repeated(rows: DataFrame, *by: str) -> DataFrame:
    """The rows whose key occurs more than once."""
    again = rows.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1").select(*by)
    return rows.join(again, [*by], "left_semi")


class _Search:
    """``rows`` with their class keys, ``classes`` (c, keys, copies, the MD5 of one of its texts), and ``hits`` (c, first)."""

    def __init__(self, docs: DataFrame, length: int):
        spark = prepare(docs.sparkSession)
        text = F.col("text").cast("string")
        source = docs.select(F.col("doc_id").cast("long"), F.unhex(F.md5(F.coalesce(text, F.lit("")))).alias("key"), text.alias("text"))
        base = cut(source.mapInArrow(_documents(length), _BASE), "words")
        wide = base.groupBy("k1", "k2").agg(
            F.count("*").alias("copies"),
            F.min("key").alias("key"),
            F.any_value("h").alias("h"),
            F.any_value("ext").alias("ext"),
            F.any_value("pos").alias("pos"),
        )
        # Numbers are unique and, once written, fixed.
        wide = cut(wide.withColumn("c", F.monotonically_increasing_id()), "classes")
        self.rows = cut(base.select("doc_id", "n_words", "k1", "k2", F.unhex("kept_sha256").alias("sha")), "rows")
        discard(base)
        release(spark)
        anchors = wide.select("c", F.explode(F.arrays_zip("h", "ext", "pos")).alias("a")).select("c", "a.h", "a.ext", "a.pos")
        right = F.struct(F.shiftrightunsigned("ext", 32).alias("side"), F.col("pos").alias("spot"))
        left = F.struct((F.col("ext").bitwiseAND(0xFFFFFFFF) + F.lit(1 << 33)).alias("side"), (-1 - F.col("pos")).alias("spot"))
        sides = _repeated(anchors, "h").select("c", "h", F.explode(F.array(right, left)).alias("s")).select("c", F.xxhash64("h", "s.side").alias("double"), "s.spot")
        self.spots = cut(_repeated(sides, "double").groupBy("c").agg(F.collect_list("spot").alias("spots")), "spots")
        self.classes = cut(wide.select("c", "k1", "k2", "copies", "key"), "classes")
        discard(wide)
        release(spark)
        # Texts are met by their MD5, each once; both joins with them use the exchange of this aggregate.
        self.texts = source.groupBy("key").agg(F.any_value("text").alias("text"))
        # The words of one text at most are gathered here.
        full = self.held(self.spots).select("text", "spots", "c").mapInArrow(_full_windows(length), "w long, v long, c long, first int")
        self.hits = _repeated(full, "w", "v").select("c", "first")

    def held(self, of_class: DataFrame) -> DataFrame:
        """The text of each class in ``of_class``, beside its columns."""
        return self.texts.join(self.classes.select("c", "key").join(of_class, "c"), "key")


def find_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Repeated windows that lie in texts of their own: (k1, k2, first word), with k1 and k2 the class of a text."""
    found = _Search(docs, length)
    return found.hits.join(found.classes.select("c", "k1", "k2"), "c").select("k1", "k2", "first")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, where words went from a text without copies, the kept text."""
    found = _Search(docs, length)
    per_class = found.hits.groupBy("c").agg(F.collect_list("first").alias("first")).join(found.classes.where("copies = 1").select("c"), "c", "left_semi")
    shortened = cut(found.held(per_class).select("text", "first", "c").mapInArrow(_removal(length), "c long, n_removed long, kept string"), "shortened")
    discard(found.spots)
    rows = found.rows.join(found.classes.select("c", "k1", "k2", "copies"), ["k1", "k2"]).join(shortened, "c", "left")
    whole = (F.col("copies") > 1) & (F.col("n_words") >= length)
    return rows.select(
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce(F.sha2("kept", 256), F.lower(F.hex("sha")))).alias("kept_sha256"),
        F.when(whole, F.lit("")).otherwise(F.col("kept")).alias("kept_text"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


#: All windows by brute force.
SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id, text) AS r, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (SELECT r, i, array_to_string(w[i : i + 34], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
n AS (SELECT g FROM g GROUP BY g HAVING count(*) > 1),
c AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM g JOIN n USING (g)),
k AS (SELECT r, count(*) AS n FROM c GROUP BY r),
t AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS kept FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) u ANTI JOIN c USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r) LEFT JOIN t USING (r)
"""
