"""Spelling variants: words one edit apart, met by merging light subtrees of their trie into heavy ones.

The words' trie is a table of edges (node, next letter, words below).  At each
node the edge with the most words below is heavy.  A word leaves heavy paths at
most log2(words) times, and only there is it moved, small to large: the subtree
of a light edge is merged into its node's with that edge's letter skipped,
replaced by the heavy one, or preceded by it.  A moved word that ends where a
word ends is one edit from it.  Light edges of one node meet each other with
their letters left out; such a group has a word for each letter at most.  Each
pair shares one longest prefix, so it is found once.

Words are counted in tasks and summed, so frequent words are a row for each
task.  Edges of the two upper levels go to all tasks (an alphabet's square at
most); deeper ones meet the words by a join on node and letter.

Texts' runs of letters are lower-cased in A-Z only; a run whose checksum with its
document id is divisible by ``TYPO`` loses one letter.  Null texts have no words,
a null doc_id counts as an empty string; repeated rows count again.  An empty
table gives no words.  Ties of n go to the smaller word.  Columns other than
doc_id and text, whatever their names, are left out.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm._bpe import _Slots
from palisade.llm._spark import cut, discard, prepare, table
from palisade.llm._text import CHUNK_BYTES, LOWER, buffers, hash_words

TYPO = 97
LEAST_LENGTH = 5
LEAST_COUNT = 3
RATIO = 2
#: Distinct words that a task counts before it gives their counts.
HELD = 1 << 18
#: Bytes of a run up to which checksums are computed for all runs at once.
_SHORT = 48

#: Bytes of [A-Za-zÀ-ÿ] once the bytes of other letters are blanked: ASCII letters, C3 and what follows it.
_RUN = np.zeros(256, bool)
_RUN[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3, *range(0x80, 0xC0)]] = True


def _crc_table() -> np.ndarray:
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = (x >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (x & np.uint32(1)))
    return x


_CRC = _crc_table()


def only_letters(data: np.ndarray) -> np.ndarray:
    """The bytes with those of characters beyond U+00FF, and of U+0080 to U+00BF, blanked."""
    tail = (data & 0xC0) == 0x80
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    return np.where(tail & ~after, np.uint8(0x20), data)


def checksums(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """The crc32 of each run of bytes, carried on from what its prefix gave."""
    order = np.argsort(-sizes, kind="stable")
    at, left = starts[order], sizes[order]
    state = ~begun[order].astype(np.uint32)
    n_long = int(np.searchsorted(-left, -_SHORT))
    active = len(order)
    for k in range(int(left[n_long]) if n_long < len(left) else 0):
        active = int(np.searchsorted(-left, -k))  # those longer than k come first
        now = state[n_long:active]
        state[n_long:active] = _CRC[(now ^ data[at[n_long:active] + k]) & np.uint32(0xFF)] ^ (now >> np.uint32(8))
    out = np.empty(len(order), np.uint32)
    out[order] = ~state
    for i in order[:n_long].tolist():
        out[i] = zlib.crc32(data[starts[i] : starts[i] + sizes[i]].tobytes(), int(begun[i]))
    return out


class _Counts:
    """Counts of words, met by 64-bit hashes of their bytes."""

    def __init__(self):
        self._new()

    def _new(self) -> None:
        self.slots, self.words, self.n, self.odd = _Slots(), [], np.zeros(1024, np.int64), Counter()

    def add(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, folded: bytes) -> None:
        keys, first, n = np.unique(hashes, return_index=True, return_counts=True)
        slot = self.slots.find(keys)
        new = slot < 0
        if new.any():
            self.slots.add(keys[new])
            at = first[new]
            self.words += [folded[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            slot[new] = self.slots.find(keys[new])
        if len(self.words) > len(self.n):
            self.n = np.concatenate([self.n, np.zeros(len(self.words), np.int64)])
        self.n[slot] += n

    def drain(self):
        words = self.words + [w.encode() for w in self.odd]
        n = np.concatenate([self.n[: len(self.words)], np.fromiter(self.odd.values(), np.int64, len(self.odd))])
        self._new()
        for a in range(0, len(words), 1 << 14):
            yield pa.RecordBatch.from_arrays([pa.array(words[a : a + (1 << 14)], pa.binary()).cast(pa.string()), pa.array(n[a : a + (1 << 14)])], names=["word", "n"])


def _pieces(data: np.ndarray, offsets: np.ndarray):
    """(bytes, offsets, first row) of about ``CHUNK_BYTES`` each, cut between runs; long rows are cut too."""
    i, n = 0, len(data)
    while i < n:
        j = min(i + CHUNK_BYTES, n)
        while j < n and _RUN[data[j]] and _RUN[data[j - 1]]:
            step = np.flatnonzero(~_RUN[data[j : j + 65536]])
            j = j + int(step[0]) if len(step) else min(j + 65536, n)
        low, high = int(np.searchsorted(offsets, i, side="right")) - 1, int(np.searchsorted(offsets, j, side="left"))
        yield data[i:j], np.clip(offsets[low : high + 1], i, j) - i, low
        i = j


def _count(typo: int, least: int):
    """A function over Arrow batches of doc_id and text: words of at least so many code points, and how often."""

    def run(batches):
        counts = _Counts()
        for batch in batches:
            begun = np.array([zlib.crc32(f"{'' if x is None else x}:".encode()) for x in batch.column(0).to_pylist()], np.uint32)
            data, offsets = buffers(batch.column(1))
            for piece, rows, low in _pieces(only_letters(data), offsets):
                starts, ends, hashes, first = hash_words(piece, rows, _RUN, LOWER)
                if not len(starts):
                    continue
                folded = LOWER[piece]
                heads = np.concatenate([[0], np.cumsum((piece & 0xC0) != 0x80)])
                length = heads[ends] - heads[starts]
                # Shorter ones are no words, with a letter less or not.
                on = np.flatnonzero(length >= least)
                row = np.searchsorted(first, on, side="right") - 1 + low
                starts, ends, hashes, length = starts[on], ends[on], hashes[on], length[on]
                crc = checksums(folded, starts, ends - starts, begun[row])
                typed = crc % np.uint32(typo) == 0
                raw = folded.tobytes()
                counts.add(hashes[~typed], starts[~typed], ends[~typed], raw)
                for a, b, h, n in zip(starts[typed].tolist(), ends[typed].tolist(), crc[typed].tolist(), length[typed].tolist(), strict=True):
                    if n > least:
                        word = raw[a:b].decode()
                        counts.odd[word[: h % n] + word[h % n + 1 :]] += 1
                if len(counts.words) + len(counts.odd) > HELD:
                    yield from counts.drain()
        yield from counts.drain()

    return run


def vocabulary(docs: DataFrame, typo: int = TYPO, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n of every word of the texts."""
    prepare(docs.sparkSession)
    counted = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string")).mapInArrow(_count(typo, least_length), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _steps(words: DataFrame, first: int = 0, last: int | None = None) -> DataFrame:
    """word, n, node and letter for the steps of each word through the trie; the last letter of each is empty."""
    end = F.length("word") if last is None else F.least(F.length("word"), F.lit(last))
    steps = words.where(F.length("word") >= first).select("word", "n", F.explode(F.sequence(F.lit(first), end)).alias("i"))
    return steps.select("word", "n", "i", F.substr("word", F.lit(1), F.col("i")).alias("node"), F.substr("word", F.col("i") + 1, F.lit(1)).alias("letter"))


def light_edges(words: DataFrame) -> DataFrame:
    """node, letter and heavy (the heavy letter at the node) of the trie's light edges; ends of words are such edges, with no letter."""
    edges = _steps(words).groupBy("node", "letter").agg(F.count("*").alias("below"))
    # The heaviest letter; the end of a word is never heavy.
    top = F.max(F.struct(F.when(F.col("letter") != "", F.col("below")).otherwise(0), F.col("letter")))
    heavy = edges.groupBy("node").agg(F.count("*").alias("edges"), top.alias("top")).where("edges > 1").select("node", F.col("top.letter").alias("heavy"))
    return edges.join(heavy, "node").where("letter <> heavy").select("node", "letter", "heavy")


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near and best (the negated n, and the word, of its best near word); words without near ones are absent.

    ``words`` has distinct words and their n.
    """
    light = cut(light_edges(words), "light")
    shallow, deep = light.where(F.length("node") < 2), light.where(F.length("node") >= 2)
    moved = _steps(words, 0, 1).join(F.broadcast(shallow), ["node", "letter"]).unionByName(_steps(words, 2).join(deep, ["node", "letter"]))
    moved = cut(moved.select("word", "n", "node", "letter", "heavy", F.substr("word", F.col("i") + 2).alias("rest")), "moved")

    node, letter, heavy, rest = (F.col(c) for c in ("node", "letter", "heavy", "rest"))
    replaced = F.when(letter != "", F.concat(node, heavy, rest))
    skipped = F.when((letter != "") & (F.substr(rest, F.lit(1), F.lit(1)) != letter), F.concat(node, rest))
    preceded = F.concat(node, heavy, letter, rest)
    ends = moved.select(F.explode(F.array_compact(F.array(replaced, skipped, preceded))).alias("other"), "word", "n")
    pairs = ends.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    both = F.array(F.struct("word", (-F.col("other_n")).alias("minus_n"), F.col("other").alias("near")), F.struct(F.col("other").alias("word"), (-F.col("n")).alias("minus_n"), F.col("word").alias("near")))
    found = pairs.select(F.explode(both).alias("x")).select("x.word", F.lit(1).alias("n_near"), F.struct("x.minus_n", "x.near").alias("best"))

    # Light edges of one node: as many words as letters at most.
    member = F.struct((-F.col("n")).alias("minus_n"), F.col("word").alias("near"))
    groups = moved.where("letter <> ''").groupBy("node", "rest").agg(F.sort_array(F.collect_list(member)).alias("of")).where("size(of) > 1")
    alike = groups.select("of", F.posexplode("of")).select(F.col("col.near").alias("word"), (F.size("of") - 1).alias("n_near"), F.when(F.col("pos") == 0, F.col("of")[1]).otherwise(F.col("of")[0]).alias("best"))
    return found.unionByName(alike).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root for rows of word and form; a form's n is at least twice its word's, so jumps double at most six times."""
    now = cut(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(7):
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        further = cut(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        discard(now)
        now = further
        if not now.where("moved").count():
            return now.select("word", "root")
    raise ValueError("forms run in a circle")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word; ``words`` has distinct words and their n."""
    prepare(words.sparkSession)
    words = cut(words.select("word", F.col("n").cast("long")), "words")
    best = -F.col("best.minus_n")
    known = words.join(near_words(words), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(best >= ratio * F.col("n"), F.col("best.near")).alias("form"), F.when(best >= ratio * F.col("n"), best).alias("form_n"))
    known = cut(known, "variants")
    to = roots(known.where("form is not null"))
    return known.join(to, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The same words and pairs from plain patterns: one code point left out, or one left open.
SQL = rf"""
WITH RECURSIVE
bits(i, k, v) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT i, k + 1, xor(v >> 1, 3988292384 * (v & 1)) FROM bits WHERE k < 8),
crc_table AS (SELECT i, v FROM bits WHERE k = 8),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) GROUP BY 1, 2),
numbered AS (SELECT row_number() OVER () AS id, doc_id || ':' || run AS whole, run, n FROM runs),
letters AS (SELECT id, whole, unnest(range(length(whole))) AS i FROM numbered),
bytes AS (
  SELECT id, row_number() OVER (PARTITION BY id ORDER BY i, part) AS k, byte
  FROM (SELECT id, i, unnest(CASE WHEN c < 128 THEN [0] ELSE [0, 1] END) AS part, unnest(CASE WHEN c < 128 THEN [c] ELSE [c >> 6 | 192, c & 63 | 128] END) AS byte FROM (SELECT id, i, unicode(substr(whole, i + 1, 1)) AS c FROM letters))),
crc(id, k, c) AS (
  SELECT id, CAST(0 AS BIGINT), 4294967295 FROM numbered
  UNION ALL
  SELECT crc.id, crc.k + 1, xor(c >> 8, v) FROM crc JOIN bytes b ON b.id = crc.id AND b.k = crc.k + 1 JOIN crc_table t ON t.i = xor(c & 255, byte)),
sums AS (SELECT id, max_by(xor(c, 4294967295), k) AS h FROM crc GROUP BY id),
typed AS (SELECT CASE WHEN h % {TYPO} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM numbered JOIN sums USING (id)),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM typed WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
places AS (SELECT word, n, unnest(range(length(word))) AS i FROM words),
less AS (SELECT DISTINCT word, n, substr(word, 1, i) || substr(word, i + 2) AS key FROM places),
open AS (SELECT word, n, i, substr(word, 1, i) || '*' || substr(word, i + 2) AS key FROM places),
pairs AS (
  SELECT l.word, w.word AS near, w.n AS near_n FROM less l JOIN words w ON w.word = l.key
  UNION ALL SELECT w.word, l.word, l.n FROM less l JOIN words w ON w.word = l.key
  UNION ALL SELECT a.word, b.word, b.n FROM open a JOIN open b ON a.key = b.key AND a.word <> b.word),
ranked AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS at_place FROM pairs),
known AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN near_n >= {RATIO} * w.n THEN near END AS form, CASE WHEN near_n >= {RATIO} * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND at_place = 1),
chain(word, root) AS (SELECT word, word FROM known UNION ALL SELECT c.word, k.form FROM chain c JOIN known k ON k.word = c.root WHERE k.form IS NOT NULL),
ends AS (SELECT c.word, c.root FROM chain c JOIN known k ON k.word = c.root WHERE k.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM known JOIN ends USING (word)
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(vocabulary(table(spark, sf_dir, "documents")))
