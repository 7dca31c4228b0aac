"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of the test items form one automaton.  Training tokens
stream through it; the state gives, at each token, the longest run of tokens
ending there that is also a run of some item.  Where that length reaches the
window, the last ``window`` tokens are hit.  An item shorter than the window is
one window of its own length.

Items are taken in blocks of at most ``BLOCK_WORDS`` words (or one item that has
more), so what is sent to the executors is bounded whatever the size of the
benchmark.  Each further block is a further pass over the documents: a row
carries what the blocks before have found in it, so no rows are matched up, and
only one block is with the executors at a time.

Null or empty texts have no words and are never contaminated.  Items with no
words are ignored.  Items that repeat a text keep their own ids; an id counts
once a document.  Rows with null or repeated ids have a result each.  An empty
table gives an empty one, and an empty benchmark hits nothing.  Further columns
of the documents, whatever their names, are left out of the report and kept by
``clean`` and ``remove_spans``.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm._spark import cut, discard, fresh, lean, plain_names, prepare, table
from palisade.llm._text import ALNUM

WINDOW = 13
#: Most item words in one automaton (under 200 bytes a word with the executors).
BLOCK_WORDS = 250_000

_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if ALNUM[b] else 0x20 for b in range(256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_FOLD).split() if text else []


class SuffixAutomaton:
    """Of all items together, in flat arrays; full windows know the items that they occur in."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.items: list[str] = []
        self._next: list[dict[int, int]] = [{}]
        self._link, self._length = [0], [0]
        #: Items shorter than a window, by the state that they end in.
        self.ends: dict[int, list[tuple[int, int]]] = {}
        held_by, held = array("i"), array("i")
        for item_id, tokens in items:
            if not tokens:
                continue
            number, last = len(self.items), 0
            self.items.append(str(item_id))
            for w in tokens:
                last = self._extend(last, self.vocab.setdefault(w, len(self.vocab)))
                held_by.append(last)
                held.append(number)
            if len(tokens) < window:
                self.ends.setdefault(last, []).append((len(tokens), number))
        self._flatten(np.array(held_by, np.int64), np.array(held, np.int64))

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self._next, self._link, self._length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = self._state(length[last] + 1, {})
        p = last
        while c not in nxt[p]:
            nxt[p][c] = cur
            if not p:
                return cur
            p = link[p]
        q = nxt[p][c]
        if q != cur:
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _state(self, size: int, moves: dict[int, int]) -> int:
        self._next.append(moves)
        self._link.append(0)
        self._length.append(size)
        return len(self._length) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link = self._next, self._link
        new = self._state(self._length[p] + 1, dict(nxt[q]))
        link[new] = link[q]
        link[q] = new
        while nxt[p].get(c) == q:
            nxt[p][c] = new
            if not p:
                break
            p = link[p]
        return new

    def _flatten(self, held_by: np.ndarray, held: np.ndarray) -> None:
        """Arrays for the scan.  Nearly all states have one move; the others keep a table."""
        n, k = len(self._length), self.window
        link, length = np.array(self._link), np.array(self._length)
        self.root = array("i", [0]) * len(self.vocab)
        for c, to in self._next[0].items():
            self.root[c] = to
        self.symbol, self.to, self.many = array("i", [-1]) * n, array("i", [0]) * n, {}
        for v in range(1, n):
            moves = self._next[v]
            if len(moves) == 1:
                (self.symbol[v], self.to[v]), = moves.items()
            elif moves:
                self.symbol[v], self.many[v] = -2, moves
        self.link, self.length = array("i", link.tolist()), array("i", length.tolist())
        # The state that holds the suffix of a window's length of a state's strings; -1 if they are shorter.
        at = np.where(length[link] >= k, link, np.arange(n))
        while (at[at] != at).any():
            at = at[at]
        full = np.where(length >= k, at, -1)
        self.full = array("i", full.tolist())
        # The nearest state up the links, or itself, in which a short item ends; 0 if there is none.
        ends = np.zeros(n, bool)
        ends[list(self.ends)] = True
        ends[0] = True
        near = np.where(ends, np.arange(n), link)
        while (near[near] != near).any():
            near = near[near]
        self.short = array("i", near.tolist())
        own, item = full[held_by], held
        pairs = np.unique(own[own >= 0] * (len(self.items) + 1) + item[own >= 0])
        own, item = pairs // (len(self.items) + 1), pairs % (len(self.items) + 1)
        self.within_first, self.within = array("i", np.searchsorted(own, np.arange(n + 1)).tolist()), array("i", item.tolist())
        del self._next, self._link, self._length

    def scan(self, tokens: list[bytes]) -> tuple[list[tuple[int, int, int]], set[int]]:
        """Hit runs as (first token, end token, longest match in it), and the items whose windows occur."""
        root, symbol, to, many, link, length = self.root, self.symbol, self.to, self.many, self.link, self.length
        full, short, ends, k = self.full, self.short, self.ends, self.window
        runs: list[list[int]] = []
        seen: set[int] = set()
        states: set[int] = set()
        state = size = 0
        for i, c in enumerate(map(self.vocab.get, tokens)):
            if c is None:
                state = size = 0
                continue
            # Down the links until a state has the move; the root has every one.
            while state:
                if symbol[state] == c:
                    state = to[state]
                    break
                if symbol[state] == -2 and (up := many[state].get(c)) is not None:
                    state = up
                    break
                state = link[state]
                size = length[state]
            else:
                state = root[c]
            size += 1
            reach = 0
            if size >= k:
                reach = k
                states.add(full[state])
            e = short[state]
            while e:
                for n, item in ends[e]:
                    if n <= size:
                        seen.add(item)
                        reach = max(reach, n)
                e = short[link[e]]
            if reach:
                if runs and runs[-1][1] >= i + 1 - reach:
                    while len(runs) > 1 and runs[-2][1] >= i + 1 - reach:
                        runs[-2][1:] = runs[-1][1], max(runs[-1][2], runs[-2][2])
                        runs.pop()
                    r = runs[-1]
                    r[0], r[1], r[2] = min(r[0], i + 1 - reach), i + 1, max(r[2], size)
                else:
                    runs.append([i + 1 - reach, i + 1, size])
        for s in states:
            seen.update(self.within[self.within_first[s] : self.within_first[s + 1]])
        return [tuple(r) for r in runs], seen


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Items in blocks of bounded size; only one block is on the driver at a time."""
    block, size = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator(prefetchPartitions=True):
        tokens = words(row["text"])
        if block and size + len(tokens) > limit:
            yield block
            block, size = [], 0
        block.append((row["item_id"], tokens))
        size += len(tokens)
    yield block


_RUN = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("longest", pa.int32())]))
_RUN_SQL, _ITEMS_SQL = "array<struct<first:int,end:int,longest:int>>", "array<string>"


def _union(runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs of several blocks: those that touch become one."""
    out: list[tuple[int, int, int]] = []
    for a, b, n in sorted(runs):
        if out and out[-1][1] >= a:
            first, end, longest = out[-1]
            out[-1] = first, max(end, b), max(longest, n)
        else:
            out.append((a, b, n))
    return out


def _passes(docs: DataFrame, benchmark: DataFrame, window: int, block_words: int, schema: str, finish) -> DataFrame:
    """All rows against all blocks; ``finish(batch, words, runs, items)`` makes the last pass's batch of ``schema``."""
    spark = prepare(docs.sparkSession)
    at, width = docs.columns.index("text"), len(docs.columns)
    runs_name, items_name = fresh(docs, "runs", "items")
    between = ", ".join([*(f"`{c.replace('`', '``')}` {t}" for c, t in docs.dtypes), f"`{runs_name}` {_RUN_SQL}", f"`{items_name}` {_ITEMS_SQL}"])

    def scanner(automaton, last: bool):
        def scan(batches):
            sam = automaton.value
            for batch in batches:
                old = [c.to_pylist() for c in batch.columns[width:]]
                own = pa.RecordBatch.from_arrays(batch.columns[:width], schema=pa.schema(list(batch.schema)[:width]))
                tokens, runs, items = [], [], []
                for i, text in enumerate(own.column(at)):
                    tokens.append(words(text.as_py()))
                    hit, seen = sam.scan(tokens[-1])
                    names = {sam.items[x] for x in seen}
                    if old:
                        hit = _union([*hit, *((r["first"], r["end"], r["longest"]) for r in old[0][i])])
                        names.update(old[1][i])
                    runs.append(hit)
                    items.append(sorted(names))
                if last:
                    yield finish(own, tokens, runs, items)
                else:
                    found = [pa.array([[{"first": a, "end": b, "longest": n} for a, b, n in r] for r in runs], _RUN), pa.array(items, pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays([*own.columns, *found], names=[*own.schema.names, runs_name, items_name])

        return scan

    blocks, state, held = _blocks(benchmark, block_words), docs, None
    block = next(blocks)
    while (then := next(blocks, None)) is not None:
        automaton = spark.sparkContext.broadcast(SuffixAutomaton(block, window))
        state = cut(state.mapInArrow(lean(scanner(automaton, False)), between), "scanned")
        automaton.destroy()
        if held is not None:
            discard(held)
        block, held = then, state
    return state.mapInArrow(lean(scanner(spark.sparkContext.broadcast(SuffixAutomaton(block, window)), True)), schema)


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per row: doc_id, n_words, hit runs of words, and the ids of the items whose windows occur."""

    def finish(batch, tokens, runs, items):
        found = [[{"first": a, "end": b, "longest": n} for a, b, n in r] for r in runs]
        made = [pa.array([*map(len, tokens)], pa.int64()), pa.array(found, _RUN), pa.array(items, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays([batch.column(0), *made], names=["doc_id", "n_words", "runs", "items"])

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return _passes(source, benchmark, window, block_words, f"doc_id long, n_words long, runs {_RUN_SQL}, items {_ITEMS_SQL}", finish)


def _contaminated(n_hit: int, n_words: int, min_share: int) -> bool:
    return n_hit > 0 and n_hit * min_share >= n_words


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_share: int = 20, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document; contaminated when at least 1 in ``min_share`` words is hit."""
    n_hit = F.expr("aggregate(runs, 0L, (n, r) -> n + r.end - r.first)")
    return scan(docs, benchmark, window, block_words).select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * min_share >= F.col("n_words"))).alias("contaminated"),
        F.expr("coalesce(array_max(transform(runs, r -> r.longest)), 0)").alias("longest_match"),
    )


def _schema(docs: DataFrame) -> str:
    return ", ".join(f"`{c.replace('`', '``')}` {t}" for c, t in docs.dtypes)


def remove_spans(docs: DataFrame, benchmark: DataFrame, max_run: int = WINDOW, max_share: float = 0.0, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Texts without the hit runs, where those exceed the limits; other bytes stay as they are.

    A run goes if it has ``max_run`` words or more, in texts of whose words more than ``max_share`` are hit.
    """
    at = docs.columns.index("text")

    def cut_text(text: str | None, n_words: int, runs: list[tuple[int, int, int]]) -> str | None:
        gone = [(a, b) for a, b, _ in runs if b - a >= max_run]
        if not gone or sum(b - a for a, b, _ in runs) <= max_share * n_words:
            return text
        raw = text.encode("utf-8", "replace")
        spans = [m.span() for m in _WORD.finditer(raw.lower())]  # ASCII letters alone change; lengths stay
        keep = np.ones(len(raw), bool)
        for a, b in gone:
            keep[spans[a][0] : spans[b - 1][1]] = False
        return np.frombuffer(raw, np.uint8)[keep].tobytes().decode("utf-8", "replace")

    def finish(batch, tokens, runs, items):
        new = [cut_text(x.as_py(), len(w), r) for x, w, r in zip(batch.column(at), tokens, runs, strict=True)]
        return batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return _passes(docs, benchmark, window, block_words, _schema(docs), finish)


@plain_names
def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_share: int = 20, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents that are not contaminated, unchanged; every row is judged by its own text."""

    def finish(batch, tokens, runs, items):
        bad = [_contaminated(sum(b - a for a, b, _ in r), len(w), min_share) for w, r in zip(tokens, runs, strict=True)]
        return batch.filter(pa.array([not x for x in bad], pa.bool_()))

    return _passes(docs, benchmark, window, block_words, _schema(docs), finish)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("longest_match")


#: Windows of each item against windows of each document, by brute force.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS g
       FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS g
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
m AS (SELECT doc_id, item_id, dw.k, i FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
