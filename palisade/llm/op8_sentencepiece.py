"""SentencePiece encoding and decoding by a streaming Viterbi search.

The lattice has a node for each border between characters and an edge for each
piece.  The public model is a merge (BPE) model, whose segmentation is not the
path of the best score sum; but it is a path of the same lattice: the one on
which every two neighbouring pieces survive being merged together.  So an edge
is admitted to a node only where it stands next to the last piece of the path
that survives at the edge's start, and exactly one edge is admitted at each node.
The ids are those of the library, which the tests hold them against.

The search keeps the surviving paths of the last ``longest piece`` nodes alone.
Whenever all of their backpointers meet in one border, the ids before it are
committed and dropped, so memory does not grow with the text.  Where no piece
can cross a border (before a space mark, around characters without a piece) all
paths meet at once; the units between such borders are remembered by a worker.

Characters without a piece are written as byte pieces.  Null texts count as
empty and have no ids.  The mark U+2581 stands for a space in the model, so a
text that holds it decodes with spaces there.  Rows with null or repeated ids
are encoded like all others.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm._spark import kept, lean, plain_names, prepare, table

MODEL = "piece_bpe_32k.model"
#: Longer units are streamed and not remembered.
UNIT_CHARS = 64
#: Entries of a generation of remembered units; two generations are kept.
CACHE_SIZE = 400_000
_MARK = "▁"
_UNIT = re.compile(f"{_MARK}+[^{_MARK}]*|[^{_MARK}]+")


class Pieces:
    """The vocabulary of a model file and the search over it; a worker keeps one while its tasks use that file."""

    @classmethod
    def of(cls, path: str) -> Pieces:
        return kept(path, lambda: cls(path))

    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        self.text = [lib.id_to_piece(i) for i in range(n)]
        self.ids = {}
        self.byte = [0] * 256
        self.byte_of: dict[int, int] = {}
        self.silent = set()
        for i, p in enumerate(self.text):
            if lib.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
                self.byte_of[i] = int(p[3:5], 16)
            elif lib.is_control(i) or lib.is_unknown(i):
                self.silent.add(i)
            else:
                self.ids[p] = i
        self.rank = {p: -lib.get_score(i) for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        crossing = [p for p in self.ids if re.search(f"[^{_MARK}]{_MARK}", p)]
        #: Characters side by side in some piece; between any others all paths meet.
        self.inside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        # Where a piece crosses from a word to a space mark, units would not be independent.
        self.unit = re.compile("(?s).+") if crossing else _UNIT
        self.stable: dict[tuple[str, str], bool] = {}
        self.memory: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def merge(self, text: str) -> list[str]:
        """Pieces of a short text by merging the best neighbours, leftmost first."""
        parts = list(text)
        while True:
            best = None
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best[0]):
                    best = r, i
            if best is None:
                return parts
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def neighbours(self, a: str, b: str) -> bool:
        """Whether two pieces side by side stay as they are."""
        got = self.stable.get((a, b))
        if got is None:
            if len(self.stable) > CACHE_SIZE:
                self.stable.clear()
            # A pair that is a piece itself would be merged at last.
            got = self.stable[a, b] = a + b not in self.rank and self.merge(a + b) == [a, b]
        return got

    def stream(self, unit: str) -> Iterator[str]:
        """Pieces of a unit, each as soon as no later character can change it."""
        ids, longest, stable = self.ids, self.longest, self.stable
        last: dict[int, str] = {0: ""}  # node: last piece of its surviving path
        done = 0
        for end in range(1, len(unit) + 1):
            for start in range(max(done, end - longest), end):
                piece = unit[start:end]
                if piece not in ids and end - start > 1:
                    continue
                before = last.get(start)
                if before is None:
                    continue
                if before:
                    ok = stable.get((before, piece))
                    if ok is None:
                        ok = self.neighbours(before, piece)
                    if not ok:
                        continue
                last[end] = piece
                break
            if end - done >= 2 * longest:
                # Backpointers of all nodes that an edge can still start from.
                fronts = {n for n in range(end - longest + 1, end + 1) if n in last}
                while len(fronts) > 1:
                    n = max(fronts)
                    fronts.remove(n)
                    fronts.add(n - len(last[n]))
                border = fronts.pop()
                if border > done:
                    yield from self._path(last, done, border)
                    done = border
                    last = {n: p for n, p in last.items() if n >= border}
        yield from self._path(last, done, len(unit))

    @staticmethod
    def _path(last: dict[int, str], done: int, end: int) -> list[str]:
        out = []
        while end > done:
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]

    def _unit_ids(self, unit: str) -> tuple[int, ...]:
        out: list[int] = []
        for p in self.stream(unit):
            i = self.ids.get(p)
            if i is None:
                out += [self.byte[b] for b in p.encode("utf-8", "surrogatepass")]
            else:
                out.append(i)
        return tuple(out)

    def _parted(self, unit: str) -> tuple[int, ...]:
        """Ids of a unit, part by part between borders that no piece crosses."""
        inside, memory = self.inside, self.memory
        at = [0, *(i for i in range(1, len(unit)) if unit[i - 1 : i + 1] not in inside), len(unit)]
        out: list[int] = []
        for a, b in zip(at, at[1:]):
            part = unit[a:b]
            got = memory.get(part) or self.older.get(part)
            if got is None:
                got = self._unit_ids(part)
                if b - a <= UNIT_CHARS:
                    memory[part] = got
            out += got
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        if len(self.memory) > CACHE_SIZE:
            self.memory, self.older = {}, self.memory
        memory, older = self.memory, self.older
        for unit in self.unit.findall(_MARK + text.replace(" ", _MARK)):
            got = memory.get(unit)
            if got is None:
                got = older.get(unit) or self._parted(unit)
                if len(unit) <= UNIT_CHARS:
                    memory[unit] = got
            out += got
        return out

    def decode(self, ids) -> str:
        out, raw = [], bytearray()
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                raw.append(b)
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if i not in self.silent:
                out.append(self.text[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out).replace(_MARK, " ").removeprefix(" ")


@plain_names
def encode(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """The rows with token_ids (array of int) and n_tokens after their columns; ``text`` is decoded from the ids."""
    prepare(docs.sparkSession)
    path = model_path or public_tokenizers.path(MODEL)
    at = docs.columns.index("text")

    def run(batches):
        pieces = Pieces.of(path)
        for batch in batches:
            ids = [None if t is None else pieces.encode(t) for t in batch.column(at).to_pylist()]
            text = pa.array([None if x is None else pieces.decode(x) for x in ids], batch.schema.field(at).type)
            flat = np.array([i for x in ids if x for i in x], np.int32)
            sizes = np.array([len(x or ()) for x in ids], np.int64)
            tokens = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(flat, pa.int32()))
            cols = [text if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([*cols, tokens, pa.array(sizes)], names=[*batch.schema.names, "token_ids", "n_tokens"])

    types = ", ".join(f"{c} {t}" for c, t in docs.dtypes)
    return docs.mapInArrow(lean(run, path), f"{types}, token_ids array<int>, n_tokens long")


def report(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers) and whether the text came back."""
    prepare(docs.sparkSession)
    path = model_path or public_tokenizers.path(MODEL)

    def run(batches):
        pieces = Pieces.of(path)
        for batch in batches:
            rows: list[list] = [[], [], []]
            for text in batch.column(1).to_pylist():
                ids = pieces.encode(text)
                for c, v in zip(rows, (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), pieces.decode(ids) == (text or "").replace(_MARK, " ")), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.bool_())], names=["doc_id", "n_tokens", "ids_crc32", "round_trip"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run, path), "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
