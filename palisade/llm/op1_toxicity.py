"""Toxicity by noisy-channel deobfuscation.

A word is what its writer meant, sent through a channel that replaces letters by
look-alikes, repeats them, or spaces them out.  Each suspicious word becomes a
lattice of the letters it may stand for; the Viterbi path under a character
language model and the channel's costs is the restored word.  Words with one
reading pass as they are.  The restored text is then scored.

1. Character trigrams of every document are counted; the counts are summed per
   batch before the shuffle, and the model that is broadcast has a fixed size.
2. Labelled documents (at most ``FIT_ROWS``, dealt by a hash of their ids) give
   the words and word beginnings that toxic texts hold far more often.
3. Other labelled documents (at most ``CALIBRATION_ROWS``) fit a logistic model
   on a text's strongest evidence, so that scores are probabilities.
4. Every whole text is decoded and scored.

Rows whose crc32(doc_id) mod 4 is 2 are held out of steps 2 and 3.  Labels,
language, source and id are never inputs of a score.  Null and empty texts are
scored as texts without evidence.  Null ids are never labelled and not held out.
Where there are no usable labels all texts get the same score, 0.
Repeated rows get equal scores.  Further columns are left out of the report.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm._spark import lean, plain_names, prepare, table
from palisade.llm._text import buffers, chunks

FIT_ROWS = 20_000
CALIBRATION_ROWS = 10_000
THRESHOLD = 0.3
MOST_FEATURES = 20_000
LEAST_DOCS = 3
LEAST_Z = 4.0
#: Distinct words whose reading a worker remembers.
CACHE_SIZE = 1 << 19

# --- character language model -------------------------------------------------

#: 0: border (all that is no letter), 1-26: a-z, 27: any other letter.
SYMBOLS = 28
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[0x61:0x7B] = np.arange(1, 27)
_SYMBOL[0x41:0x5B] = np.arange(1, 27)
_SYMBOL[0x80:] = 27


def _trigrams(batches):
    for batch in batches:
        data, off = buffers(batch.column(0))
        total = np.zeros(SYMBOLS**3, np.int64)
        for i, j in chunks(off):
            s = _SYMBOL[data[off[i] : off[j]]].astype(np.int64)
            if len(s) < 3:
                continue
            code = (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
            ends = off[i + 1 : j] - off[i]
            ok = np.ones(len(code), bool)
            for back in (1, 2):
                at = ends - back
                ok[at[(at >= 0) & (at < len(ok))]] = False
            total += np.bincount(code[ok], minlength=SYMBOLS**3)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["code", "n"])


def language_model(docs: DataFrame) -> np.ndarray:
    """log P(symbol | two before it), from all texts."""
    rows = docs.select(F.col("text").cast("string")).mapInArrow(lean(_trigrams), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SYMBOLS**3)
    counts[rows["code"].to_numpy()] = rows["n"].to_numpy()
    counts = counts.reshape(-1, SYMBOLS, SYMBOLS)
    lower = counts.sum(axis=0) + 0.5
    lower = lower / lower.sum(axis=1, keepdims=True)
    smooth = counts + 5 * lower[None]
    return np.log(smooth / smooth.sum(axis=2, keepdims=True)).astype(np.float32)


# --- the channel ---------------------------------------------------------------

#: Letters that look-alikes stand for (fixed values).
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "*": "aeiou"}
SWAP_COST = 1.0
DROP_COST = 0.3
KEEP_REPEAT_COST = 1.5

_LEET = re.compile(r"(?=.*[^\W\d_])(?=.*[0-9@$!|+(<€£*])(?:[^\W_]|[@$!|+(<€£*])+")
_REPEAT = re.compile(r"([^\W\d_])\1\1")
_SPACED = re.compile(r"(?<![^\s])(?:(?:[^\W_]|[@$!|+(<€£*])[ .\-_*]{1,2}){2,}(?:[^\W_]|[@$!|+(<€£*])(?![^\s.,;:?])")
_EDGE = re.compile(r"^[^a-z0-9@$|+(<\x80-\U0010ffff]+|[^a-z0-9@$+\x80-\U0010ffff]+$")


def _letters(path: tuple) -> str:
    out = []
    while path:
        path, letters = path
        out.append(letters)
    return "".join(reversed(out))


class Decoder:
    """Viterbi decoding of suspicious words, and the evidence of restored texts."""

    def __init__(self, model: np.ndarray, weights: dict[str, float] | None = None):
        self.model = model
        self.weights = weights
        self.memory: dict[str, object] = {}

    def restore(self, word: str) -> str:
        """The most likely letters behind a suspicious word."""
        runs: list[tuple[str, int]] = []
        for ch in word:
            if runs and runs[-1][0] == ch:
                runs[-1] = ch, runs[-1][1] + 1
            else:
                runs.append((ch, 1))
        # State: the two symbols before; value: (cost, letters as a chain to the path before them).
        states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for ch, n in runs:
            readings = [(c, SWAP_COST) for c in LOOKALIKES.get(ch, "")]
            if "a" <= ch <= "z" or ch > "\x7f":
                readings.append((ch, 0.0))
            elif not readings:
                continue  # a separator: dropped
            edges = []
            for c, cost in readings:
                # A run stands for one letter or two; literal pairs are common.
                edges.append((c, cost + (DROP_COST if n > 1 else 0)))
                if n > 1:
                    edges.append((c + c, 2 * cost + (KEEP_REPEAT_COST if n > 2 else 0)))
            new: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (total, path) in states.items():
                for letters, cost in edges:
                    x, y, t = a, b, total + cost
                    for c in letters:
                        z = ord(c) - 96 if "a" <= c <= "z" else 27
                        t -= float(self.model[x, y, z])
                        x, y = y, z
                    if (old := new.get((x, y))) is None or t < old[0]:
                        new[x, y] = t, (path, letters)
            # One survivor for each pair of symbols: at most SYMBOLS ** 2.
            states = new
        ends = [(t - float(self.model[a, b, 0]), path) for (a, b), (t, path) in states.items()]
        least = min(t for t, _ in ends)
        return min(_letters(path) for t, path in ends if t == least)

    def readings(self, word: str) -> tuple[str, ...]:
        """The word without marks around it and, where it is suspicious, restored."""
        bare = _EDGE.sub("", word)
        if not bare:
            return ()
        if _LEET.fullmatch(bare) or _REPEAT.search(bare):
            return bare, self.restore(bare)
        return (bare,)

    def features(self, word: str) -> list[str]:
        out = []
        for w in dict.fromkeys(self.readings(word)):
            out.append(w)
            out += [f"{w[:n]}*" for n in (4, 5, 6) if len(w) > n]
        return out

    def words(self, text: str) -> set[str]:
        """Distinct words of a text, those written with gaps joined as well."""
        low = text.lower()
        words = set(low.split())
        for m in _SPACED.finditer(low):
            words.add(re.sub(r"[ .\-_*]", "", m.group()))
        return words

    def weight(self, word: str) -> float:
        got = self.memory.get(word)
        if got is None:
            if len(self.memory) > CACHE_SIZE:
                self.memory.clear()
            got = self.memory[word] = max((self.weights.get(f, 0.0) for f in self.features(word)), default=0.0)
        return got

    def evidence(self, text: str) -> tuple[float, float, float, float]:
        """Strongest and second weight of a text's words, their sum and number."""
        found = sorted((w for w in map(self.weight, self.words(text)) if w > 0), reverse=True)
        a = found[0] if found else 0.0
        b = found[1] if len(found) > 1 else 0.0
        return a, b, min(sum(found), 40.0), math.log1p(len(found))


def _labelled(docs: DataFrame, labels: DataFrame, kinds: tuple[int, ...], most: int) -> DataFrame:
    """Texts of at most ``most`` labelled rows; the list of their ids is bounded by that, and broadcast."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    one = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    ids = one.where(fold.isin(*kinds)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(ids), "doc_id").select("text", "toxic")


def _feature_counts(model):
    def run(batches):
        decoder = Decoder(model.value)
        counts: dict[str, list[int]] = {}
        size = [0, 0]

        def flush():
            keys = list(counts)
            out = pa.RecordBatch.from_arrays([pa.array([*keys, ""]), pa.array([*(counts[k][1] for k in keys), size[1]], pa.int64()), pa.array([*(counts[k][0] for k in keys), size[0]], pa.int64())], names=["feature", "pos", "neg"])
            counts.clear()
            size[:] = 0, 0
            return out

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                size[toxic] += 1
                for f in {f for w in decoder.words(text or "") for f in decoder.features(w)}:
                    counts.setdefault(f, [0, 0])[toxic] += 1
            if len(counts) > 200_000:
                yield flush()
        yield flush()

    return run


def learn_weights(docs: DataFrame, labels: DataFrame, model) -> dict[str, float]:
    """Log odds of the words that mark toxic texts."""
    rows = _labelled(docs, labels, (0, 1), FIT_ROWS).mapInArrow(lean(_feature_counts(model)), "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    total = rows.where("feature = ''").first()
    pos, neg = (total["pos"], total["neg"]) if total else (0, 0)
    if not pos or not neg:
        return {}
    odds = F.log((F.col("pos") + 0.5) / (pos + 1.0)) - F.log((F.col("neg") + 0.5) / (neg + 1.0))
    # Signed root of the likelihood ratio: fair to words that clean texts never hold.
    rate, seen = pos / (pos + neg), F.col("pos") + F.col("neg")
    clean_part = F.when(F.col("neg") > 0, F.col("neg") * F.log(F.col("neg") / (seen * (1 - rate)))).otherwise(0.0)
    z = F.signum(odds) * F.sqrt(F.abs(2 * (F.col("pos") * F.log(F.col("pos") / (seen * rate)) + clean_part)))
    # What goes to the driver is bounded: the strongest features alone.
    best = rows.where((F.col("feature") != "") & (F.col("pos") >= LEAST_DOCS)).select("feature", odds.alias("odds"), z.alias("z")).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "feature").limit(MOST_FEATURES)
    return {r["feature"]: r["odds"] for r in best.collect()}


def _evidence(setup):
    def run(batches):
        decoder = Decoder(*setup.value[:2])
        for batch in batches:
            rows = [decoder.evidence(t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    keep = np.eye(len(w)) * ridge
    keep[0, 0] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, dict[str, float], np.ndarray | None]:
    """(language model, word weights, logistic weights)."""
    spark = prepare(docs.sparkSession)
    lm = language_model(docs)
    weights = learn_weights(docs, labels, spark.sparkContext.broadcast(lm))
    setup = spark.sparkContext.broadcast((lm, weights))
    rows = _labelled(docs, labels, (3,), CALIBRATION_ROWS).select("text", F.col("toxic").cast("int")).mapInArrow(lean(_evidence(setup)), "x array<double>, toxic int").toArrow()
    y = rows["toxic"].to_numpy().astype(float)
    if not weights or not 0 < y.sum() < len(y):
        return lm, weights, None
    return lm, weights, _logistic(np.array(rows["x"].to_pylist()), y)


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``."""
    return _scored(docs, labels, threshold)


@plain_names
def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows scored below the threshold, unchanged."""
    spark = prepare(docs.sparkSession)
    setup = spark.sparkContext.broadcast(fit(docs, labels))
    at = docs.columns.index("text")

    def run(batches):
        scorer = _Scorer(setup.value)
        for batch in batches:
            yield batch.filter(pc.less(scorer(batch.column(at)), threshold))

    return docs.mapInArrow(lean(run), docs.schema)


class _Scorer:
    def __init__(self, setup):
        self.decoder = Decoder(*setup[:2])
        self.logit = setup[2]

    def __call__(self, texts: pa.Array) -> pa.Array:
        if self.logit is None:
            return pa.array(np.zeros(len(texts)))
        x = np.array([self.decoder.evidence(t or "") for t in texts.to_pylist()]).reshape(-1, 4)
        return pa.array(1 / (1 + np.exp(-(self.logit[0] + x @ self.logit[1:]))))


def _scored(docs: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    spark = prepare(docs.sparkSession)
    setup = spark.sparkContext.broadcast(fit(docs, labels))

    def run(batches):
        scorer = _Scorer(setup.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), scorer(batch.column(1))], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
