r"""Personal data by weak supervision.

Candidates are found by patterns: the base patterns, whose valid matches are
always reported, and looser ones (local phone numbers, social-security numbers,
account numbers, written-out addresses).  Six labelers vote on each candidate,
for, against or not at all: the strict pattern, a gazetteer, words before it
that speak for it, words that speak against it, its shape, and what touches it.

Votes and span features are counted per batch and summed, so what reaches the
driver is bounded by the number of combinations.  Expectation-maximisation over
the vote patterns of each kind estimates how far each labeler can be relied on
and how likely each pattern is personal data; a logistic span classifier is then
trained on all candidates with those probabilities as its labels.  A second pass
keeps the looser candidates that it accepts.

Null texts count as empty.  Every row gives one row; repeated rows equal ones.
Spans count characters, end exclusive.  Other columns are left out of reports.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm._spark import plain_names, prepare, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "phone_local", "ssn", "iban", "email_written")
ACCEPT = 0.5
LABELERS = 6

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOOSE = (
    ("phone_local", re.compile(r"(?<![0-9+.\-])(?:\([0-9]{3}\) ?|\b[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9-])")),
    ("ssn", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("iban", re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")),
)
_WRITTEN = re.compile(r" ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]+(?:(?: ?[\[(] ?dot ?[\])] ?|\.)[A-Za-z0-9-]+)+")
_DIGIT = re.compile("[0-9]")

#: Gazetteers (fixed values).
TLDS = frozenset("com org net edu gov mil int io co info biz de fr es it nl uk us ca au ch at be eu pl se no dk fi pt br mx ar jp cn in ru".split())
CALLING = tuple("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 218 220 234 254 255 256 351 352 353 354 355 356 357 358 359 370 371 372 373 374 375 380 381 385 386 420 421 852 886 961 962 963 964 965 966 967 968 970 971 972 973 974".split())
ISSUERS = ("4", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "34", "37", "30", "36", "38", "39", "6011", "65", "35", "62")
_FOR = {
    "email": re.compile(r"mail|contact|write to|reach|correo|kontakt|courriel"),
    "ip": re.compile(r"\bip\b|host|server|address|addr|login|from"),
    "card": re.compile(r"card|visa|credit|debit|pay|karte|carte|tarjeta"),
    "phone": re.compile(r"phone|tel|call|mobile|fax|cell|handy|portable"),
    "ssn": re.compile(r"ssn|social|security|tax"),
    "iban": re.compile(r"iban|bank|account|konto|compte|cuenta"),
}
_AGAINST = re.compile(r"version|\bv\.?\s*$|release|isbn|order|invoice|serial|page|section|build|part no|#\s*$|\bsku\b")
_KIND_OF = {"phone_local": "phone", "email_written": "email"}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str):
    """Leftmost non-overlapping addresses: a local run, @ and a dotted domain."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all valid base matches."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def _gazetteer(kind: str, s: str, digits: str) -> int:
    if kind in ("email", "email_written"):
        return 1 if re.split(r"[^A-Za-z]+", s.rstrip("])"))[-1].lower() in TLDS else -1
    if kind == "ip":
        first = int((s.split(".")[0].lstrip("0") or "0")[:4])
        return 1 if 0 < first < 240 else -1
    if kind == "card":
        return 1 if digits.startswith(ISSUERS) else -1
    if kind == "phone":
        return 1 if digits.startswith(CALLING) else -1
    if kind == "phone_local":
        return 1 if digits[0] not in "01" and digits[3] not in "01" else -1
    if kind == "ssn":
        return -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" else 1
    flat = s.replace(" ", "")
    return 1 if int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1 else -1


def votes(kind: str, text: str, start: int, end: int) -> tuple[int, ...]:
    """The labelers' votes: 1 for, -1 against, 0 none."""
    s, before = text[start:end], text[max(0, start - 40) : start].lower()
    digits = "".join(c for c in s if c.isdigit())
    touch = text[start - 1 : start] + text[end : end + 1]
    return (
        1 if kind in BASE else 0,
        _gazetteer(kind, s, digits),
        1 if _FOR[_KIND_OF.get(kind, kind)].search(before) else 0,
        -1 if _AGAINST.search(before) else 0,
        1 if kind.startswith("email") or len(set(digits)) > 2 else -1,
        -1 if any(c.isalnum() or c in "_/=" for c in touch) else 1,
    )


def features(kind: str, text: str, start: int, end: int) -> tuple[int, ...]:
    """Small discrete features of a span and its sides."""

    def side(c: str) -> int:
        return 0 if not c or c.isspace() else 1 if c.isalnum() else 2 if c in ".,;:!?)" else 3

    s = text[start:end]
    return KINDS.index(kind), min(5, (end - start) // 6), int(any(c in " -()" for c in s)), side(text[start - 1 : start]), side(text[end : end + 1])


_SIZES = (len(KINDS), 6, 2, 4, 4)


def _written(text: str) -> list[tuple[int, int]]:
    """Addresses with a written-out "at": words joined by single marks, read back from it, and what follows it."""
    out, last = [], 0
    for m in _WRITTEN.finditer(text):
        end = a = m.start()
        while a > last and text[a - 1] in _LOCAL and not (text[a - 1] in ".%+-" and (a == end or text[a] in ".%+-")):
            a -= 1
        # A name starts where a word does.
        while a < end and (text[a] in ".%+-" or a and (text[a - 1].isalnum() or text[a - 1] == "_")):
            a += 1
        if a < end:
            out.append((a, m.end()))
            last = m.end()
    return out


def candidates(text: str) -> list[tuple[int, int, int]]:
    """Base spans, and looser candidates that overlap none of them; by start, then kind."""
    spans = base_spans(text)
    loose = []
    if _DIGIT.search(text):
        loose += [(m.start(), KINDS.index(k), m.end()) for k, p in _LOOSE for m in p.finditer(text)]
    if "at]" in text or "at)" in text or "at ]" in text or "at )" in text:
        loose += [(a, KINDS.index("email_written"), b) for a, b in _written(text)]
    if loose:
        taken, i, edge, last = list(spans), 0, 0, 0
        for a, k, b in sorted(loose):
            while i < len(taken) and taken[i][0] < b:
                edge = max(edge, taken[i][2])
                i += 1
            if edge <= a and last <= a:
                spans.append((a, k, b))
                last = b
        spans.sort()
    return spans


def _observations(batches):
    for batch in batches:
        seen: Counter = Counter()
        for text in batch.column(0).to_pylist():
            for a, k, b in candidates(text or ""):
                seen[votes(KINDS[k], text, a, b), features(KINDS[k], text, a, b)] += 1
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([list(v) for v, _ in keys], pa.list_(pa.int32())), pa.array([list(f) for _, f in keys], pa.list_(pa.int32())), pa.array([seen[k] for k in keys], pa.int64())], names=["votes", "features", "n"])


class Aggregator:
    """Labeler reliabilities by EM for each kind, and the span classifier."""

    def __init__(self, votes_: np.ndarray, features_: np.ndarray, n: np.ndarray, steps: int = 50):
        kinds = features_[:, 0] if len(n) else np.zeros(0, int)
        self.reliability: dict[str, np.ndarray] = {}
        self.prior: dict[str, float] = {}
        target = np.zeros(len(n))
        for k in np.unique(kinds):
            at = np.flatnonzero(kinds == k)
            target[at] = self._em(KINDS[k], votes_[at] + 1, n[at].astype(float), steps)
        x = self._design(votes_, features_)
        self.weights = self._train(x, target, n.astype(float))

    def _em(self, kind: str, v: np.ndarray, n: np.ndarray, steps: int) -> np.ndarray:
        """P(personal data) of each row of votes (0 against, 1 none, 2 for)."""
        score = (v - 1).sum(axis=1)
        p = np.clip(0.5 + 0.15 * score, 0.05, 0.95)
        for _ in range(steps):
            prior = ((p * n).sum() + 1) / (n.sum() + 2)
            table_ = np.ones((2, LABELERS, 3))
            for y, w in ((1, p * n), (0, (1 - p) * n)):
                for j in range(LABELERS):
                    table_[y, j] += np.bincount(v[:, j], w, minlength=3)
                    # Labelers are better than chance: a weak prior keeps the classes apart.
                    table_[y, j, 2 * y] += 2
            table_ /= table_.sum(axis=2, keepdims=True)
            logs = np.log(table_)
            both = [np.log(prior if y else 1 - prior) + sum(logs[y, j, v[:, j]] for j in range(LABELERS)) for y in (0, 1)]
            p = 1 / (1 + np.exp(np.clip(both[0] - both[1], -50, 50)))
        self.reliability[kind], self.prior[kind] = table_, prior
        return p

    @staticmethod
    def _design(v: np.ndarray, f: np.ndarray) -> np.ndarray:
        n = len(v)
        cols = [np.ones((n, 1))]
        for j in range(LABELERS):
            cols.append(np.eye(3)[v[:, j] + 1][:, [0, 2]] if n else np.zeros((0, 2)))
        for j, size in enumerate(_SIZES):
            cols.append(np.eye(size)[f[:, j]] if n else np.zeros((0, size)))
        return np.concatenate(cols, axis=1)

    @staticmethod
    def _train(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = np.zeros(x.shape[1])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
            h = (x * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.eye(len(w))
            step = np.linalg.solve(h, x.T @ (n * (y - p)) - w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        return w

    def probability(self, v: tuple[int, ...], f: tuple[int, ...]) -> float:
        x = self._design(np.array([v]), np.array([f]))
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights, -40, 40)))[0])


def fit(docs: DataFrame) -> Aggregator:
    rows = docs.select(F.col("text").cast("string")).mapInArrow(_observations, "votes array<int>, features array<int>, n long").groupBy("votes", "features").agg(F.sum("n").alias("n")).collect()
    rows.sort()
    shape = lambda i, w: np.array([r[i] for r in rows], int).reshape(len(rows), w)
    return Aggregator(shape(0, LABELERS), shape(1, len(_SIZES)), np.array([r[2] for r in rows]))


def _finder(model):
    def run(batches):
        judge = model.value
        known: dict[tuple, bool] = {}

        def accepted(text: str, a: int, k: int, b: int) -> bool:
            if k < len(BASE):
                return True
            key = votes(KINDS[k], text, a, b), features(KINDS[k], text, a, b)
            if key not in known:
                known[key] = judge.probability(*key) >= ACCEPT
            return known[key]

        for batch in batches:
            spans = [[s for s in candidates(t or "") if accepted(t, *s)] for t in batch.column(1).to_pylist()]
            joined = [",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in row) for row in spans]
            base = [hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in row if k < len(BASE)).encode()).hexdigest() for row in spans]
            counts = [pa.array([sum(k == i for _, k, _ in row) for row in spans], pa.int64()) for i in range(len(BASE))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(base, pa.string()), pa.array(joined, pa.string())], names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return run


def find(docs: DataFrame, model: Aggregator | None = None) -> DataFrame:
    """doc_id, counts by base kind, digest of the base spans, and all spans."""
    spark = prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model or fit(docs))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_finder(sent), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


@plain_names
def redact(docs: DataFrame, model: Aggregator | None = None, mark: str = "[PII]") -> DataFrame:
    """The documents with all found spans replaced."""
    spark = prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model or fit(docs))
    at = docs.columns.index("text")

    def one(text: str | None, judge: Aggregator) -> str | None:
        if not text:
            return text
        out, done = [], 0
        for a, k, b in candidates(text):
            if a >= done and (k < len(BASE) or judge.probability(votes(KINDS[k], text, a, b), features(KINDS[k], text, a, b)) >= ACCEPT):
                out += [text[done:a], mark]
                done = b
        return "".join([*out, text[done:]])

    def run(batches):
        for batch in batches:
            new = pa.array([one(t, sent.value) for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), new)

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))


def _part(k: int, kind: str, pattern: str, valid: str) -> str:
    p = f"'{pattern}'"
    return f"SELECT doc_id, {k} AS k, '{kind}' AS kind, '{valid}' AS rule, regexp_extract_all(t, {p}) AS a, regexp_split_to_array(t, {p}) AS gaps FROM d"


#: The base spans by DuckDB's matcher.
BASE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join([_part(0, "email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "any"), _part(1, "ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "ip"), _part(2, "card", r"[0-9](?:[\x20-]?[0-9])+", "card"), _part(3, "phone", r"\+[0-9][\x20().0-9-]+[0-9]", "phone")])}),
p AS (SELECT doc_id, k, kind, rule, unnest(a) AS a, unnest(list_transform(gaps[1 : len(a)], lambda x: length(x))) AS gap, unnest(range(1, len(a) + 1)) AS i FROM m WHERE len(a) > 0),
q AS (SELECT doc_id, k, kind, rule, a, regexp_replace(a, '[^0-9]', '', 'g') AS digits, sum(gap + length(a)) OVER (PARTITION BY doc_id, k ORDER BY i) AS e FROM p),
v AS (SELECT *, CASE rule WHEN 'any' THEN true
    WHEN 'ip' THEN len(list_filter(string_split(a, '.'), lambda x: length(ltrim(x, '0')) > 3 OR try_cast(x AS BIGINT) > 255)) = 0
    WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15
    ELSE length(digits) BETWEEN 12 AND 19 AND list_sum(list_transform(range(0, length(digits)), lambda j: CASE WHEN j % 2 = 0 THEN CAST(digits[length(digits) - j] AS INT) WHEN CAST(digits[length(digits) - j] AS INT) > 4 THEN CAST(digits[length(digits) - j] AS INT) * 2 - 9 ELSE CAST(digits[length(digits) - j] AS INT) * 2 END)) % 10 = 0 END AS ok FROM q),
f AS (SELECT doc_id, k, kind, CAST(e - length(a) AS BIGINT) AS b, CAST(e AS BIGINT) AS e FROM v WHERE ok),
r AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_email, count(*) FILTER (k = 1) AS n_ip, count(*) FILTER (k = 2) AS n_card, count(*) FILTER (k = 3) AS n_phone, string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, k) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_email, 0) AS BIGINT) AS n_email, CAST(coalesce(n_ip, 0) AS BIGINT) AS n_ip, CAST(coalesce(n_card, 0) AS BIGINT) AS n_card, CAST(coalesce(n_phone, 0) AS BIGINT) AS n_phone, sha256(coalesce(spans, '')) AS base_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
