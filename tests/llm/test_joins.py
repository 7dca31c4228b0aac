"""Jaccard join, embeddings and repeats against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.llm import op5_jaccard_join as op5
from palisade.llm import op6_embedding_dedup as op6
from palisade.llm import op10_repeats as op10
from palisade.llm._graph import components


def closure(n, pairs):
    root = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_components(spark):
    rnd = random.Random(2)
    pairs = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(200, 200 + i) for i in range(1, 30)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = closure(240, pairs)
    assert got == {n: want[n] for n in {x for p in pairs if p[0] != p[1] for x in p}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(t, k=4):
    w = (t or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


@pytest.fixture(scope="module")
def near():
    """Groups of near copies by random edits, around the threshold, and one large group."""
    rnd = random.Random(11)
    vocab = [f"w{i}" for i in range(300)]
    texts = []
    for size, edits in [(60, 1), (40, 3), (12, 6), (12, 2), (1, 0), (1, 0)]:
        base = [rnd.choice(vocab) for _ in range(rnd.randint(60, 120))]
        for _ in range(size):
            w = list(base)
            for _ in range(rnd.randint(0, edits)):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            texts.append(" ".join(w))
    texts += ["a", "a", "a b", "A B", "a b c", "a b c d e", "a b c d f", "", None]
    rnd.shuffle(texts)
    return texts


def test_jaccard_join(spark, near, monkeypatch):
    monkeypatch.setattr(op5, "BLOCK", 16)
    docs = spark.createDataFrame(list(enumerate(near)), "doc_id long, text string")
    sets = [shingles(t) for t in near]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    want = closure(len(sets), pairs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op5.link_components(docs).collect()}
    assert got == {i: (len(s), want[i]) for i, s in enumerate(sets)}
    kept = {r.doc_id for r in op5.keep_one(docs).collect()}
    assert kept == {i for i in range(len(sets)) if want[i] == i or not sets[i]}


def test_cells_meet():
    """Any two sets at the threshold share a cell."""
    rng = np.random.default_rng(4)
    for _ in range(600):
        n = int(rng.integers(1, 260))
        common = rng.integers(1, 2**63, n, dtype=np.uint64)
        for extra in range(0, n):
            if 100 * n < 85 * (n + extra):
                break
        most = extra - 1 if extra else 0
        left = int(rng.integers(0, most + 1))
        a = np.unique(np.append(common, rng.integers(1, 2**63, left, dtype=np.uint64)))
        b = np.unique(np.append(common, rng.integers(1, 2**63, most - left, dtype=np.uint64)))
        same = len(np.intersect1d(a, b))
        if 100 * same >= 85 * (len(a) + len(b) - same):
            assert set(op5.cells(a, 85).tolist()) & set(op5.cells(b, 85).tolist())


@pytest.mark.parametrize("percent", [70, 80, 85, 90])
def test_more_groups_than_differences(percent):
    """However the differing shingles fall, they cannot touch every group of a set."""
    rng = np.random.default_rng(5)
    for n in [*range(1, 300, 3), 511, 512, 1023, 1024, 2047, 4095]:
        s = np.unique(rng.integers(1, 2**63, n, dtype=np.uint64))
        most = (100 - percent) * (n + 100 * n // percent) // (100 + percent) + 1
        bands = 1 if 100 * n < percent << n.bit_length() else 2
        assert len(op5.cells(s, percent)) == most * bands


def test_jaccard_at_the_looser_threshold(spark, near):
    docs = spark.createDataFrame(list(enumerate(near)), "doc_id long, text string")
    sets = [shingles(t, 5) for t in near]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = closure(len(sets), pairs)
    assert {r.doc_id: r.component_id for r in op5.link_components(docs, 5, 80).collect()} == dict(enumerate(want))


def test_jaccard_odd_rows(odd, empty):
    rows = op5.link_components(odd).collect()
    assert len(rows) == 10 and {r.component_id for r in rows if r.doc_id in (5, 7)} == {5}
    assert op5.link_components(empty).count() == 0
    kept = op5.keep_one(odd).collect()
    assert sorted(r.doc_id or -1 for r in kept) == [-1, 1, 2, 3, 4, 4, 5, 6]


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(op6, "BLOCK", 64)
    monkeypatch.setattr(op6, "PER_LIST", 40)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(260, 32))
    hot = rng.normal(size=32)
    x = np.concatenate([base, base[:80] + rng.normal(size=(80, 32)) * 0.2, hot + rng.normal(size=(180, 32)) * 0.15, base[:5], base[:5]]).astype(np.float32)
    labels = np.concatenate([np.arange(260) % 2, np.arange(80) % 2, np.zeros(180, int), np.arange(5) % 2, 1 - np.arange(5) % 2])
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, labels))], "vec_id long, embedding array<float>, label int")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    link = (u @ u.T >= 0.93) & (labels[:, None] == labels[None])
    np.fill_diagonal(link, False)
    want = closure(len(x), [(i, j) for i, j in zip(*np.nonzero(link)) if i < j])
    rows = {r.vec_id: r for r in op6.link_vectors(df).collect()}
    found = sum(r.n_links for r in rows.values())
    assert found >= 0.98 * link.sum() and all(rows[i].n_links <= link[i].sum() for i in rows)
    assert sum(rows[i].component_id == want[i] for i in rows) >= 0.98 * len(x)
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows.values())


def test_embedding_odd_rows(spark):
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [float("nan"), 1.0], 1), (6, [float("inf"), 1.0], 1), (7, [1.0, 2.0], None), (8, [1.0, 2.0], 1), (8, [1.0, 2.0], 1), (9, [1.0, 2.0, 3.0], 1), (10, [2.0, 4.0], 1), (11, [1.0, 2.0], 2), (None, [5.0, -1.0], 2), (12, [1e30, 2e30], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, links string")
    got = op6.link_vectors(df).collect()
    assert len(got) == 14 and sorted((r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id and r.n_links) == [(8, 3, 8), (8, 3, 8), (10, 3, 8), (12, 3, 8)]
    assert op6.link_vectors(df.where("false")).count() == 0 and op6.link_vectors(df.where("vec_id < 8")).where("n_links > 0").count() == 0


def repeats(texts, length):
    words = [(t or "").split() for t in texts]
    seen = {}
    for d, w in enumerate(words):
        for i in range(len(w) - length + 1):
            seen.setdefault(tuple(w[i : i + length]), []).append((d, i))
    out = []
    for d, w in enumerate(words):
        gone = {j for i in range(len(w) - length + 1) if len(seen[tuple(w[i : i + length])]) > 1 for j in range(i, i + length)}
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("length", [3, 8, 35])
def test_repeats(spark, length):
    rnd = random.Random(length)
    passages = [[f"p{k}_{i}" for i in range(rnd.randint(length, 3 * length))] for k in range(4)] + [["z"] * (2 * length)]
    texts = []
    for _ in range(60):
        w = []
        for _ in range(rnd.randint(0, 4)):
            w += [rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 6))]
            if rnd.random() < 0.6:
                p = rnd.choice(passages)
                a = rnd.randrange(len(p))
                w += p[a : a + rnd.randint(1, len(p))]
        texts.append(rnd.choice([" ", "  ", "\n"]).join(w))
    texts += [texts[0], texts[0], texts[1], "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op10.remove_repeats(docs, length).collect()}
    assert [got[i] for i in range(len(texts))] == repeats(texts, length)


def test_repeats_odd_rows(odd, empty):
    rows = op10.remove_repeats(odd).collect()
    assert len(rows) == 10 and {r.n_removed for r in rows if r.doc_id in (5, 7)} == {40_001} and not [r for r in rows if r.doc_id not in (5, 7) and r.n_removed]
    assert op10.remove_repeats(empty).count() == 0


def test_null_ids_match_their_own_rows(spark):
    """Texts are joined by what they are: rows of the text joins grow with the rows, not with their square."""
    rnd = random.Random(4)
    passage = [f"p{i}" for i in range(40)]
    texts = [" ".join([*(rnd.choice("abcdefgh") for _ in range(12)), *passage, str(i)]) for i in range(120)]
    docs = spark.createDataFrame([(None if i % 3 else 7, t) for i, t in enumerate(texts)] * 2 + [(None, texts[0] + " z")], "doc_id long, text string")
    found = op10._Search(docs, 35)
    assert found.held(found.spots).count() == found.classes.count() == 121
    rows = op10.remove_repeats(docs, 35).collect()
    assert len(rows) == 241 and sum(r.n_removed for r in rows) == sum(2 * len(t.split()) for t in texts) + 53
    join = op5._Join(docs, 4, 85)
    assert join._members().count() == join.met.select("c").distinct().count()
    assert op5.keep_one(docs).count() <= 121


def test_keep_one_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", 1, "x"), (2, "a b c d e f g", 2, "y"), (None, "a b c d e f g", 3, "z"), (2, "q", 4, "y"), (2, "q", 4, "y")], "doc_id long, text string, _id long, key string")
    docs = docs.withColumn("id", F.lit(1)).withColumn("mine", F.lit(2)).withColumn("component", F.lit(3))
    kept = op5.keep_one(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id, r._id) for r in kept.collect()) == [(1, 1), (2, 4)]
