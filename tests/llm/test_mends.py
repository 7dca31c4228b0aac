"""Recall over many lists, bands of low thresholds, and odd column names."""

import gc
import weakref

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palisade.llm import _graph, op1_toxicity, op2_pii, op3_secrets, op4_decontaminate, op5_jaccard_join, op8_sentencepiece
from palisade.llm import op6_embedding_dedup as op6
from palisade.llm._spark import lean


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def low_rank(rng, n, d, rank):
    return unit(rng.normal(size=(n, rank)) @ rng.normal(size=(rank, d)))


@pytest.mark.parametrize("d, kind, lists", [(64, "full", 200), (256, 8, 200), (256, 4, 400), (384, 10, 200), (768, 16, 200), (384, 1.0, 200), (384, 1.5, 200)])
def test_probes_reach_partners(d, kind, lists):
    """Pairs at cosine 0.93 to 0.96 over hundreds of lists, found from either side; a float is a spectrum's exponent."""
    rng = np.random.default_rng(7)
    x = unit(rng.normal(size=(4000, d))) if kind == "full" else low_rank(rng, 4000, d, kind) if isinstance(kind, int) else unit(rng.normal(size=(4000, d)) * np.arange(1, d + 1) ** -kind)
    q = op6.Quantizer(x, lists, 0.93)
    a, b = x[:800], x[rng.permutation(4000)[:800]]
    aside = unit(b - (a * b).sum(axis=1, keepdims=True) * a)
    t = rng.uniform(0.93, 0.96, size=(800, 1))
    y = t * a + np.sqrt(1 - t * t) * aside
    ha, hy = (a @ q.coarse.T).argmax(axis=1), (y @ q.coarse.T).argmax(axis=1)
    hit = [hy[i] in p or ha[i] in r for i, (p, r) in enumerate(zip(q.probes(a), q.probes(y)))]
    assert np.mean(hit) >= 0.98


@pytest.mark.parametrize("exact", [False, True])
def test_links_over_many_lists(spark, monkeypatch, exact):
    """Vectors of rank 8 in 128 dimensions over 200 lists, end to end against brute force."""
    monkeypatch.setattr(op6, "PER_LIST", 15)
    rng = np.random.default_rng(3)
    x = low_rank(rng, 3000, 128, 8)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(4)
    links = {r.vec_id: r.n_links for r in op6.link_vectors(df, exact=exact).collect()}
    want = (x @ x.T >= 0.93).sum(axis=1) - 1
    found, total = sum(links.values()), int(want.sum())
    assert all(links[i] <= want[i] for i in links) and total > 1000
    assert found == total if exact else found >= 0.98 * total


@pytest.mark.parametrize("percent, n, big", [(40, 120, 300), (45, 120, 266), (30, 100, 330), (20, 60, 300), (50, 100, 200), (85, 100, 117)])
def test_cells_of_any_threshold(percent, n, big):
    """A set within the largest one that is still similar shares a cell with it."""
    rng = np.random.default_rng(percent)
    for _ in range(60):
        y = np.unique(rng.integers(0, 2**64, big, dtype=np.uint64))
        x = np.sort(rng.choice(y, n, replace=False))
        assert 100 * len(x) >= percent * len(y)
        assert set(op5_jaccard_join.cells(x, percent)) & set(op5_jaccard_join.cells(y, percent))


@pytest.mark.parametrize("percent, n, big", [(20, 1, 5), (51, 26, 50), (50, 1, 2), (80, 4, 5), (85, 6, 7), (30, 40, 130)])
def test_cells_of_small_sets(percent, n, big):
    rng = np.random.default_rng(percent)
    for _ in range(2000):
        y = np.unique(rng.integers(0, 2**64, big, dtype=np.uint64))
        x = np.sort(rng.choice(y, n, replace=False))
        assert set(op5_jaccard_join.cells(x, percent)) & set(op5_jaccard_join.cells(y, percent))


@pytest.mark.parametrize("n", [1000, 15_500, 17_000, 19_000, 60_000])
def test_bound_keeps_similar_sets_of_any_size(n):
    """One leaf of pairs just above 85 in 100, and a set without a point; the tree gives the same."""
    rng = np.random.default_rng(n)
    base = rng.integers(0, 2**64, 2 * n, dtype=np.uint64)
    same = -(-85 * 2 * n // 185) + 1
    sets = [np.sort(np.append(base[:same], base[same + i * (n - same) : same + (i + 1) * (n - same)])) for i in range(3)]
    assert all(op5_jaccard_join._similar(x, y, 85) for x in sets for y in sets)
    sizes = np.array([len(x) for x in sets])
    for vecs in ([op5_jaccard_join.count_vector(x) for x in sets], [b""] * 3, [b"", *(op5_jaccard_join.count_vector(x) for x in sets[1:])]):
        a, b = op5_jaccard_join._bound_pairs(np.array([0]), np.array([3]), sizes, vecs, 85)
        assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(0, 1), (0, 2), (1, 2)]
        points = op5_jaccard_join._points(vecs, np.append(sizes, 40))
        tree = op5_jaccard_join.CountTree(points, sizes, 85)
        assert all(sorted(tree.search(points[i], n).tolist()) == [0, 1, 2] for i in range(3))


def test_links_of_very_long_texts(spark):
    """Two texts of 19,000 words that differ in 500 of them side by side."""
    words = [f"w{i}" for i in range(19_000)]
    texts = [" ".join(words), " ".join([*words[:-500], *(f"x{i}" for i in range(500))]), " ".join(words[:9000])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(map(tuple, op5_jaccard_join.link_components(df).collect()))
    assert got == [(0, 18_997, 0), (1, 18_997, 0), (2, 8_997, 2)]


def test_unsettled_components_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(_graph, "MOST_STEPS", 1)
    path = spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long")
    with pytest.raises(RuntimeError, match="not settled"):
        _graph.components(path)


STAGES = {
    "op1": lambda d, t: op1_toxicity.keep_clean(d, t("labels")),
    "op2": lambda d, t: op2_pii.redact(d),
    "op3": lambda d, t: op3_secrets.redact(d),
    "op4": lambda d, t: op4_decontaminate.clean(d, t("benchmark")),
    "op5": lambda d, t: op5_jaccard_join.keep_one(d, k=5, percent=80),
    "op8": lambda d, t: op8_sentencepiece.encode(d),
}


@pytest.mark.parametrize("name", STAGES)
def test_odd_column_names(spark, data, tmp_path, name):
    """Names with dots and backticks, and names that the stages use themselves."""
    more = {"a.b": "1", "q`t": "2", "Token_IDs": "3", "n_tokens": "4", "key": "5", "component": "6", "spans": "7", "column_1": "8", "sp ace": "9"}
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(60)
    docs = docs.select(*docs.columns, *(F.lit(v).alias(k) for k, v in more.items()))
    out = STAGES[name](docs, lambda t: spark.read.parquet(f"{data}/{t}.parquet"))
    assert out.columns[: len(docs.columns)] == docs.columns
    out.write.parquet(str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert rows and all([r[k] for k in more] == list(more.values()) for r in rows)
    if name == "op8":
        assert out.columns[-2:] == ["token_ids_", "n_tokens_"] and all(r["n_tokens_"] == len(r["token_ids_"]) for r in rows)


def test_a_worker_drops_what_it_kept_for_another_operator():
    path, made = public_tokenizers.path(op8_sentencepiece.MODEL), []

    def run(batches):
        made.append(weakref.ref(op8_sentencepiece.Pieces.of(path)))
        yield from batches

    for _ in range(2):
        list(lean(run, path)([]))
    assert made[0]() is not None and made[0]() is made[1]()
    list(lean(op5_jaccard_join._documents(5, 80))([]))
    gc.collect()
    assert made[0]() is None


def test_a_lean_task_gives_the_rows_of_the_task():
    text = pa.array([" ".join(f"w{i * j}" for j in range(3000)) for i in range(300)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), text], names=["c", "text"])
    plain = pa.Table.from_batches(op5_jaccard_join._sets(5)([batch]))
    assert pa.Table.from_batches(lean(op5_jaccard_join._sets(5))([batch])).equals(plain)


def test_a_lean_task_that_fails_or_is_closed_passes_that_on():
    def run(batches):
        yield from batches
        raise ValueError("broken")

    with pytest.raises(ValueError, match="broken"):
        list(lean(run)([1, 2]))
    task = lean(run)([1, 2])
    assert next(task) == 1
    task.close()
