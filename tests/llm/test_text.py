"""Kernels against plain Python."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from palisade.llm import _text
from palisade.llm._rtree import CountTree


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\t\nZ9-", max_size=30)), max_size=8), st.sampled_from([3, 7, 1 << 20]))
def test_words(texts, chunk):
    old, _text.CHUNK_BYTES = _text.CHUNK_BYTES, chunk
    try:
        data, off = _text.buffers(pa.array(texts, pa.string()))
        starts, ends, h, at = _text.hash_words(data, off, _text.NON_BLANK)
    finally:
        _text.CHUNK_BYTES = old
    raw = data.tobytes()
    want = [[w.encode() for w in (t or "").split()] for t in texts]
    got = [[raw[a:b] for a, b in zip(starts[i:j], ends[i:j])] for i, j in zip(at, at[1:])]
    assert got == want
    flat = [w for t in want for w in t]
    assert len(set(h.tolist())) == len(set(flat)) and all((h[i] == h[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(i))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=30), st.integers(1, 6))
def test_windows(values, k):
    w = _text.windows(np.array(values, np.uint64), k)
    n = max(len(values) - k + 1, 0)
    assert len(w) == n
    for i in range(n):
        for j in range(i):
            assert (w[i] == w[j]) == (values[i : i + k] == values[j : j + k])


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 80))
def test_tree_loses_no_pair(seed, n):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1000, (max(1, n // 4), 30))
    sets = [frozenset(np.where(rng.random(30) < 0.05, rng.integers(0, 1000, 30), base[i % len(base)]).tolist()) for i in range(n)]
    points = np.array([np.bincount(np.array(sorted(s)) % 8, minlength=8) for s in sets], np.uint8)
    tree = CountTree(points, np.array([len(s) for s in sets]), 85)
    for i, a in enumerate(sets):
        hit = set(tree.search(points[i], len(a)).tolist())
        assert {j for j, b in enumerate(sets) if 100 * len(a & b) >= 85 * len(a | b)} <= hit
