"""Packing against the token library and against rules that any packing must keep."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from palisade.llm import op12_best_fit as op12


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(op12.MODEL))


def checked(rows, capacity):
    """The sequences, gapless and within capacity, by id."""
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return held


def test_cuts():
    assert op12.cuts(1, 10) == [(0, 1)] and op12.cuts(10, 10) == [(0, 10)]
    assert op12.cuts(11, 10) == [(0, 1), (1, 10)] and op12.cuts(30, 10) == [(0, 10), (10, 10), (20, 10)]


def test_bins_are_best_fit():
    """Against a plain search of all open bins."""
    rnd = random.Random(3)
    for most in (1, 3, 1000):
        bins, plain, number = op12.OpenBins(50, most), {}, 0
        for _ in range(3000):
            length = rnd.randint(1, 50)
            b, offset = bins.place(length)
            fits = [f for f in plain.values() if f >= length]
            if fits:
                assert plain[b] == min(fits) and offset == 50 - plain[b]
            else:
                assert b == number and offset == 0
                number += 1
                if len(plain) == most and length < 50:
                    fullest = min(plain.values())
                    gone = [x for x, f in plain.items() if f == fullest and x not in dict(bins.left())]
                    assert len(gone) == 1 or (plain[b] if b in plain else 50) == fullest
                    plain.pop(gone[0])
                plain[b] = 50
            plain[b] -= length
            if not plain[b]:
                plain.pop(b)
            assert dict(bins.left()) == {x: 50 - f for x, f in plain.items()} and bins.n_open <= most


@pytest.mark.parametrize("shares", [1, 3, 20])
def test_pack(spark, shares):
    rnd = random.Random(shares)
    n = [rnd.choice([1, 7, rnd.randint(1, 100), rnd.randint(40, 64)]) for _ in range(3000)]
    rows = spark.createDataFrame([(i % 2900, 0, 0, x, 5) for i, x in enumerate(n)], op12.PIECE)
    rows = rows.where("length <= 100").repartition(4)
    out = op12.pack(rows, capacity=100, most=64, window=128, shares=shares).collect()
    assert sorted((r.doc_id, r.length) for r in out) == sorted((i % 2900, x) for i, x in enumerate(n))
    held = checked(out, 100)
    assert len(held) <= 1.03 * max(sum(n) / 100, sum(x > 50 for x in n)) + 2
    again = op12.pack(rows.repartition(7), capacity=100, most=64, window=128, shares=shares).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))


def test_documents(spark, odd, empty, library):
    rows = op12.pack(op12.pieces(odd, 512), 512).collect()
    checked(rows, 512)
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    texts = defaultdict(list)
    for r in odd.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [0]
        texts[r.doc_id] += [(i, a, n, zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes())) for i, (a, n) in enumerate(op12.cuts(len(ids), 512))]
    assert by.keys() == texts.keys()
    for key, want in texts.items():
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by[key]) == sorted(want)
    assert op12.pack(op12.pieces(empty)).count() == 0


def test_query(spark, data):
    out = op12.query(spark, data).collect()
    held = checked(out, op12.CAPACITY)
    total = sum(r.length for r in out)
    assert len(held) <= 1.01 * total / op12.CAPACITY + 1
