"""Spelling variants against plain Python and against SQL."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from palisade.llm import op13_spellings as op13

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(words):
    by = defaultdict(list)
    keys = defaultdict(list)
    for w in words:
        for key in {(w[:i], w[i + 1 :]) for i in range(len(w))} | {(w[:i], w[i:]) for i in range(len(w) + 1)}:
            keys[key].append(w)
    for group in keys.values():
        for a in group:
            by[a] += [b for b in group if near(a, b)]
    forms = {}
    for w, n in words.items():
        best = min(((-words[x], x) for x in by[w]), default=None)
        forms[w] = best[1] if best and -best[0] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, forms[w], root, n, len(set(by[w])), words[forms[w]] if forms[w] else None))
    return sorted(out, key=str)


def made(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.mark.parametrize("seed, letters", [(1, "ab"), (2, "abc"), (3, "aeiouéÿ"), (4, "aab")])
def test_pairs_of_dense_words(spark, seed, letters):
    rnd = random.Random(seed)
    words = {"".join(rnd.choice(letters) for _ in range(rnd.randint(1, 8))): rnd.randint(3, 40) for _ in range(400)}
    assert got(op13.variants(made(spark, words))) == plain(words)


def test_one_letter_words_and_repeats(spark):
    words = {"a": 3, "b": 9, "aa": 20, "aaa": 50, "aaaa": 200, "aaaaaaab": 3, "aaaaaaaab": 6, "x" * 3000: 3, "x" * 3001: 7}
    assert got(op13.variants(made(spark, words))) == plain(words)


def test_long_chains(spark):
    """Each form's form is one edit further."""
    words = {"a" * (5 + i): 3 * 2**i for i in range(40)}
    out = op13.variants(made(spark, words)).collect()
    assert {r.root for r in out} == {"a" * 44} and sum(r.form is None for r in out) == 1


def test_light_edges(spark):
    rows = op13.light_edges(made(spark, {"abc": 1, "abd": 1, "ab": 1, "x": 1})).collect()
    assert sorted(map(tuple, rows)) == [("", "x", "a"), ("ab", "", "d"), ("ab", "c", "d")]


def test_checksums():
    rnd = random.Random(5)
    data = bytes(rnd.choices(range(256), k=5000))
    starts = np.array([rnd.randint(0, 4000) for _ in range(500)])
    sizes = np.array([rnd.choice([0, 1, 5, 47, 48, 49, 300]) for _ in range(500)])
    begun = np.array([zlib.crc32(str(i).encode()) for i in range(500)], np.uint32)
    want = [zlib.crc32(data[a : a + n], int(c)) for a, n, c in zip(starts, sizes, begun)]
    assert op13.checksums(np.frombuffer(data, np.uint8), starts, sizes, begun).tolist() == want


def test_words(spark, monkeypatch):
    monkeypatch.setattr(op13, "HELD", 50)
    monkeypatch.setattr(op13, "CHUNK_BYTES", 100)
    rnd = random.Random(6)
    some = ["".join(rnd.choice("abcÀéÿzZ") for _ in range(rnd.randint(1, 9))) for _ in range(60)]
    seps = [" ", "\n", "1", "日", "×-", "Ā", "¿", "'", "😀"]
    rows = [(rnd.choice([i, i, None]), rnd.choice([None, ""]) if i % 9 == 0 else "".join(rnd.choice(some) + rnd.choice(seps) for _ in range(rnd.randint(1, 400)))) for i in range(80)]
    rows += rows[:20]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.word: r.n for r in op13.vocabulary(frame).collect()} == plain_words(rows)


def test_odd_rows(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert got(op13.variants(op13.vocabulary(odd))) == plain(plain_words(rows))
    assert op13.variants(op13.vocabulary(empty)).count() == 0
    clash = odd.selectExpr("*", "1 as word", "2 as `a.b`", "3 as N")
    assert got(op13.variants(op13.vocabulary(clash))) == plain(plain_words(rows))


def test_query(spark, data):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{data}/documents.parquet'")
    out = got(op13.query(spark, data))
    assert out == sorted(con.execute(op13.SQL).fetchall(), key=str)
    assert out == plain(plain_words(con.execute("select doc_id, text from documents").fetchall()))
