"""Decontamination against brute force."""

import hashlib
import pickle
import random
import tracemalloc

import pytest

from palisade.llm import op4_decontaminate as op


def brute(doc, items, window=op.WINDOW):
    hit, seen = set(), set()
    for item_id, words in items:
        k = min(window, len(words))
        for i in range(len(words) - k + 1 if k else 0):
            for j in range(len(doc) - k + 1):
                if doc[j : j + k] == words[i : i + k]:
                    hit |= set(range(j, j + k))
                    seen.add(str(item_id))
    return len(hit), sorted(seen)


@pytest.mark.parametrize("window", [1, 2, 3, 5])
def test_automaton(window):
    rnd = random.Random(window)
    for _ in range(400):
        items = [(i, [rnd.choice([b"a", b"b", b"c"]) for _ in range(rnd.randint(0, 8))]) for i in range(rnd.randint(0, 5))]
        doc = [rnd.choice([b"a", b"b", b"c", b"d"]) for _ in range(rnd.randint(0, 25))]
        sam = op.SuffixAutomaton(items, window)
        runs, seen = sam.scan(doc)
        assert (sum(b - a for a, b, _ in runs), sorted(sam.items[i] for i in seen)) == brute(doc, items, window)
        assert all(b - a <= longest or longest >= 1 for a, b, longest in runs) and all(x[1] < y[0] for x, y in zip(runs, runs[1:]))


def test_blocks_give_the_same(spark):
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 40))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 9)))) for i in range(12)], "item_id long, text string")
    key = lambda d: sorted(tuple(r)[:6] for r in d.collect())
    whole = key(op.report(docs, bench, window=5))
    assert whole == key(op.report(docs, bench, window=5, block_words=10))
    items = [(r.item_id, op.words(r.text)) for r in bench.collect()]
    for doc_id, n_words, n_hit, n_items, sha, bad in whole:
        n, seen = brute(op.words(texts[doc_id]), items, 5)
        assert (n_words, n_hit, n_items, sha, bad) == (len(op.words(texts[doc_id])), n, len(seen), hashlib.sha256(",".join(seen).encode()).hexdigest(), n > 0 and 20 * n >= n_words)


def test_words_and_cleaning(spark):
    assert op.words("Añ-B_c 9é!") == ["añ".encode(), b"b", b"c", "9é".encode()] and op.words(None) == []
    bench = spark.createDataFrame([(1, "one two three"), (2, None), (3, "!!")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x ONE,two Three y", 1), (2, "one two", 2), (3, None, 3)], "doc_id long, text string, runs int")
    assert [r.doc_id for r in op.clean(docs, bench).orderBy("doc_id").collect()] == [2, 3]
    assert op.remove_spans(docs, bench, max_run=3).orderBy("doc_id").first().text == "x  y"
    assert op.remove_spans(docs, bench, max_run=4).orderBy("doc_id").first().text == "x ONE,two Three y"
    assert [op.remove_spans(docs, bench, 3, share).orderBy("doc_id").first().text for share in (0.5, 0.6)] == ["x  y", "x ONE,two Three y"]


def test_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    rows = op.report(odd, bench).collect()
    assert len(rows) == 10 and sum(r.contaminated for r in rows) == 2
    assert op.report(empty, bench).count() == 0 and op.report(odd, bench.where("false")).where("n_hit > 0").count() == 0
    assert op.clean(odd, bench).count() == 8


def test_odd_rows_and_repeated_items_in_blocks(spark, odd):
    bench = spark.createDataFrame([(1, "one two three"), (1, "one two three"), (2, "text of that id"), (3, "no id at all here"), (1, "one two")], "item_id long, text string")
    more = odd.unionByName(odd.where("doc_id is null")).unionByName(spark.createDataFrame([(None, "one two three of null", "en", "s", 21, "x")], odd.schema))
    key = lambda d: sorted((tuple(r) for r in d.collect()), key=repr)
    whole = key(op.report(more, bench))
    assert len(whole) == 12 and whole == key(op.report(more, bench, block_words=3))
    one = hashlib.sha256(b"1").hexdigest()
    assert sorted(((r[0] or -1), r[2], r[3]) for r in whole if r[5]) == [(-1, 3, 1), (-1, 5, 1), (-1, 5, 1), (4, 3, 1), (4, 3, 1), (4, 4, 1)]
    assert {r[4] for r in whole if r[0] == 4 and r[2] == 3} == {one}
    names = [c.name for c in more.schema]
    clash = more.withColumnRenamed("score", "runs").withColumnRenamed("source", "items")
    for f in (op.clean, op.remove_spans):
        one_pass, many = f(more, bench), f(clash, bench, block_words=3)
        assert one_pass.columns == names and many.columns == clash.columns and key(one_pass) == key(many)


def test_memory_of_the_automaton():
    rnd = random.Random(3)
    items = [(i, [b"w%d" % int(rnd.paretovariate(0.5)) for _ in range(40)]) for i in range(1000)]
    raw = pickle.dumps(op.SuffixAutomaton(items))
    tracemalloc.start()
    held = pickle.loads(raw)
    used = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert used < 200 * 40_000 and held.items[-1] == "999"
