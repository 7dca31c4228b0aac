"""Toxicity: decoding, held-out accuracy, odd rows."""

import numpy as np
import pytest

from palisade.llm import op1_toxicity as op

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def fitted(spark):
    return op.fit(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"))


def test_language_model_is_a_distribution(fitted):
    lm = fitted[0]
    assert lm.shape == (op.SYMBOLS,) * 3 and np.allclose(np.exp(lm).sum(axis=2), 1, atol=1e-3)


def brute(model, word):
    """All readings of a word, scored one by one."""
    runs = []
    for c in word:
        if runs and runs[-1][0] == c:
            runs[-1][1] += 1
        else:
            runs.append([c, 1])
    paths = [(0.0, "")]
    for c, n in runs:
        readings = [(x, op.SWAP_COST) for x in op.LOOKALIKES.get(c, "")] + ([(c, 0.0)] if c.isalpha() else [])
        if not readings:
            continue
        edges = [(x, k + (op.DROP_COST if n > 1 else 0)) for x, k in readings] + [(x + x, 2 * k + (op.KEEP_REPEAT_COST if n > 2 else 0)) for x, k in readings if n > 1]
        paths = [(t + k, s + x) for t, s in paths for x, k in edges]

    def cost(t, s):
        a = b = 0
        for c in s:
            z = ord(c) - 96 if "a" <= c <= "z" else 27
            t -= float(model[a, b, z])
            a, b = b, z
        return t - float(model[a, b, 0])

    return min((cost(t, s), s) for t, s in paths)


@pytest.mark.parametrize("word", ["1d1ot", "st00pid", "l0$er", "heeello", "a11", "c1ow7", "m@@d"])
def test_viterbi_finds_the_cheapest_reading(fitted, word):
    assert op.Decoder(fitted[0]).restore(word) == brute(fitted[0], word)[1]


def test_evidence_of_disguised_words():
    uniform = np.full((op.SYMBOLS,) * 3, -np.log(op.SYMBOLS), np.float32)
    d = op.Decoder(uniform, {"loser": 5.0})
    assert d.evidence("a l0ser")[0] == 5.0 and d.evidence("you l o s e r there")[0] == 5.0 and d.evidence("lovely")[0] == 0.0 and d.evidence("")[:3] == (0, 0, 0)


@pytest.mark.parametrize(
    ("word", "text"),
    [
        ("loser", "a lo" + "o" * 40 + "ser"),
        ("loser", "l" * 50 + "0" * 50 + "ser"),
        ("loser*", " ".join("l0ser" + "abcdefghij" * 4)),
        ("fou", "un f o u là"),
        ("blöd", "so b l ö d"),
        ("schön", "so 5chön"),
        ("blöd", "so bl" + "ö" * 45 + "d"),
        ("señor", "5eñ0r"),
    ],
)
def test_evidence_of_every_form(word, text):
    uniform = np.full((op.SYMBOLS,) * 3, -np.log(op.SYMBOLS), np.float32)
    assert op.Decoder(uniform, {word: 5.0}).evidence(text)[0] == 5.0


def test_long_words_take_linear_time(fitted):
    d = op.Decoder(fitted[0])
    assert len(d.restore("ab4" * 30_000)) == 90_000 and len(d.restore("a" * 500_000)) <= 2


def test_held_out_rows(spark):
    rows = op.query(spark, DATA).toPandas()
    labels = spark.read.parquet(f"{DATA}/labels.parquet").toPandas()
    assert len(rows) == 1000 and rows.score.between(0, 1).all() and ((rows.score >= 0.3) == (rows.predicted == 1)).all()
    held = rows[rows.held_out].merge(labels, on="doc_id")
    assert (held.predicted == held.toxic).mean() >= 0.9
    assert held[held.toxic == 1].score.mean() > held[held.toxic == 0].score.mean() + 0.3


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1, 1), (4, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    rows = op.score(odd, labels).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows) and not [r for r in rows if r.doc_id is None][0].held_out
    assert op.score(empty, labels).count() == 0
    assert op.keep_clean(odd, labels).columns == odd.columns and op.keep_clean(odd, labels.where("false")).count() == 10
