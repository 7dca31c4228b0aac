"""Token stores, counts and the streaming search against the libraries."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from palisade.llm import _bpe
from palisade.llm import op7_token_store as op7
from palisade.llm import op8_sentencepiece as op8
from palisade.llm import op9_token_counts as op9

ALPHABET = [*"ab'strevlmd '  \n\t.,!1 2é日 　😀́Ⅷ\x1c᠎<|>▁", "<|endoftext|>", "'s", "'re", "'ll ", " " * 9, "日本", "the ", "ing"]


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(1)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 40))) for _ in range(3000)] + ["", "x" * 3000, " " * 2000 + "a", " a" * 4000, "日本語" * 300, "thethe" * 300]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(op7.MODEL))


@pytest.mark.parametrize("limit", [1 << 19, 40, 3])
def test_byte_level_ids(texts, library, limit, monkeypatch):
    monkeypatch.setattr(_bpe, "CHUNK_BYTES", limit)
    monkeypatch.setattr(_bpe.safe_pieces, "__defaults__", (limit, _bpe._SAFE))
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    encoder = _bpe.Encoder.of(public_tokenizers.path(op7.MODEL))
    assert [x[1].tolist() for x in encoder.encode(texts)] == want
    assert [x[0] for x in encoder.encode(texts, want_ids=False)] == [len(x) for x in want]


def test_slots_number_keys():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 2**64, 5000, dtype=np.uint64))
    keys = np.unique(np.concatenate([keys, np.arange(1, 200, dtype=np.uint64) << np.uint64(40)]))
    rng.shuffle(keys)
    slots = _bpe._Slots(16)
    for part in np.array_split(keys[:4000], 7):
        slots.add(part)
    assert (slots.find(keys[:4000]) == np.arange(4000)).all() and (slots.find(keys[4000:]) == -1).all()


def test_another_split_goes_to_the_library(texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    assert [x[1].tolist() for x in _bpe.Encoder.of(path).encode(texts[:500])] == [x.ids for x in library.encode_batch(texts[:500], add_special_tokens=False)]


@pytest.mark.parametrize("text", ["ab1" * 700_000, "日本。" * 300_000, "ab,<|endoftext|>" * 100_000, "x\x1cy z" * 300_000])
def test_long_texts_are_cut(text, library):
    safe = _bpe._SAFE if _bpe.Encoder.of(public_tokenizers.path(op7.MODEL))._plain(text) else _bpe._SAFEST
    pieces = _bpe.safe_pieces(text, safe=safe)
    assert "".join(pieces) == text and (len(pieces) > 1) == ("<" not in text)
    got = next(iter(_bpe.Encoder.of(public_tokenizers.path(op7.MODEL)).encode([text])))[1]
    assert got.tolist() == library.encode(text, add_special_tokens=False).ids


def test_search_gives_the_library_ids(texts):
    import sentencepiece

    path = public_tokenizers.path(op8.MODEL)
    library, pieces = sentencepiece.SentencePieceProcessor(model_file=path), op8.Pieces.of(path)
    for t in texts:
        ids = pieces.encode(t)
        assert ids == library.encode(t) and pieces.decode(ids) == library.decode(ids) == t.replace("▁", " "), t


def test_search_commits_early():
    pieces = op8.Pieces.of(public_tokenizers.path(op8.MODEL))
    out = pieces.stream("ab" * 5000)
    next(out)
    assert "".join(pieces.stream("ab" * 5000)) == "ab" * 5000


@pytest.mark.parametrize("seed", range(10))
def test_blocks_round_trip(seed):
    rng = np.random.default_rng(seed)
    ids = np.where(rng.random(5000) < 0.05, rng.integers(0, 2**32, 5000), rng.integers(7, min(7 + 10**seed, 2**32), 5000)).astype(np.uint32)
    for n in (0, 1, 255, 256, 257, 5000):
        seg = op7.Segment(op7.pack_segment([None, 5], [n // 2, n - n // 2], ids[:n]))
        assert (seg.ids() == ids[:n]).all() and seg.doc_ids == [None, 5] and (seg.ids(100, 700) == ids[:n][100:700]).all()


def test_store(spark, odd, empty, library, monkeypatch, tmp_path):
    monkeypatch.setattr(op7, "SEGMENT_IDS", 5000)
    op7.write_store(odd, str(tmp_path / "s"), shards=3)
    rows = op7.read_store(spark, str(tmp_path / "s")).collect()
    assert len(rows) == 10
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids[-1] == op7.END_ID and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    texts = sorted(((-1 if r.doc_id is None else r.doc_id), r.text or "") for r in odd.collect())
    assert sorted(r.ids[:-1] for r in rows) == sorted(library.encode(t, add_special_tokens=False).ids for _, t in texts)
    assert [(-1 if r.doc_id is None else r.doc_id) for r in sorted(rows, key=lambda r: r.start)] == [i for i, _ in texts]
    op7.write_store(empty, str(tmp_path / "e"))
    assert op7.read_store(spark, str(tmp_path / "e")).count() == 0


def test_counts(odd, empty, library):
    for r, t in zip(op9.count_tokens(odd).collect(), odd.collect()):
        n = len(library.encode(t.text or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((t.text or "").encode()), n, n > 512)
    assert op9.count_tokens(empty).count() == 0


def test_encoded_rows(odd, empty):
    rows = op8.encode(odd).collect()
    assert len(rows) == 10 and op8.encode(odd).columns == [*odd.columns, "token_ids", "n_tokens"]
    assert all(r.n_tokens == len(r.token_ids) for r in rows) and [r.text for r in rows] == [r.text for r in odd.collect()]
    assert op8.report(empty).count() == 0 and all(r.round_trip for r in op8.report(odd).collect())
