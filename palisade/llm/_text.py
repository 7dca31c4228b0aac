"""Columnar text kernels over Arrow buffers, shared by the text operators.

All kernels work on UTF-8 bytes: the word classes used here only ever tell
ASCII bytes apart, and every byte of a non-ASCII character is a word byte, so
byte boundaries and character boundaries agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at once by the vectorised kernels; bounds the scratch memory.
CHUNK_BYTES = 2 << 20

#: Words are what is not blank: everything but space and tab..carriage return.
NON_BLANK = np.ones(256, bool)
NON_BLANK[[0x20, *range(0x09, 0x0E)]] = False

#: Words of letters and digits: ASCII alphanumerics and all non-ASCII bytes.
ALNUM = np.zeros(256, bool)
for _lo, _hi in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    ALNUM[_lo : _hi + 1] = True

#: Lower-cases A-Z and leaves all other bytes alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_rng = np.random.default_rng(0x5EED)
_BYTE_KEY = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_POS_KEY = _rng.integers(0, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _pos_key(n: int) -> np.ndarray:
    """Odd 64-bit keys for positions below n; the same for every caller."""
    global _POS_KEY
    while len(_POS_KEY) < n:
        more = mix(np.arange(len(_POS_KEY), 2 * len(_POS_KEY), dtype=np.uint64))
        _POS_KEY = np.concatenate([_POS_KEY, more | np.uint64(1)])
    return _POS_KEY


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection that spreads all bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes each; one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def _spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mask = is_word[data]
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1]
    last[:-1] &= ~mask[1:]
    at = offsets[:-1][offsets[1:] > offsets[:-1]]
    first[at] = mask[at]
    at = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    last[at] = mask[at]
    return np.flatnonzero(first), np.flatnonzero(last) + 1, mask


def hash_words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, fold: np.ndarray | None = None):
    """(starts, ends, hashes, per-row word offsets) of the words of rows.

    Hashes have 64 bits and depend on the bytes alone, after ``fold`` if given.
    Rows beyond ``CHUNK_BYTES`` are cut at blanks, so scratch memory is bounded
    by the longest word rather than by the longest row.
    """
    parts = []
    i, n = 0, len(data)
    while i < n:
        j = min(i + CHUNK_BYTES, n)
        while j < n and is_word[data[j]] and is_word[data[j - 1]]:
            step = np.flatnonzero(~is_word[data[j : j + 65536]])
            j = j + int(step[0]) if len(step) else min(j + 65536, n)
        lo, hi = np.searchsorted(offsets, i, side="right") - 1, np.searchsorted(offsets, j, side="left")
        cut = np.clip(offsets[lo : hi + 1], i, j) - i
        piece = data[i:j]
        starts, ends, mask = _spans(piece, cut, is_word)
        if len(starts):
            body = piece[mask]
            if fold is not None:
                body = fold[body]
            size = ends - starts
            at = np.cumsum(size) - size
            pos = np.arange(len(body)) - np.repeat(at, size)
            with np.errstate(over="ignore"):
                h = np.add.reduceat(_BYTE_KEY[body] * _pos_key(int(size.max()))[pos], at)
                h = mix(h + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            parts.append((starts + i, ends + i, h))
        i = j
    if not parts:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    starts, ends, h = (np.concatenate(x) for x in zip(*parts, strict=True))
    return starts, ends, h, np.searchsorted(starts, offsets, side="left")


def windows(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hashes of all k consecutive word hashes (k - 1 fewer than words).

    A window's hash is an order-sensitive wrap-around sum, so a window of any
    length costs one prefix sum: the weights are powers of an odd constant and
    are divided out by its inverse.
    """
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = _powers(len(h) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h + np.uint64(salt)) * base[: len(h)])])
        return mix((total[k:] - total[:n]) * _inverse_powers(n)[:n] + np.uint64(k))


_B = 0x5851F42D4C957F2D
_B_INV = pow(_B, -1, 1 << 64)
_pow = {True: np.ones(1, np.uint64), False: np.ones(1, np.uint64)}


def _grown(key: bool, b: int, n: int) -> np.ndarray:
    p = _pow[key]
    if len(p) < n:
        size = max(n, 1 << 16)
        p = np.full(size, b, np.uint64)
        p[0] = 1
        with np.errstate(over="ignore"):
            p = np.cumprod(p)
        _pow[key] = p
    return p


def _powers(n: int) -> np.ndarray:
    return _grown(True, _B, n)


def _inverse_powers(n: int) -> np.ndarray:
    return _grown(False, _B_INV, n)


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's BIGINT."""
    return x.view(np.int64)
