"""Byte-level BPE over Arrow batches: each distinct pre-token is encoded once.

The tokenizer splits a text into pre-tokens and merges within each of them, so
the ids of a text are those of its pre-tokens in turn.  Pre-token borders are
found for a whole batch at once from character classes; the library's own model
merges every pre-token that a worker has not met before.  Pieces that hold a
special string, or a character whose class depends on the Unicode version, go
to the library whole, and so does every text where the file asks for another
normaliser or split than the ones known here.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np

from palisade.llm._text import _pos_key, mix

#: UTF-8 bytes encoded at once; longer texts are cut at safe borders.
CHUNK_BYTES = 1 << 19
#: Distinct pre-tokens kept by a worker; beyond it the memory starts anew.
CACHE_SIZE = 1 << 20

_SPACE, _BLANK, _LETTER, _DIGIT, _OTHER, _SEP, _ODD = range(7)
_SEPARATOR = "\U0010ffff"
#: Where a pre-token always begins: at a blank after something else, and between letters, digits and marks.
_SAFE = re.compile(r"(?<=\S)[ \n]|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z0-9])(?=[!-/:-@\[-`{-~])|(?<=[^\W_])(?=[\u3001\u3002\uff01\uff0c\uff0e\uff1f])")
#: The same where characters or strings of unknown kind are about.
_SAFEST = re.compile(r"(?<=[!-~])[ \n]")
#: The byte-level alphabet: printable bytes stand for themselves, the others for what follows U+0100.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_CHAR = np.zeros(256, np.uint32)
_BYTE_CHAR[_PRINTABLE] = _PRINTABLE
_BYTE_CHAR[_BYTE_CHAR == 0] = 0x100 + np.arange(256 - len(_PRINTABLE))


def _class_table() -> np.ndarray:
    """The classes the split pattern tells apart, for each code point."""
    kinds = {"L": _LETTER, "N": _DIGIT}
    old = unicodedata.ucd_3_2_0.category
    table = np.full(0x110000, _OTHER, np.uint8)
    for c in range(0x110000):
        ch = chr(c)
        now = kinds.get(unicodedata.category(ch)[0], _OTHER)
        if now != kinds.get(old(ch)[0], _OTHER):
            now = _ODD
        table[c] = now
    table[[*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _BLANK
    table[[*range(0x1C, 0x20), 0x180E]] = _ODD
    table[0xD800:0xE000] = _ODD
    table[0x20] = _SPACE
    table[0x10FFFF] = _SEP
    return table


def safe_pieces(text: str, limit: int = CHUNK_BYTES, safe: re.Pattern = _SAFE) -> list[str]:
    """The text in pieces of about ``limit`` characters, cut where pre-tokens begin."""
    out, at = [], 0
    while len(text) - at > limit:
        m = safe.search(text, at + limit)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.start()
    out.append(text[at:])
    return out


class _Slots:
    """Numbers of 64-bit keys in the order in which they were added: open addressing, for whole arrays."""

    def __init__(self, size: int = 1 << 16):
        self.key, self.slot, self.n = np.zeros(size, np.uint64), np.full(size, -1, np.int32), 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where there is none."""
        mask = np.uint64(len(self.slot) - 1)
        out = np.full(len(keys), -1, np.int32)
        todo, at = None, (keys & mask).astype(np.int64)
        while len(keys):
            slot = self.slot[at]
            hit = self.key[at] == keys
            if todo is None:
                out = np.where(hit, slot, -1)
                todo = np.flatnonzero((slot >= 0) & ~hit)
                keys, at = keys[todo], (at[todo] + 1) & int(mask)
                continue
            out[todo[hit]] = slot[hit]
            go = (slot >= 0) & ~hit
            todo, keys, at = todo[go], keys[go], (at[go] + 1) & int(mask)
        return out

    def add(self, keys: np.ndarray) -> None:
        """Number distinct new keys in turn."""
        if 2 * (self.n + len(keys)) > len(self.slot):
            held = self.key[self.slot >= 0][np.argsort(self.slot[self.slot >= 0])]
            self.__init__(1 << int(4 * (self.n + len(keys))).bit_length())
            self.add(held)
        number = np.arange(self.n, self.n + len(keys), dtype=np.int32)
        self.n += len(keys)
        mask = len(self.slot) - 1
        at = (keys & np.uint64(mask)).astype(np.int64)
        while len(keys):
            free = np.flatnonzero(self.slot[at] < 0)
            place, first = np.unique(at[free], return_index=True)
            first = free[first]
            self.slot[place], self.key[place] = number[first], keys[first]
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, number, at = keys[left], number[left], (at[left] + 1) & mask


def _known(path: str) -> bool:
    """Whether the file asks for byte-level BPE with the split that ``Encoder.borders`` finds."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split, model = spec["pre_tokenizer"] or {}, spec["model"]
    odd = [model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")]
    plain = all(not any(t[x] for x in ("single_word", "lstrip", "rstrip", "normalized")) and not re.search(r"\s", t["content"]) for t in spec["added_tokens"])
    return model.get("type") == "BPE" and not any(odd) and plain and not spec["normalizer"] and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"]


class Encoder:
    """Counts or ids of texts by the tokenizers library; one for each worker and file."""

    _made: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.known = _known(path)
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.model = self.library.model
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.classes = _class_table()
        self.keys = mix(np.arange(1, 0x110001, dtype=np.uint64))
        self._reset()

    def _reset(self) -> None:
        self.slots = _Slots()
        self.count = np.zeros(1024, np.int64)
        self.offset = np.zeros(1024, np.int64)
        self.pool = np.zeros(4096, np.uint32)
        self.used = 0

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, keys: np.ndarray, strings: list[str]) -> None:
        """Remember the ids of new pre-tokens, as the library's model merges them."""
        joined = "".join(strings)
        sizes = np.array([*map(len, strings)] if joined.isascii() else [len(s.encode()) for s in strings], np.int64)
        chars = _BYTE_CHAR[np.frombuffer(joined.encode(), np.uint8)].tobytes().decode("utf-32-le")
        ends = np.cumsum(sizes)
        tokenize = self.model.tokenize
        got = [[t.id for t in tokenize(chars[a:b])] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
        counts = np.array([*map(len, got)], np.int64)
        flat = np.fromiter(chain.from_iterable(got), np.uint32, int(counts.sum()))
        first, last = self.slots.n, self.slots.n + len(counts)
        while last > len(self.count):
            self.count, self.offset = (np.concatenate([x, np.zeros_like(x)]) for x in (self.count, self.offset))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.count[first:last], self.offset[first:last] = counts, self.used + np.cumsum(counts) - counts
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.slots.add(keys)

    def borders(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of pre-tokens (each separator is one too) and the classes of all characters."""
        cls = self.classes[codes]
        run = np.maximum(cls, _BLANK)
        n = len(codes)
        start = np.ones(n, bool)
        start[1:] = run[1:] != run[:-1]
        start[cls == _SEP] = True
        solid = (run != _BLANK) & (cls != _SEP)
        # The last blank before something solid stands alone, or joins it if it is a space.
        last = np.flatnonzero((run[:-1] == _BLANK) & solid[1:])
        start[last] = True
        start[last[cls[last] == _SPACE] + 1] = False
        # Contractions: a lone apostrophe that begins a pre-token, and letters.
        mark = np.flatnonzero((codes[:-1] == 0x27) & start[:-1] & (cls[1:] == _LETTER))
        if len(mark):
            a = codes[mark + 1]
            b = np.where(mark + 2 < n, codes[np.minimum(mark + 2, n - 1)], 0)
            one = np.isin(a, [ord(x) for x in "stmd"])
            two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
            size = np.where(one, 1, np.where(two, 2, 0))
            mark, size = mark[size > 0], size[size > 0]
            start[mark + 1] = False
            after = mark + 1 + size
            ok = after < n
            after = after[ok]
            start[after[cls[after] == _LETTER]] = True
        return np.flatnonzero(start), cls

    def _chunk(self, texts: list[str], want_ids: bool) -> tuple[np.ndarray, np.ndarray | None]:
        joined = _SEPARATOR.join(texts)
        if not joined:
            return np.zeros(len(texts), np.int64), np.zeros(0, np.uint32)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts, cls = self.borders(codes)
        size = np.diff(np.append(starts, len(codes)))
        is_sep = cls[starts] == _SEP
        if self.slots.n > CACHE_SIZE:
            self._reset()
        pos = np.arange(len(codes)) - np.repeat(starts, size)
        with np.errstate(over="ignore"):
            h = np.add.reduceat(self.keys[codes] * _pos_key(int(size.max()))[pos], starts)
            h = mix(h + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        rows = np.cumsum(is_sep)[~is_sep]
        starts, size, h = starts[~is_sep], size[~is_sep], h[~is_sep]
        slot = self.slots.find(h)
        new = np.flatnonzero(slot < 0)
        if len(new):
            keys, first = np.unique(h[new], return_index=True)
            at = new[first]
            self._add(keys, [joined[a : a + n] for a, n in zip(starts[at].tolist(), size[at].tolist(), strict=True)])
            slot[new] = self.slots.find(h[new])
        counts = self.count[slot]
        per_row = np.bincount(rows, counts, minlength=len(texts)).astype(np.int64)
        ids = None
        if want_ids:
            begin = np.cumsum(counts) - counts
            ids = self.pool[np.repeat(self.offset[slot] - begin, counts) + np.arange(int(counts.sum()))]
        return per_row, ids

    def _slow(self, texts: list[str], want_ids: bool) -> tuple[np.ndarray, np.ndarray | None]:
        ids = self._whole(texts)
        return np.array([len(x) for x in ids], np.int64), (np.concatenate(ids) if ids else np.zeros(0, np.uint32)) if want_ids else None

    def _plain(self, text: str) -> bool:
        """Whether borders can be found without the library."""
        if not self.known or any(s in text for s in self.special):
            return False
        if text.isascii():
            return not re.search("[\x1c-\x1f]", text)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return not np.isin(self.classes[codes], (_ODD, _SEP)).any()

    def encode(self, texts: list[str], want_ids: bool = True) -> Iterator[tuple[int, np.ndarray | None]]:
        """(count, ids) of each text, in order.  About ``CHUNK_BYTES`` are handled at once."""
        batch: list[str] = []
        owners: list[int] = []
        done: dict[int, list] = {}
        emitted = size = 0

        def flush() -> None:
            # Most chunks are plain as a whole.
            plain = self._plain("".join(batch))
            marks = None if plain else [self._plain(x) for x in batch]
            for part, own in [(batch, owners)] if plain else [([x], [o]) for x, o in zip(batch, owners, strict=True)]:
                ok = plain or marks.pop(0)
                counts, ids = self._chunk(part, want_ids) if ok else self._slow(part, want_ids)
                ends = np.cumsum(counts)
                for o, n, e in zip(own, counts.tolist(), ends.tolist(), strict=True):
                    have = done.setdefault(o, [0, []])
                    have[0] += n
                    if want_ids:
                        have[1].append(ids[e - n : e])
            batch.clear()
            owners.clear()

        def ready(before: int) -> Iterator[tuple[int, np.ndarray | None]]:
            nonlocal emitted
            while emitted in done and emitted < before:
                n, parts = done.pop(emitted)
                yield n, (parts[0] if len(parts) == 1 else np.concatenate(parts)) if want_ids else None
                emitted += 1

        for i, text in enumerate(texts):
            pieces = [text]
            if len(text) > CHUNK_BYTES:
                pieces = safe_pieces(text, safe=_SAFE if self._plain(text) else _SAFEST) if self.known else pieces
            for piece in pieces:
                batch.append(piece)
                owners.append(i)
                size += len(piece) if piece.isascii() else len(piece.encode("utf-8", "surrogatepass"))
                if size >= CHUNK_BYTES:
                    flush()
                    size = 0
                    yield from ready(i)
        if batch:
            flush()
        yield from ready(len(texts))
