"""Token ids of whole texts by a public tokenizer of the word-end BPE kind, many words at once.

The tokenizer file gives the vocabulary and the merges. Ordinary Latin text is cut into pieces
over its bytes, and equal pieces are found by their hashes (64 bits; pieces have at most `LONG`
bytes); no Python string is made per word. A table of `KNOWN` pieces at most keeps the ids of those
met first; others are merged together in numpy, a merge of each per step, which gives what the
tokenizers library gives for them at a fraction of its cost. A text with any other character (or
with what could be a special token) goes to the library whole, and so does each longer piece.
"""

from __future__ import annotations

import json
import re

import numpy as np
from tokenizers import Tokenizer

from typeloom.llm import bytewords as bw

#: Pieces in a worker's table at most; it is kept when it is full.
KNOWN = 600_000
#: Longer pieces are left to the library, whose cost for them is not quadratic.
LONG = 48

#: Characters of which normalisation, lower case and class are plain: ASCII, Latin-1 and Latin Extended-A, without dotted capital I, controls and compatibility digits and letters.
_OTHER = re.compile(r"[^\t\n\x0b\x0c\r -~¡-©«¬®-±´¶-¸»¿-įı-ſ]|<\|")
#: Classes of bytes. Of the two-byte characters above, those of lead byte 0xC2 and two of 0xC3 are signs, the others letters.
_SPACE, _LETTER, _DIGIT, _SIGN = range(4)
_CLASS = np.full(256, _SIGN, np.uint8)
_CLASS[bw.SPACE] = _SPACE
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[0xC3:0xC6] = _LETTER
#: What the tokenizer file cuts off after an apostrophe that no sign stands before.
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def piece_starts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a piece begins in lower-cased text, and the class of each byte: runs of letters, single digits, runs of signs, and the endings after an apostrophe."""
    kind = _CLASS[data]
    later = (data & 0xC0) == 0x80
    kind[1:][later[1:]] = kind[:-1][later[1:]]
    sign = np.flatnonzero((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
    kind[sign] = kind[sign + 1] = _SIGN
    start = kind != _SPACE
    start[1:] &= (kind[1:] != kind[:-1]) | ((kind[1:] == _DIGIT) & ~later[1:])
    at = np.flatnonzero((data == 39) & start)
    for ending in _ENDINGS:
        n = len(ending)
        hit = at[at + n < len(data)]
        for k, letter in enumerate(ending.encode(), 1):
            hit = hit[data[hit + k] == letter]
        start[hit + 1] = False
        after = hit[hit + n + 1 < len(data)] + n + 1
        start[after[kind[after] == _LETTER]] = True
    return np.flatnonzero(start), kind


def byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte: printable ones as they are, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(odd)}


class WordBpe:
    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()
        self.first = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[letters[b] + suffix] for b in range(256)], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.none = len(merges)
        self.merged = np.array([vocab[a + b] for a, b in merges] + [0], np.int64)
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in merges], np.int64)
        # An open table: a key sits in the first free slot from its own on.
        self.bits = 19
        self.table_key, self.table_rank = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, self.none, np.int64)
        slots, mask = self._slot(keys).tolist(), (1 << self.bits) - 1
        for rank, (key, slot) in enumerate(zip(keys.tolist(), slots, strict=True)):
            while self.table_key[slot] not in (-1, key):
                slot = (slot + 1) & mask
            if self.table_key[slot] == -1:
                self.table_key[slot], self.table_rank[slot] = key, rank
        self.known = np.zeros(0, np.uint64)
        self.begin, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _rank(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found = self.table_key[slot]
        rank = np.where(found == keys, self.table_rank[slot], self.none)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            found = self.table_key[slot[open_]]
            same = found == keys[open_]
            rank[open_[same]] = self.table_rank[slot[open_[same]]]
            open_ = open_[~same & (found != -1)]
        return rank

    def merge(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of non-empty pieces laid end to end in `raw`, and how many each piece has."""
        sym, word = self.first[raw], np.repeat(np.arange(len(sizes)), sizes)
        ends = np.cumsum(sizes) - 1
        sym[ends] = self.last[raw[ends]]
        done_sym, done_word = [], []
        while len(sym):
            rank = np.full(len(sym), self.none, np.int64)
            rank[:-1] = self._rank(sym[:-1] << 16 | sym[1:])
            same = np.zeros(len(sym), bool)
            same[:-1] = word[:-1] == word[1:]
            rank[~same] = self.none
            begin = np.flatnonzero(np.concatenate([[True], ~same[:-1]]))
            best = np.minimum.reduceat(rank, begin)
            over = np.repeat(best == self.none, np.diff(begin, append=len(sym)))
            done_sym.append(sym[over])
            done_word.append(word[over])
            at = np.flatnonzero((rank == np.repeat(best, np.diff(begin, append=len(sym)))) & ~over)
            at = at[np.concatenate([[True], word[at[1:]] != word[at[:-1]]])] if len(at) else at
            sym[at] = self.merged[rank[at]]
            keep = ~over
            keep[at + 1] = False
            sym, word = sym[keep], word[keep]
        all_word = np.concatenate(done_word)
        order = np.argsort(all_word, kind="stable")
        return np.concatenate(done_sym)[order].astype(np.uint32), np.bincount(all_word, minlength=len(sizes))

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def _ids(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after another, and how many each has."""
        h, first, inverse = np.unique(bw.span_hashes(data, s, e), return_index=True, return_inverse=True)
        s, e = s[first], e[first]
        at = np.minimum(np.searchsorted(self.known, h), max(0, len(self.known) - 1))
        old = self.known[at] == h if len(self.known) else np.zeros(len(h), bool)
        begin, count = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        begin[old], count[old] = self.begin[at[old]], self.count[at[old]]
        fresh = np.flatnonzero(~old & (e - s <= LONG))
        pool, base = [self.pool], len(self.pool)
        if len(fresh):
            ids, n = self.merge(data[spread(s[fresh], e[fresh] - s[fresh])], e[fresh] - s[fresh])
            begin[fresh], count[fresh] = base + np.cumsum(n) - n, n
            pool.append(ids)
            base += len(ids)
            if len(self.known) + len(fresh) <= KNOWN:
                place = np.searchsorted(self.known, h[fresh])
                self.begin, self.count = np.insert(self.begin, place, begin[fresh]), np.insert(self.count, place, n)
                self.known = np.insert(self.known, place, h[fresh])
                self.pool = np.concatenate(pool)
        for i in np.flatnonzero(~old & (e - s > LONG)).tolist():
            ids = self._library(data[s[i] : e[i]].tobytes().decode())
            begin[i], count[i] = base, len(ids)
            pool.append(ids)
            base += len(ids)
        begin, count = begin[inverse], count[inverse]
        return np.concatenate(pool)[spread(begin, count)], count

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers; a null text has none."""
        out = [b""] * len(texts)
        plain = []
        for i, t in enumerate(texts):
            if t and _OTHER.search(t):
                out[i] = self._library(t).astype("<u4").tobytes()
            elif t:
                plain.append((i, t.lower().encode()))
        if not plain:
            return out
        data = np.frombuffer(b" ".join(raw for _, raw in plain) + b" ", np.uint8)
        s, kind = piece_starts(data)
        if not len(s):
            return out
        # A piece ends where the next begins, or where space comes first.
        gap = np.flatnonzero(kind == _SPACE)
        e = np.minimum(np.append(s[1:], len(data)), gap[np.searchsorted(gap, s)])
        ids, count = self._ids(data, s, e)
        ends = np.cumsum([len(raw) + 1 for _, raw in plain])
        stop = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(s, ends)]
        ids = ids.astype("<u4")
        for (i, _), a, b in zip(plain, [0, *stop[:-1].tolist()], stop.tolist(), strict=True):
            out[i] = ids[a:b].tobytes()
        return out


def spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... `count[0]` of them, and so on."""
    return np.arange(count.sum()) + np.repeat(begin - np.cumsum(count) + count, count)
