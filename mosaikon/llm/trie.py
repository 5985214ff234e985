"""N-gram tries in compact levels: Elias-Fano sequences for pointers and children, quantised probabilities.

All is done for arrays of queries at a time.  A trie's levels lie in one memory map without a name, so the pages are the
operating system's to hold and go back to it as soon as the trie is dropped.
"""

from __future__ import annotations

import mmap

import numpy as np

_ONE = np.uint64(1)
#: Bits of a quantised probability, and the log odds that they reach from and to.  Code 0 stands for none.
BITS, LOW, HIGH = 12, -32.0, 16.0


def _bits_of(values: np.ndarray, width: int) -> np.ndarray:
    """Values of `width` bits each, one after another in 64-bit words (and one spare word)."""
    out = np.zeros((len(values) * width + 63) // 64 + 2, np.uint64)
    if width and len(values):
        at = np.arange(len(values), dtype=np.int64) * width
        word, off = at >> 6, (at & 63).astype(np.uint64)
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        out[word[starts]] |= np.bitwise_or.reduceat(values << off, starts)
        over = np.flatnonzero(off + np.uint64(width) > np.uint64(64))
        out[word[over] + 1] |= values[over] >> (np.uint64(64) - off[over])
    return out


class EliasFano:
    """A sequence of unsigned numbers that never falls.

    The low bits of each number lie side by side; the high parts are counted in unary: number k with high part h sets bit
    h + k.  Beside them stands how many bits are set before each 64-bit word.
    """

    def __init__(self, values: np.ndarray, universe: int):
        values = np.ascontiguousarray(values, np.uint64)
        self.n = len(values)
        self.width = max(0, int(universe // max(self.n, 1)).bit_length() - 1)
        low = np.uint64((1 << self.width) - 1)
        marks = np.zeros(self.n + (universe >> self.width) + 65 & ~63, bool)
        marks[(values >> np.uint64(self.width)).astype(np.int64) + np.arange(self.n)] = True
        high = np.packbits(marks, bitorder="little").view(np.uint64)
        self.parts = [_bits_of(values & low, self.width), high, np.r_[0, np.cumsum(np.bitwise_count(high), dtype=np.int64)]]

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of the k-th set bit, counted from 0."""
        high, before = self.parts[1:]
        word = np.searchsorted(before, k, side="right") - 1
        x, left, at = high[word], k - before[word], word << 6
        for step in (32, 16, 8, 4, 2, 1):
            low = x & ((_ONE << np.uint64(step)) - _ONE)
            here = np.bitwise_count(low)
            on = left >= here
            left = left - np.where(on, here, 0)
            x = np.where(on, x >> np.uint64(step), low)
            at = at + np.where(on, step, 0)
        return at

    def _value(self, k: np.ndarray, place: np.ndarray) -> np.ndarray:
        if not self.width:
            return place - k
        lows, at = self.parts[0], k * self.width
        word, off = at >> 6, (at & 63).astype(np.uint64)
        x = (lows[word] >> off) | np.where(off > 0, lows[word + 1] << ((np.uint64(64) - off) & np.uint64(63)), np.uint64(0))
        return ((place - k) << self.width) | (x & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def __getitem__(self, k: np.ndarray) -> np.ndarray:
        return self._value(k, self.select(k))

    def stretch(self, a: int, b: int) -> np.ndarray:
        """Numbers a to b - 1, read off without a search for each."""
        if a >= b:
            return np.zeros(0, np.int64)
        first, last = self.select(np.array([a, b - 1]))
        bits = np.unpackbits(self.parts[1][first >> 6 : (last >> 6) + 1].view(np.uint8), bitorder="little")
        place = np.flatnonzero(bits) + (first >> 6 << 6)
        return self._value(np.arange(a, b), place[(place >= first) & (place <= last)])


def quantised(p: np.ndarray) -> np.ndarray:
    """A code of 12 bits, from 1 on, for each probability: its place on an even scale of log odds.

    Probabilities near 0 and those near 1 are off by 0.6 % of what they are short of 0 or 1, at most.
    """
    odds = np.log(p) - np.log1p(-np.minimum(p, 1 - 1e-12))
    return (1 + np.rint((np.clip(odds, LOW, HIGH) - LOW) * ((1 << BITS) - 2) / (HIGH - LOW))).astype(np.uint16)


def meaning(codes: np.ndarray) -> np.ndarray:
    """The probability that a code stands for; 0 for code 0."""
    odds = LOW + (codes.astype(float) - 1) * (HIGH - LOW) / ((1 << BITS) - 2)
    return np.where(codes > 0, 1 / (1 + np.exp(-odds)), 0.0)


def places(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """searchsorted() for many keys in any order: looked up in rising order, the table is read from front to back."""
    order = np.argsort(keys)
    out = np.empty(len(keys), np.int64)
    out[order] = np.searchsorted(table, keys[order])
    return out


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in rising order."""
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


class Trie:
    """Contexts of one or two words and what follows them, each with a quantised probability and each context with what it
    leaves to the shorter one.

    contexts: (n, order - 1) word ids in rising order.  follows, owner: word ids and the context each stands under, in
    the order of (owner, follows).  A word is kept as its rank among all words that follow the context's last word, so
    the numbers are small; a context's numbers are raised by those of the contexts before it, which makes one rising
    sequence.
    """

    def __init__(self, contexts: np.ndarray, follows: np.ndarray, owner: np.ndarray, share: np.ndarray, rest: np.ndarray, words: int):
        self.words, self.n = words, len(contexts)
        last = contexts[:, -1]
        after, place = np.unique(last[owner] * words + follows, return_inverse=True)  # (last word, next word) as they occur
        self.after = EliasFano(after, words * words)
        begins = places(after, last * words)
        room = places(after, (last + 1) * words) - begins
        self.heads = EliasFano(contexts[:, 0] * (words if contexts.shape[1] > 1 else 1) + (last if contexts.shape[1] > 1 else 0), words ** contexts.shape[1])
        base = np.r_[0, np.cumsum(room)]
        self.bases = EliasFano(base, int(base[-1]) + 1)
        self.pointers = EliasFano(np.searchsorted(owner, np.arange(self.n + 1)), len(follows) + 1)
        self.children = EliasFano(base[owner] + place - begins[owner], int(base[-1]) + 1)
        self.share, self.rest = quantised(share), quantised(rest)
        self._map()

    def _map(self) -> None:
        """Put the levels into one memory map."""
        levels = [self.after, self.heads, self.bases, self.pointers, self.children]
        size = sum((a.nbytes + 7) & ~7 for s in levels for a in s.parts) + self.share.nbytes + self.rest.nbytes + 16
        self.map, at = mmap.mmap(-1, size), 0

        def put(a: np.ndarray) -> np.ndarray:
            nonlocal at
            view = np.frombuffer(self.map, a.dtype, len(a), at)
            view[:] = a
            at += (a.nbytes + 7) & ~7
            return view

        for s in levels:
            s.parts = [put(a) for a in s.parts]
        self.share, self.rest = put(self.share), put(self.rest)

    def find(self, contexts: np.ndarray, follows: np.ndarray, owner: np.ndarray, block: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the share of each (contexts[owner], follows) and of the rest of each context; 0 where there is none.

        Queries come in the order a trie is built in.  A stretch of the sequence is read for each block of them.
        """
        share, rest = np.zeros(len(follows), np.uint16), np.zeros(len(contexts), np.uint16)
        if not self.n or not len(follows):
            return share, rest
        wide = contexts.shape[1] > 1
        key = contexts[:, 0] * (self.words if wide else 1) + (contexts[:, -1] if wide else 0)
        heads, last = self.heads.stretch(0, self.n), contexts[:, -1]
        at = np.minimum(np.searchsorted(heads, key), self.n - 1)
        known = heads[at] == key
        rest[known] = self.rest[at[known]]
        after = self.after.stretch(0, self.after.n)
        begins = places(after, last * self.words)
        pair = last[owner] * self.words + follows
        place = np.minimum(places(after, pair), len(after) - 1)
        hit = np.flatnonzero((after[place] == pair) & known[owner])
        node = at[owner[hit]]
        wanted = self.bases[node] + place[hit] - begins[owner[hit]]
        for a in range(0, len(hit), block):
            b = min(a + block, len(hit))
            lo, hi = self.pointers[np.array([node[a], node[b - 1] + 1])]
            have = self.children.stretch(int(lo), int(hi))
            found = np.minimum(np.searchsorted(have, wanted[a:b]), len(have) - 1)  # the successor of each
            same = have[found] == wanted[a:b]
            share[hit[a:b][same]] = self.share[lo + found[same]]
        return share, rest
