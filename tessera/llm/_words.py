"""Words of many texts at once: byte classes, boundaries and numbers of words, without a Python object for each word.

The texts of a batch lie one after the other in one byte array, each closed by ``SEP``, a byte that UTF-8 never has. A word of
up to 15 bytes is its own exact key (two integers, the length in the last byte), so looking it up is a few array
operations for all words of the batch; longer words go through a dictionary of bytes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

SEP = 255
_U = np.uint64
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=_U)
_MIX = _U(0x9E3779B97F4A7C15)


def joined(texts: list[bytes]) -> np.ndarray:
    """The texts' bytes, each followed by ``SEP``."""
    return np.frombuffer(b"\xff".join(texts) + (b"\xff" if texts else b""), dtype=np.uint8)


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of one of each of the distinct keys, for each key which one it is)."""
    _, first, which = np.unique((a ^ (b >> _U(31)) ^ (b << _U(33))) * _MIX, return_index=True, return_inverse=True)
    if (a[first][which] != a).any() or (b[first][which] != b).any():  # two keys of one hash
        keys = np.empty(len(a), dtype=[("a", _U), ("b", _U)])
        keys["a"], keys["b"] = a, b
        _, first, which = np.unique(keys, return_index=True, return_inverse=True)
    return first, which


class WordTable:
    """Word -> number, in the order in which words were first seen, until ``clear``."""

    def __init__(self, slots: int = 1 << 16):
        self.clear(slots)

    def clear(self, slots: int = 1 << 16) -> None:
        self.size = 0
        self._bits = slots.bit_length() - 1
        self._a, self._b = np.zeros(slots, dtype=_U), np.zeros(slots, dtype=_U)
        self._row = np.full(slots, -1, dtype=np.int64)
        self._short = 0
        self._long: dict[bytes, int] = {}

    def _slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = (a ^ (b >> _U(29)) ^ (b << _U(35))) * _MIX
        return ((x ^ (x >> _U(32))) * _MIX >> _U(64 - self._bits)).astype(np.int64)

    def _find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        slot = self._slots(a, b)
        out = self._row[slot]
        other = np.flatnonzero((out >= 0) & ((self._a[slot] != a) | (self._b[slot] != b)))
        while len(other):  # open addressing: the next slot
            slot[other] = (slot[other] + 1) & (len(self._row) - 1)
            s = slot[other]
            out[other] = self._row[s]
            other = other[(out[other] >= 0) & ((self._a[s] != a[other]) | (self._b[s] != b[other]))]
        return out

    def _put(self, a: np.ndarray, b: np.ndarray, rows: np.ndarray) -> None:
        """Distinct keys that are not there."""
        if 2 * (self._short + len(a)) > len(self._row):
            old = self._row >= 0
            held = self._a[old], self._b[old], self._row[old]
            while 2 * (self._short + len(a)) > 1 << self._bits:
                self._bits += 1
            self._a, self._b, self._row = np.zeros(1 << self._bits, dtype=_U), np.zeros(1 << self._bits, dtype=_U), np.full(1 << self._bits, -1, dtype=np.int64)
            self._short = 0
            self._put(*held)
        self._short += len(a)
        left, step = np.arange(len(a)), self._slots(a, b)
        while len(left):
            s = step[left]
            free = np.flatnonzero(self._row[s] < 0)
            _, one = np.unique(s[free], return_index=True)  # one key a slot
            own = left[free[one]]
            self._a[step[own]], self._b[step[own]], self._row[step[own]] = a[own], b[own], rows[own]
            done = np.zeros(len(a), dtype=bool)
            done[own] = True
            left = left[~done[left]]
            taken = left[(self._a[step[left]] != a[left]) | (self._b[step[left]] != b[left])]
            step[taken] = (step[taken] + 1) & (len(self._row) - 1)

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, learn: Callable[[list[bytes]], None]) -> np.ndarray:
        """The number of each word ``data[start:end]``; ``learn`` gets the new words, which are numbered from ``size`` on."""
        padded = np.concatenate((data, np.zeros(16, dtype=np.uint8)))
        eight = np.ndarray(len(padded) - 7, dtype="<u8", buffer=padded, strides=(1,))
        size = ends - starts
        a = eight[starts] & _MASK[np.minimum(size, 8)]
        b = (eight[starts + 8 if len(starts) else starts] & _MASK[np.clip(size - 8, 0, 7)]) | (np.minimum(size, 16).astype(_U) << _U(56))
        out = self._find(a, b)
        long = np.flatnonzero(size > 15)
        new: list[bytes] = []
        if len(long):
            out[long] = 0
        missing = np.flatnonzero(out < 0)
        if len(missing):
            first, which = _distinct(a[missing], b[missing])
            rows = self.size + np.arange(len(first))
            out[missing] = rows[which]
            at = missing[first]
            self._put(a[at], b[at], rows)
            raw = data.tobytes()
            new += [raw[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist())]
            self.size += len(at)
        if len(long):
            raw = data.tobytes()
            for k, s, e in zip(long.tolist(), starts[long].tolist(), ends[long].tolist()):
                w = raw[s:e]
                row = self._long.get(w)
                if row is None:
                    row = self.size
                    if len(w) < 256:
                        self._long[w] = row
                    new.append(w)
                    self.size += 1
                out[k] = row
        if new:
            learn(new)
        return out


_CLASS = np.full(256, 3, dtype=np.int8)  # 0 white space, 1 letter, 2 digit, 3 other, 4 end of a text
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 255)]] = 1
_CLASS[48:58] = 2
_CLASS[SEP] = 4
_ODD = np.zeros(256, dtype=bool)
_ODD[[*range(14, 32), 127, *range(0xC0, 0xC3), *range(0xCA, 255)]] = True


def unplain(data: np.ndarray) -> np.ndarray:
    """Places of bytes of characters for which byte classes do not hold: control signs, and what is outside ASCII and the Latin letters to U+027F."""
    odd = _ODD[data]
    latin = np.flatnonzero(data[:-1] == 0xC3)
    odd[latin] |= (data[latin + 1] == 0x97) | (data[latin + 1] == 0xB7)  # the signs for times and divided by
    return np.flatnonzero(odd)


def spaced_words(data: np.ndarray) -> np.ndarray:
    """Starts of the words of plain texts by the pattern of byte-level vocabularies; ends of texts are words of their own.

    's|'t|'re|'ve|'m|'ll|'d| ?letters| ?digits| ?others|white space but for the last sign before a word|white space
    """
    kind = _CLASS[data]
    edge = np.empty(len(data) + 3, dtype=bool)
    edge[len(data) :] = True
    edge[:1] = True
    edge[1 : len(data)] = (kind[1:] != kind[:-1]) | (kind[1:] == 4)
    quotes = np.flatnonzero((data[:-1] == 39) & (kind[1:] == 1) & edge[: len(data) - 1]) if len(data) else np.zeros(0, dtype=np.int64)
    before = np.flatnonzero((kind[:-1] == 0) & (kind[1:] != 0) & (kind[1:] != 4))
    edge[before] = True
    edge[before[data[before] == 32] + 1] = False
    if len(quotes):
        quotes = quotes[(quotes == 0) | (data[quotes - 1] != 32)]
        x, y = data[quotes + 1], data[np.minimum(quotes + 2, len(data) - 1)]
        two = ((x == 114) | (x == 118)) & (y == 101) | (x == 108) & (y == 108)
        one = (x == 115) | (x == 116) | (x == 109) | (x == 100)
        n = np.where(one, 1, np.where(two, 2, 0))
        quotes, n = quotes[n > 0], n[n > 0]
        edge[quotes + 1] = False
        edge[quotes + 1 + n] = True
    return np.flatnonzero(edge[: len(data)])
