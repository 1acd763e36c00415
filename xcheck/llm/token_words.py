"""Token ids by distinct words.

A tokenizer whose tokens never run across certain positions (a space after a
non-space) can encode the stretches between them on their own. Texts are cut
there, each distinct stretch is encoded once and the ids are laid out again by
position; a worker keeps the ids of up to ``KEPT`` stretches for later batches.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .words import _BASE, mix, pieces

KEPT = 600_000
_U = np.uint64


def stretches(data: np.ndarray, offsets: np.ndarray, opens: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Start of every stretch: text starts, and bytes in ``opens`` after a byte in ``before``."""
    s = np.zeros(len(data), bool)
    s[1:] = opens[data[1:]] & before[data[:-1]]
    s[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return np.flatnonzero(s)


def _hashes(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    length = np.diff(np.append(start, len(data)))
    power = np.full(int(length.max()), _BASE, _U)
    power[0] = _U(1)
    power = np.multiply.accumulate(power)
    place = np.arange(len(data)) - np.repeat(start, length)
    return mix(np.add.reduceat((data.astype(_U) + _U(1)) * power[place], start) + length.astype(_U) * _U(0xC2B2AE3D27D4EB4F))


class WordEncoder:
    """``encode(list of bytes) -> (flat ids, ids per stretch)`` is called with unseen stretches only."""

    def __init__(self, encode: Callable, opens: np.ndarray, before: np.ndarray):
        self.encode, self.opens, self.before = encode, opens, before
        self.clear()

    def clear(self):
        self.at: dict[int, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.first = np.zeros(1, np.int64)

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, offsets per text) of consecutive texts."""
        start = stretches(data, offsets, self.opens, self.before)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        end = np.append(start[1:], len(data))
        h, first, back = np.unique(_hashes(data, start), return_index=True, return_inverse=True)
        known = h.tolist()
        if len(self.at) > KEPT:
            self.clear()
        word = np.array([self.at.get(x, -1) for x in known], np.int64)
        new = np.flatnonzero(word < 0).tolist()
        if new:
            raw, a = data.tobytes(), first[new]
            flat, count = self.encode([raw[x:y] for x, y in zip(start[a].tolist(), end[a].tolist())])
            word[new] = np.arange(len(self.at), len(self.at) + len(new))
            self.at.update(zip([known[k] for k in new], word[new].tolist()))
            self.ids = np.concatenate([self.ids, flat.astype(np.int32)])
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(count)])
        word = word[back]
        size = self.first[word + 1] - self.first[word]
        to = np.zeros(len(word) + 1, np.int64)
        np.cumsum(size, out=to[1:])
        at = np.arange(to[-1]) + np.repeat(self.first[word] - to[:-1], size)
        return self.ids[at], to[np.searchsorted(start, offsets)]

    def column(self, data: np.ndarray, offsets: np.ndarray, prefix: int | None = None):
        """(first row, last row, flat ids, offsets) in pieces; ``prefix`` is a byte put before every non-empty text."""
        for lo, hi in pieces(offsets):
            d, o = data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
            if prefix is not None:
                filled = o[1:] > o[:-1]
                d = np.insert(d, o[:-1][filled], prefix)
                o = o + np.concatenate([[0], np.cumsum(filled)])
            yield lo, hi, *self.texts(d, o)
