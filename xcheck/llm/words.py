"""Vectorised word scanning over Arrow string columns.

Tasks read UTF-8 bytes straight from the Arrow buffers and work on numpy arrays
of word hashes, so no Python string is built per word. Texts are scanned in
byte segments of about ``SEGMENT`` cut at separators: memory stays bounded for
any number and length of texts (a single longer word is scanned whole).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 19
PIECE = 2 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser: neighbouring inputs give unrelated outputs."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def byte_class(separators: bytes, fold_case: bool) -> tuple[np.ndarray, np.ndarray]:
    """(is word byte, byte after folding A-Z) tables."""
    is_word = np.ones(256, bool)
    is_word[list(separators)] = False
    fold = np.arange(256, dtype=np.uint8)
    if fold_case:
        fold[65:91] += 32
    return is_word[fold], fold


# words are runs of anything but space, tab and the other ASCII line controls
SPACES = bytes([0x20, 9, 10, 11, 12, 13])
# words are runs of digits, letters a-z (after folding) and anything beyond ASCII
NON_ALNUM = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


@dataclass
class Words:
    """Words of consecutive texts: ``hash`` per word, ``lo``/``hi`` byte range,
    ``first[d]:first[d + 1]`` the words of text ``d``."""
    hash: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    first: np.ndarray


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0]:off[-1]] if raw is not None and len(off) else np.zeros(0, np.uint8)
    return data, off - off[0]


def pieces(offsets: np.ndarray, size: int = PIECE):
    """Row ranges whose texts hold about ``size`` bytes (a longer text is alone)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def _segment(data, lo, hi, starts, is_word, fold):
    """Words of data[lo:hi]; ``starts`` are text starts inside it."""
    b = data[lo:hi]
    w = is_word[b]
    left = np.empty_like(w)
    left[0] = False
    left[1:] = w[:-1]
    left[starts - lo] = False
    s = np.flatnonzero(w & ~left)
    if not len(s):
        return np.zeros(0, _U), s, s
    ends = ~w
    e_mark = np.empty_like(w)
    e_mark[-1] = w[-1]
    e_mark[:-1] = w[:-1] & ends[1:]
    inner = starts[(starts > lo)] - lo - 1
    e_mark[inner] |= w[inner]
    e = np.flatnonzero(e_mark) + 1
    length = e - s
    power = np.full(int(length.max()) + 1, _BASE, _U)
    power[0] = _U(1)
    power = np.multiply.accumulate(power)
    flat = np.flatnonzero(w)
    at = np.zeros(len(s), np.int64)
    np.cumsum(length[:-1], out=at[1:])
    place = np.arange(len(flat), dtype=np.int64) - np.repeat(at, length)
    value = (fold[b[flat]].astype(_U) + _U(1)) * power[place]
    h = mix(np.add.reduceat(value, at) + length.astype(_U) * _U(0xC2B2AE3D27D4EB4F))
    return h, s + lo, e + lo


def scan(data: np.ndarray, offsets: np.ndarray, classes) -> Words:
    """All words of all texts."""
    is_word, fold = classes
    starts = np.unique(offsets[:-1][offsets[:-1] < len(data)]) if len(offsets) > 1 else np.zeros(0, np.int64)
    hs, los, his = [], [], []
    lo, n = 0, len(data)
    while lo < n:
        hi = min(n, lo + SEGMENT)
        while hi < n:   # cut where a word cannot run across
            k = int(np.searchsorted(starts, hi, "right")) - 1
            cut = int(starts[k]) if k >= 0 and starts[k] > lo else 0
            seps = np.flatnonzero(~is_word[data[max(lo, hi - 65536):hi]])
            if len(seps):
                cut = max(cut, max(lo, hi - 65536) + int(seps[-1]) + 1)
            if cut > lo:
                hi = cut
                break
            hi = min(n, hi + SEGMENT)
        k0, k1 = np.searchsorted(starts, [lo, hi])
        h, s, e = _segment(data, lo, hi, starts[k0:k1], is_word, fold)
        hs.append(h), los.append(s), his.append(e)
        lo = hi
    z = np.zeros(0, np.int64)
    h = np.concatenate(hs) if hs else np.zeros(0, _U)
    s = np.concatenate(los) if los else z
    e = np.concatenate(his) if his else z
    return Words(h, s, e, np.searchsorted(s, offsets))


def ngrams(word_hash: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words (order matters)."""
    m = len(word_hash) - n + 1
    if m <= 0:
        return np.zeros(0, _U)
    out = np.zeros(m, _U)
    for k in range(n):
        out = (out + word_hash[k:k + m]) * _BASE
        out ^= out >> _U(29)
    return mix(out)


def ngrams_of_texts(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position of its first word) of the n-grams that lie in one text."""
    g = ngrams(words.hash, n)
    text = np.searchsorted(words.first, np.arange(len(words.hash)), "right")
    inside = text[:len(g)] == text[n - 1:n - 1 + len(g)]
    at = np.flatnonzero(inside)
    return g[at], at
