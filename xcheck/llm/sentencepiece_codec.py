"""SentencePiece (BPE with byte fallback) encoding and decoding.

Encoding runs merge rounds over flat numpy arrays that hold the symbols of many
distinct words at once: every round takes each word's smallest pair rank, merges
its leftmost pair of that rank, closes the gaps and drops the words in which no
pair is left. Where the merged piece cannot start a better pair, all leftmost
non-overlapping pairs of that rank merge in the same round (same result, fewer
rounds on long words). The library's model file gives pieces and scores only.
"""

from __future__ import annotations

import codecs

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tables import give_back, with_results
from .token_words import WordEncoder
from .words import pieces, utf8

_NONE = np.iinfo(np.int32).max
SPACE = "▁"


def _each_byte(error):
    return "�" * (error.end - error.start), error.end


codecs.register_error("each-byte", _each_byte)


class Vocabulary:
    """Pieces, pair table and byte ids of a model file."""

    def __init__(self, model_file: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.size = model.get_piece_size()
        piece = [model.id_to_piece(i) for i in range(self.size)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(self.size)]
        self.byte_id = np.zeros(256, np.int32)
        self.out: list[bytes] = []
        for i, p in enumerate(piece):
            if model.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.out.append(bytes([int(p[3:5], 16)]))
            else:
                self.out.append(b"" if model.is_control(i) else " ⁇ ".encode() if model.is_unknown(i) else p.replace(SPACE, " ").encode())
        normal = [i for i in range(self.size) if not special[i] and not model.is_unused(i)]
        ids = {piece[i]: i for i in normal}
        # a character of a piece that is no piece itself gets a symbol of its own beyond the ids
        chars = sorted({c for p in ids for c in p} - set(ids))
        symbol = ids | {c: self.size + k for k, c in enumerate(chars)}
        self.extra = chars
        self.marked = {i for p, i in ids.items() if p[0] == SPACE}
        score = np.array([model.get_score(i) for i in range(self.size)], np.float32)
        levels = np.unique(-score[normal])
        rank = np.searchsorted(levels, -score).astype(np.int32)
        pairs = [(symbol[p[:k]], symbol[p[k:]], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol]
        left, right, to = (np.array(x, np.int64) for x in zip(*pairs))
        self.n = self.size + len(chars)
        key = left * self.n + right
        order = np.argsort(key)
        self.key, self.to, self.rank = key[order], to[order].astype(np.int32), rank[to[order]]
        # merging to piece m is safe to do at many places when no pair with m is as good as m, and m's rank is its own
        best = np.full(self.n, _NONE, np.int32)
        np.minimum.at(best, left, rank[to])
        np.minimum.at(best, right, rank[to])
        shared = np.bincount(rank[normal], minlength=len(levels)) > 1
        self.safe = np.zeros(len(levels) + 1, bool)
        for i in normal:
            self.safe[rank[i]] = not shared[rank[i]] and best[i] > rank[i]
        self.points = np.full(0x110000, -1, np.int32)
        for c, s in symbol.items():
            if len(c) == 1:
                self.points[ord(c)] = s
        # no piece goes on after a word: else a text cannot be cut at spaces
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in ids)

    def pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of neighbouring symbols; no pair: the largest rank."""
        key = a.astype(np.int64) * self.n + b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        hit = (self.key[at] == key) & (a >= 0) & (b >= 0)
        return np.where(hit, self.rank[at], _NONE), np.where(hit, self.to[at], -1)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids per word); a space stands for the word mark."""
        text = [w.decode().replace(" ", SPACE) for w in words]
        point = np.frombuffer("".join(text).encode("utf-32-le"), np.uint32).astype(np.int64)
        size = np.array([len(t) for t in text], np.int64)
        word = np.repeat(np.arange(len(words)), size)
        sym = self.points[point].astype(np.int64)
        sym = np.where(sym < 0, -1 - point, sym)       # unknown characters keep their code point
        done_word, done_sym = [], []
        last = np.ones(len(sym), bool)
        last[:-1] = word[1:] != word[:-1]
        rank, to = np.full(len(sym), _NONE, np.int32), np.full(len(sym), -1, np.int32)
        inner = np.flatnonzero(~last)
        rank[inner], to[inner] = self.pair(sym[inner], sym[inner + 1])
        while len(sym):
            start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            count = np.diff(np.append(start, len(sym)))
            least = np.repeat(np.minimum.reduceat(rank, start), count)
            over = least == _NONE
            if over.any():
                done_word.append(word[over]), done_sym.append(sym[over])
                live = ~over
                sym, word, rank, to, least = sym[live], word[live], rank[live], to[live], least[live]
                continue
            at = np.flatnonzero(rank == least)
            first = np.concatenate([[True], word[at[1:]] != word[at[:-1]]])
            run = np.concatenate([[True], at[1:] != at[:-1] + 1])
            in_run = np.arange(len(at)) - np.repeat(np.flatnonzero(run), np.diff(np.append(np.flatnonzero(run), len(at))))
            at = at[first | (self.safe[rank[at]] & (in_run % 2 == 0))]
            sym[at] = to[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            sym, word, rank, to = sym[keep], word[keep], rank[keep], to[keep]
            new = moved[at]
            near = np.zeros(len(sym) + 1, bool)
            near[new] = near[new - 1] = True
            near[-1] = False
            ends = np.ones(len(sym), bool)
            ends[:-1] = word[1:] != word[:-1]
            rank[ends] = _NONE
            again = np.flatnonzero(near[:-1] & ~ends)
            rank[again], to[again] = self.pair(sym[again], sym[again + 1])
        if not done_word:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        word, sym = np.concatenate(done_word), np.concatenate(done_sym)
        order = np.argsort(word, kind="stable")
        return self._with_bytes(word[order], sym[order], len(words))

    def _with_bytes(self, word, sym, n):
        """Characters without a piece become their bytes."""
        odd = np.flatnonzero((sym < 0) | (sym >= self.size))
        if len(odd):
            raw = [chr(-1 - s) if s < 0 else self.extra[s - self.size] for s in sym[odd].tolist()]
            raw = [r.encode() for r in raw]
            times = np.ones(len(sym), np.int64)
            times[odd] = [len(r) for r in raw]
            to = np.cumsum(times) - times
            at = np.concatenate([to[i] + np.arange(len(r)) for i, r in zip(odd, raw)])
            sym, word = np.repeat(sym, times), np.repeat(word, times)
            sym[at] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        return sym.astype(np.int32), np.bincount(word, minlength=n)

    def decode(self, ids: list[int]) -> str:
        """Text of an id sequence: the first word mark goes, bytes that are no UTF-8 become U+FFFD each."""
        out = b"".join([self.out[i] for i in ids])
        if ids and ids[0] in self.marked:
            out = out[1:]
        return out.decode("utf-8", "each-byte")


_LOADED: dict[str, tuple[Vocabulary, WordEncoder]] = {}


def _loaded(model_file: str) -> tuple[Vocabulary, WordEncoder]:
    """Once per worker."""
    if model_file not in _LOADED:
        v = Vocabulary(model_file)
        opens = np.zeros(256, bool)
        opens[0x20] = v.cuts
        _LOADED[model_file] = v, WordEncoder(v.encode, opens, np.arange(256) != 0x20)
    return _LOADED[model_file]


def _forget(model_file: str) -> None:
    """A worker keeps the vocabulary, not the words of the task that ended."""
    if model_file in _LOADED:
        _LOADED[model_file][1].clear()
    give_back()


def _encoded(column: pa.Array, model_file: str):
    """(first row, last row, flat ids, offsets) in pieces."""
    _, encoder = _loaded(model_file)
    data, off = utf8(column)
    if SPACE.encode() in data.tobytes():     # the mark itself is read as a space
        data, off = utf8(pa.array([None if t is None else t.replace(SPACE, " ") for t in column.to_pylist()], pa.large_string()))
    yield from encoder.column(data, off, prefix=0x20)


def sentencepiece_encode(docs: DataFrame, model_file: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """All columns of ``docs`` plus ``ids_col`` (array<int>): the whole text's
    ids, as the library's ``encode`` without begin and end ids. Null and empty
    texts: no ids. Rows are independent; repeated rows and an empty table need
    no care; the new column's name must be free."""

    def compute(column):
        for lo, hi, ids, first in _encoded(column, model_file):
            yield lo, hi, [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids))]

    return with_results(docs, text_col, compute, [(ids_col, "array<int>")], lambda: _forget(model_file))


def sentencepiece_round_trip(docs: DataFrame, model_file: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """All columns of ``docs`` plus ``ids_col`` and ``decoded_col``: the whole
    text's ids, and the text that these ids decode to, in one pass over the rows
    (as ``sentencepiece_encode`` and ``sentencepiece_decode`` one after the other)."""

    def compute(column):
        vocabulary, _ = _loaded(model_file)
        for lo, hi, ids, first in _encoded(column, model_file):
            flat = ids.tolist()
            text = pa.array([vocabulary.decode(flat[x:y]) for x, y in zip(first[:-1].tolist(), first[1:].tolist())], pa.string())
            yield lo, hi, [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids)), text]

    return with_results(docs, text_col, compute, [(ids_col, "array<int>"), (decoded_col, "string")], lambda: _forget(model_file))


def sentencepiece_decode(rows: DataFrame, model_file: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """All columns of ``rows`` plus ``text_col``: the text of ``ids_col``. A null
    or empty array: the empty text; control ids give nothing; bytes that are no
    UTF-8 become U+FFFD each."""

    def compute(column):
        vocabulary, _ = _loaded(model_file)
        if pa.types.is_null(column.type):
            yield 0, len(column), [pa.array([""] * len(column))]
            return
        size = np.asarray(column.value_lengths().fill_null(0))
        for lo, hi in pieces(np.concatenate([[0], np.cumsum(size)]), 500_000):
            part = column.slice(lo, hi - lo)
            first = np.asarray(part.offsets) - part.offsets[0].as_py()
            ids = np.asarray(part.values.slice(part.offsets[0].as_py(), int(first[-1]))).tolist()
            empty = ~np.asarray(part.is_valid())
            yield lo, hi, [pa.array(["" if empty[k] else vocabulary.decode(ids[first[k]:first[k + 1]]) for k in range(hi - lo)], pa.string())]

    return with_results(rows, ids_col, compute, [(text_col, "string")])
