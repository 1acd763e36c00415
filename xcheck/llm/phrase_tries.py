"""Phrase collocation mining with broadcast double-array tries.

A language's phrases of two to four words that occur often and whose words
occur together far more than apart. Everything is counted over all texts:

1. Words are added up inside each task and then by shuffle. Then the texts are
   scanned once more and written as the names of their runs of frequent words
   (which a filter of fixed size tells, letting a few others pass); all that
   follows reads these runs, not the texts.
2. Candidates of k words are Apriori-safe: both of their parts of k - 1 words
   are frequent. Tasks meet the frequent parts in a filter of fixed size (which
   lets a few others pass). Phrases that are left are first counted by hash cell
   (a byte a cell, counts up to ``min_count``; a cell holds all its phrases, so its sum
   is never too low); then phrases of crowded cells are sent by name, each once a
   task, with its occurrences up to ``min_count``: enough to tell whether it can be
   frequent. In a corpus that crowds all cells every phrase is sent by name. Cells,
   phrases and counts travel in packed chunks and are added up chunk by chunk.
3. All candidates are cut into shards of about ``SHARD`` phrases by their first
   two words; each shard becomes a double-array trie, built in a task. ``TRIES`` of
   them at a time are sent to all tasks (so what is sent is bounded; more shards
   take more passes over the runs). A position goes into the one trie that its
   first two words name. numpy advances the states of all its positions at once,
   level by level; accepting states are added up and the sums of
   the tasks by shuffle. These are the frequencies.
4. Cuts, overlaps with longer phrases and ranks are joins and aggregates over
   the frequent phrases only.

A word is named by a 64-bit hash of its folded bytes and its language.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import small_batches, written
from .words import byte_class, mix, pieces, scan, utf8

LONGEST = 4             # words of a phrase
MIN_COUNT = 30
KEEP = 2000             # phrases reported for each language
COVERED = 80            # percent of a phrase's occurrences inside a longer one that drop it
SCALE = 2_000_000       # of the score
SHARD = 400_000         # phrases of a trie, about
TRIES = 3               # tries sent at once
HELD = 1_500_000        # distinct phrases or words that a task holds before it sends them on
NEAR = 128              # free places that a node's children are tried at
CELLS = 1 << 25         # hash cells of phrases (32 MB a task, 4 MB sent back; fixed)
CHUNK = 1 << 16         # cells that travel together
PACKS = 1024            # packs into which a task's phrases are dealt by hash
PLACES = 1 << 13        # counts that travel together
FILTER_BITS = 1 << 26   # filter of frequent parts (8 MB, fixed)
PACKED = 8              # rows of packed names that a task is sent at a time
STRETCH = 1 << 16       # names of a row of runs, about (half a MB)
NO_LANGUAGE = "und"

BREAKS = b".,;:!?\n\x0b\x0c\r"      # end a piece; space and tab end a word only
_CLASSES = byte_class(b" \t" + BREAKS, True)
_BREAK = np.zeros(256, bool)
_BREAK[list(BREAKS)] = True
_U = np.uint64
_PRIME = _U(0x9E3779B97F4A7C15)
_S = [f"s{k + 1}" for k in range(LONGEST)]


def _scanned(language: pa.Array, text: pa.Array):
    """Per piece of rows: (words, folded bytes, name of each word, end of the
    phrase piece that each word is in, row of each word)."""
    data, off = utf8(text)
    tag = mix(np.asarray(language).astype(np.int64).view(_U))
    for lo, hi in pieces(off):
        d, o = data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        w = scan(d, o, _CLASSES)
        m = len(w.hash)
        row = lo + np.repeat(np.arange(hi - lo), np.diff(w.first))
        name = mix(w.hash ^ tag[row]) | _U(1)       # zero stands for no word
        closes = np.ones(m, bool)
        if m:
            upto = np.zeros(len(d) + 1, np.int64)
            np.cumsum(_BREAK[d], out=upto[1:])
            closes[:-1] = (row[1:] != row[:-1]) | (upto[w.lo[1:]] > upto[w.hi[:-1]])
        last = np.flatnonzero(closes)
        end = last[np.searchsorted(last, np.arange(m))] + 1 if m else np.zeros(0, np.int64)
        yield w, _CLASSES[1][d], name, end, row


def _texts(flat: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    """The byte ranges as strings."""
    size = hi - lo
    to = np.zeros(len(lo) + 1, np.int64)
    np.cumsum(size, out=to[1:])
    at = np.arange(to[-1]) + np.repeat(lo - to[:-1], size)
    return pa.LargeStringArray.from_buffers(len(lo), pa.py_buffer(to), pa.py_buffer(np.ascontiguousarray(flat[at])))


def count_words(texts: DataFrame) -> DataFrame:
    """(lang, word, name, n) of (key, text, lang) rows; the empty word has the
    number of all words of a language."""

    def run(batches):
        held, size = [], 0

        def merged():
            name, n = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            uniq, at, back = np.unique(name, return_index=True, return_inverse=True)
            words, langs = (pa.concat_arrays([x[k] for x in held]).take(pa.array(at)) for k in (2, 3))
            return uniq, np.bincount(back, n, len(uniq)).astype(np.int64), words, langs

        def out():
            name, n, words, langs = merged()
            for lo in range(0, len(name), 100_000):
                part = slice(lo, lo + 100_000)
                yield pa.RecordBatch.from_arrays([langs[part].cast(pa.string()), words[part].cast(pa.string()), pa.array(name[part].view(np.int64)), pa.array(n[part])],
                                                 names=["lang", "word", "name", "n"])

        for b in batches:
            langs = b.column(2).cast(pa.large_string())
            for w, flat, name, _, row in _scanned(b.column(0), b.column(1)):
                if not len(name):
                    continue
                uniq, at, n = np.unique(name, return_index=True, return_counts=True)
                held.append((uniq, n, _texts(flat, w.lo[at], w.hi[at]), langs.take(pa.array(row[at]))))
                first = np.unique(row, return_index=True)[1]
                each = np.diff(np.append(first, len(row)))
                tags, of, back = np.unique(np.asarray(b.column(0))[row[first]], return_index=True, return_inverse=True)
                # a language's total goes by a name that no word has (words' names are odd)
                held.append((mix(tags.view(_U)) & ~_U(1), np.bincount(back, each, len(tags)).astype(np.int64),
                             pa.array([""] * len(tags), pa.large_string()), langs.take(pa.array(row[first][of]))))
                size += len(uniq)
                if size > HELD:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield from out()
                        held, size = [], 0
        if held:
            yield from out()

    got = texts.mapInArrow(run, "lang string, word string, name long, n long")
    return got.groupBy("lang", "word", "name").agg(F.sum("n").alias("n"))


def _named(parts: list[np.ndarray]) -> np.ndarray:
    """64-bit name of a phrase's words, in order."""
    out = mix(parts[0])
    for p in parts[1:]:
        out = mix(out * _PRIME + p)
    return out


def _places(name: np.ndarray) -> list[np.ndarray]:
    h = mix(name ^ _U(0x5851F42D4C957F2D))
    return [(k & _U(FILTER_BITS - 1)).astype(np.int64) for k in (h, h >> _U(32))]


def fixed_filter(phrases: DataFrame, k: int) -> bytes:
    """Bits of all phrases of k words (columns s1 to sk): the same size for any
    number of them; tasks' parts are merged by bitwise or."""

    def run(batches):
        bits = np.zeros(FILTER_BITS // 8, np.uint8)
        for b in batches:
            for at in _places(_named([np.asarray(b.column(j)).view(_U) for j in range(k)])):
                np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        words = bits.view(np.int64)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at])], names=["at", "word"])

    got = phrases.select(*_S[:k]).mapInArrow(run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    words = np.zeros(FILTER_BITS // 64, np.int64)
    words[np.asarray(got["at"])] = np.asarray(got["word"])
    return words.tobytes()


def _in_filter(name: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether the filter has the names' bits: of every phrase in it, and a few others."""
    often = np.ones(len(name), bool)
    for at in _places(name):
        often &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
    return often


def frequent_runs(texts: DataFrame, words: DataFrame) -> DataFrame:
    """(names): the texts' runs of two or more words that may be frequent (column
    s1 of ``words``), inside a piece, as packed word names with a zero after each run."""
    sent = texts.sparkSession.sparkContext.broadcast(fixed_filter(words, 1))

    def run(batches):
        bits = np.frombuffer(sent.value, np.uint8)
        for b in batches:
            for _, _, name, end, _ in _scanned(b.column(0), b.column(1)):
                often = np.where(_in_filter(_named([name]), bits), name, _U(0))
                closes = end == np.arange(1, len(name) + 1)
                stream = np.zeros(len(name) + int(closes.sum()), _U)
                stream[np.arange(len(name)) + np.cumsum(closes) - closes] = often
                word = stream != 0
                beside = word.copy()
                beside[:-1] &= word[1:]             # the next one is a word, too
                beside[-1:] = False
                beside[1:] |= word[1:] & beside[:-1]
                stream[~beside] = 0
                use = beside.copy()
                use[1:] |= beside[:-1]              # the zero after the run
                stream = stream[use]
                zero = np.flatnonzero(stream == 0)
                lo = 0
                while lo < len(stream):             # a row ends with a run
                    hi = int(zero[min(np.searchsorted(zero, lo + STRETCH), len(zero) - 1)]) + 1
                    yield pa.RecordBatch.from_arrays([pa.array([stream[lo:hi].tobytes()], pa.binary())], names=["names"])
                    lo = hi

    return texts.select("key", "text").mapInArrow(run, "names binary")


def _runs(batches):
    """(name of each word, end of its run) of each row of packed runs."""
    for b in batches:
        for raw in b.column(0):
            name = np.frombuffer(raw.as_buffer(), _U)
            zero = np.flatnonzero(name == 0)
            yield name, np.repeat(zero, np.diff(zero, prepend=-1))


def _possible(name: np.ndarray, end: np.ndarray, k: int, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, name) of the phrases of k words inside a piece whose first and last k - 1 words are in the filter."""
    m = len(name) - k + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    part = _named([name[j:len(name) - k + 2 + j] for j in range(k - 1)])
    often = _in_filter(part, bits)
    at = np.flatnonzero(often[:m] & often[1:m + 1] & (np.arange(m) + k <= end[:m]))
    return at, mix(part[at] * _PRIME + name[at + k - 1])


def _cell(phrase: np.ndarray) -> np.ndarray:
    return (phrase >> _U(40)).astype(np.int64) & (CELLS - 1)


def _by_chunk(packed: DataFrame, keys: list[str], merged, schema: str) -> DataFrame:
    """``merged(key, rows)`` for all rows of one key, which come one after the
    other; rows are read as they arrive, a batch at a time."""

    def run(batches):
        def rows():
            for b in batches:
                yield from zip(zip(*[b.column(k).to_pylist() for k in range(len(keys))]), *[b.column(k) for k in range(len(keys), b.num_columns)])

        for key, group in itertools.groupby(rows(), key=lambda r: r[0]):
            yield from merged(key, ([x.as_buffer() for x in r[1:]] for r in group))

    return packed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def crowded_cells(runs: DataFrame, sent, k: int, min_count: int) -> bytes:
    """Bits of the cells whose possible phrases of k words occur ``min_count``
    times together. Tasks send their cells in chunks; a chunk's parts are added up as
    they come in."""

    def run(batches):
        bits = np.frombuffer(sent.value, np.uint8)
        have = np.zeros(CELLS, np.uint8)
        for name, end in _runs(batches):
            cell, n = np.unique(_cell(_possible(name, end, k, bits)[1]), return_counts=True)
            have[cell] = np.minimum(have[cell] + n, min(min_count, 255))
        for c in np.flatnonzero(have.reshape(-1, CHUNK).any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([have[c * CHUNK:(c + 1) * CHUNK].tobytes()], pa.binary())], names=["chunk", "counts"])

    def add(key, rows):
        have = np.zeros(CHUNK, np.int32)
        for (raw,) in rows:
            have = np.minimum(have + np.frombuffer(raw, np.uint8), min_count)
        # a count that a byte cannot hold says nothing
        yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([np.packbits(have >= min(min_count, 255), bitorder="little").tobytes()], pa.binary())], names=["chunk", "bits"])

    with small_batches(runs.sparkSession, PACKED):
        got = _by_chunk(runs.mapInArrow(run, "chunk long, counts binary"), ["chunk"], add, "chunk long, bits binary").toArrow()
    out = np.zeros((CELLS // CHUNK, CHUNK // 8), np.uint8)
    for c, raw in zip(got["chunk"].to_pylist(), got["bits"].to_pylist()):
        out[c] = np.frombuffer(raw, np.uint8)
    return out.tobytes()


def candidates(runs: DataFrame, parts: DataFrame, k: int, min_count: int) -> DataFrame:
    """(s1, ..., sk): the phrases of k words that occur ``min_count`` times and
    whose first and last k - 1 words are in ``parts``."""
    context = runs.sparkSession.sparkContext
    sent = context.broadcast(fixed_filter(parts, k - 1))
    crowd = context.broadcast(crowded_cells(runs, sent, k, min_count))

    def summed(held):
        cols = [np.concatenate(x) for x in zip(*held)]
        uniq, at, back = np.unique(cols[0], return_index=True, return_inverse=True)
        return [uniq, np.minimum(np.bincount(back, cols[1], len(uniq)), min_count).astype(np.int64), *[c[at] for c in cols[2:]]]

    def run(batches):
        bits, cells = np.frombuffer(sent.value, np.uint8), np.frombuffer(crowd.value, np.uint8)
        held, size = [], 0

        def out():
            name, n, *words = summed(held)
            pack = (name >> _U(54)).astype(np.int64)       # names are in order, and so are their packs
            edge = np.searchsorted(pack, np.arange(PACKS + 1))
            table = np.column_stack([n.view(_U), *words])
            some = np.flatnonzero(np.diff(edge))
            return pa.RecordBatch.from_arrays([pa.array(some), pa.array([table[edge[c]:edge[c + 1]].tobytes() for c in some.tolist()], pa.binary())], names=["pack", "phrases"])

        for name, end in _runs(batches):
            at, phrase = _possible(name, end, k, bits)
            cell = _cell(phrase)
            on = (cells[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 > 0
            at, phrase = at[on], phrase[on]
            if not len(at):
                continue
            uniq, first, n = np.unique(phrase, return_index=True, return_counts=True)
            held.append([uniq, n, *[name[at[first] + j] for j in range(k)]])
            size += len(uniq)
            if size > HELD:
                held = [summed(held)]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    def add(key, rows):
        held, size = [], 0
        for (raw,) in rows:
            table = np.frombuffer(raw, _U).reshape(-1, k + 1)
            words = [np.ascontiguousarray(table[:, j + 1]) for j in range(k)]
            held.append([_named(words), table[:, 0].astype(np.int64), *words])
            size += len(table)
            if size > HELD:
                held = [summed(held)]
                size = len(held[0][0])
        _, n, *words = summed(held)
        yield pa.RecordBatch.from_arrays([pa.array(x[n >= min_count].view(np.int64)) for x in words], names=_S[:k])

    return _by_chunk(runs.mapInArrow(run, "pack long, phrases binary"), ["pack"], add, ", ".join(f"{s} long" for s in _S[:k]))


class DoubleArrayTrie:
    """Transition of state s by symbol c: t = base[s] + c, if check[t] is s.
    State 0 is the root; ``state[p]`` is the accepting state of phrase p. A
    word is ``digits`` symbols, its number (rare words last) to the base 256 plus
    one: with so few symbols the children of nodes fit between each other."""

    def __init__(self, phrases: np.ndarray):
        """``phrases``: distinct rows of word names, zeros at the end."""
        self.words, times = np.unique(phrases[phrases != 0], return_counts=True)
        self.number = np.zeros(len(self.words), np.int32)
        self.number[np.argsort(-times, kind="stable")] = np.arange(len(self.words))
        self.base, self.check = np.zeros(NEAR, np.int32), np.full(NEAR, -1, np.int32)
        self.check[0] = -2
        self._set_digits()
        number = np.where(phrases != 0, self.numbers(phrases), -1)
        self.state = np.zeros(len(phrases), np.int64)
        for k in range(phrases.shape[1]):
            rows = np.flatnonzero(number[:, k] >= 0)
            for shift in self.shifts:
                key = self.state[rows] * 257 + self._symbol(number[rows, k], shift)
                uniq, back = np.unique(key, return_inverse=True)
                self.state[rows] = self._placed(uniq // 257, uniq % 257)[back] if len(rows) else 0
        used = int(np.flatnonzero(self.check != -1)[-1]) + 1
        self.base, self.check = self.base[:used].copy(), self.check[:used].copy()

    def _set_digits(self):
        digits = 1
        while 256 ** digits < len(self.words):
            digits += 1
        self.shifts = [8 * k for k in range(digits - 1, -1, -1)]

    @staticmethod
    def _symbol(number, shift):
        return (number >> shift & 255) + 1

    def _grow(self, size):
        if size > len(self.check):
            more = max(size - len(self.check), len(self.check) // 8, 4096)
            self.base = np.concatenate([self.base, np.zeros(more, np.int32)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int32)])

    def _placed(self, parent, child):
        """States of all (parent, child) edges of a level, parents in order."""
        first = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]])) if len(parent) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(parent)))
        state, start = np.zeros(len(parent), np.int64), 1
        for g in np.flatnonzero(count > 1)[np.argsort(-count[count > 1], kind="stable")].tolist():
            edges = slice(first[g], first[g] + count[g])
            c = child[edges]
            base, start = self._fit(c, start)
            state[edges] = base + c
            self.check[state[edges]] = parent[first[g]]
            self.base[parent[first[g]]] = base
        one = first[count == 1]
        free = np.flatnonzero(self.check == -1)[:len(one)]
        if len(free) < len(one):        # the last free places are beyond the end
            size = len(self.check)
            self._grow(size + len(one) - len(free))
            free = np.concatenate([free, np.arange(size, size + len(one) - len(free))])
        state[one] = free
        self.check[free] = parent[one]
        self.base[parent[one]] = free - child[one]
        return state

    def _fit(self, c, start):
        """(base at which all of c is free, where to look next time): first fit
        among the next ``NEAR`` free places, else behind the last one used."""
        width = 4 * NEAR
        while True:
            free = np.flatnonzero(self.check[start:start + width] == -1)[:NEAR] + start
            if len(free) == NEAR:
                break
            if start + width >= len(self.check):
                self._grow(start + 2 * width)
            width *= 2
        if width > 16 * NEAR:       # few places are left up to here
            start = int(free[NEAR // 2])
        at = free[:, None] + (c - c[0])[None, :]
        self._grow(int(at[-1, -1]) + 1)
        fits = np.flatnonzero((self.check[at] == -1).all(axis=1))
        if len(fits):
            return int(free[fits[0]] - c[0]), start
        last = int(np.flatnonzero(self.check != -1)[-1])
        self._grow(last + 2 + int(c[-1] - c[0]))
        return last + 1 - int(c[0]), start

    def numbers(self, name: np.ndarray) -> np.ndarray:
        """Number of each word, -1 if the trie has none."""
        if not len(self.words):
            return np.full(name.shape, -1)
        at = np.minimum(np.searchsorted(self.words, name), len(self.words) - 1)
        return np.where(self.words[at] == name, self.number[at], -1)

    def count(self, name: np.ndarray, end: np.ndarray, into: np.ndarray, at: np.ndarray | None = None) -> None:
        """Add to ``into`` how often each state is reached from a position (of
        those in ``at``), inside its piece: all positions go on a level at a time."""
        at = np.arange(len(name)) if at is None else at
        state = np.zeros(len(at), np.int64)
        for level in range(LONGEST):
            on = at + level < end[at]
            at, state = at[on], state[on]
            word = self.numbers(name[at + level])
            on = word >= 0
            at, state, word = at[on], state[on], word[on]
            for shift in self.shifts:
                to = self.base[state] + self._symbol(word, shift)
                on = (to >= 0) & (to < len(self.check))
                on[on] = self.check[to[on]] == state[on]
                at, state, word = at[on], to[on], word[on]
            if not len(at):
                return
            if level:
                np.add.at(into, state, 1)

    def packed(self) -> list[bytes]:
        return [x.tobytes() for x in (self.words, self.number, self.base, self.check, self.state)]

    @classmethod
    def unpacked(cls, packed: list[bytes]) -> DoubleArrayTrie:
        out = cls.__new__(cls)
        out.words, out.number, out.base, out.check, out.state = (np.frombuffer(x, kind) for x, kind in zip(packed, (_U, np.int32, np.int32, np.int32, np.int64)))
        out._set_digits()
        return out


def _shard(first: np.ndarray, second: np.ndarray, shards: int) -> np.ndarray:
    """Shard of the phrases that begin with these two words."""
    return (_named([first, second]) % _U(shards)).astype(np.int64)


def tries(phrases: DataFrame, shards: int) -> DataFrame:
    """(shard, words, number, base, check, state, phrases): one row for each of ``shards``
    tries over (s1, ..., s4); ``phrases`` has the words of every phrase, in order."""

    def deal(batches):
        for b in batches:
            shard = _shard(*[np.asarray(b.column(k)).view(_U) for k in (0, 1)], shards)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shard)], names=[*_S, "shard"])

    def build(table: pa.Table) -> pa.Table:
        rows = np.column_stack([np.asarray(table[s]).view(_U) for s in _S])
        trie = DoubleArrayTrie(rows)
        return pa.table({"shard": pa.array([table["shard"][0].as_py()], pa.int64()), **{c: pa.array([x], pa.binary()) for c, x in zip(("words", "number", "base", "check", "state", "phrases"), [*trie.packed(), rows.tobytes()])}})

    dealt = phrases.select(*_S).mapInArrow(deal, ", ".join(f"{s} long" for s in _S) + ", shard long")
    return dealt.groupBy("shard").applyInArrow(build, "shard long, words binary, number binary, base binary, check binary, state binary, phrases binary")


def frequencies(runs: DataFrame, phrases: DataFrame, shard: int = SHARD, at_once: int = TRIES) -> DataFrame:
    """(s1, ..., s4, a): how often each phrase occurs in all runs."""
    spark = runs.sparkSession
    shards = max(1, -(-phrases.count() // shard))
    made = written(tries(phrases, shards), "tries")
    sums = []
    for lo in range(0, shards, at_once):
        got = made.filter(F.col("shard").between(lo, lo + at_once - 1)).drop("phrases").collect()      # at_once tries of about ``shard`` phrases
        sent = spark.sparkContext.broadcast([(r[0], [bytes(x) for x in r[1:]]) for r in got])

        def run(batches, sent=sent):
            all_tries = [(number, DoubleArrayTrie.unpacked(x)) for number, x in sent.value]
            sums = [np.zeros(len(t.check), np.int64) for _, t in all_tries]
            for name, end in _runs(batches):
                at = np.flatnonzero(np.arange(len(name)) + 1 < end)
                of = _shard(name[at], name[at + 1], shards)
                for (number, t), into in zip(all_tries, sums):
                    t.count(name, end, into, at[of == number])
            for (number, t), into in zip(all_tries, sums):
                n = into[t.state]
                some = [c for c in range(0, len(n), PLACES) if n[c:c + PLACES].any()]
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(some), pa.int64()), pa.array(some, pa.int64()), pa.array([n[c:c + PLACES].tobytes() for c in some], pa.binary())],
                                                 names=["shard", "first", "counts"])

        sums.append(runs.mapInArrow(run, "shard long, first long, counts binary"))

    def add(key, rows):
        n = 0
        for (raw,) in rows:
            n = n + np.frombuffer(raw, np.int64)
        place = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), key[0])), pa.array(key[1] + place), pa.array(n[place])], names=["shard", "place", "a"])

    total = sums[0]
    for more in sums[1:]:
        total = total.unionAll(more)
    total = _by_chunk(total, ["shard", "first"], add, "shard long, place long, a long")

    def listed(batches):
        for b in batches:
            for number, raw in zip(b.column(0).to_pylist(), b.column(1)):
                rows = np.frombuffer(raw.as_buffer(), np.int64).reshape(-1, LONGEST)
                for lo in range(0, len(rows), 100_000):
                    part = rows[lo:lo + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), number)), pa.array(np.arange(lo, lo + len(part))), *[pa.array(np.ascontiguousarray(part[:, k])) for k in range(LONGEST)]],
                                                     names=["shard", "place", *_S])

    names = made.select("shard", "phrases").mapInArrow(listed, "shard long, place long, " + ", ".join(f"{s} long" for s in _S))
    return names.join(total, ["shard", "place"]).select(*_S, "a")


def _phrase(first: int, last: int) -> list:
    """Words first to last (from 0) as the key columns of a phrase."""
    return [F.col(_S[k]) if k <= last else F.lit(0) for k in range(first, last + 1)] + [F.lit(0).cast("long")] * (LONGEST - 1 - last + first)


def _key(first: int, last: int):
    return F.struct(*[c.cast("long").alias(s) for c, s in zip(_phrase(first, last), _S)])


def _size():
    return sum((F.when(F.col(s) != 0, 1).otherwise(0) for s in _S), F.lit(0))


def scored(phrases: DataFrame, every: DataFrame, words: DataFrame, scale: int = SCALE) -> DataFrame:
    """(s1, ..., s4, a, l, r, score) by each phrase's lowest-scoring cut (the
    first of several); ``every`` has all frequent phrases, ``words`` is (s1, n)."""
    known = every.select(*_S, "a").unionAll(words.select("s1", *[F.lit(0).cast("long").alias(s) for s in _S[1:]], F.col("n").alias("a")))
    cut = [F.when(F.lit(k) < F.col("size"), F.struct(F.lit(k).alias("k"), _key(0, k - 1).alias("left"), _key(k, LONGEST - 1).alias("right"))) for k in range(1, LONGEST)]
    cuts = phrases.withColumn("size", _size()).select(*_S, "a", F.explode(F.array_compact(F.array(*cut))).alias("cut"))
    for side, n in (("left", "l"), ("right", "r")):
        keys = [F.col(f"cut.{side}.{s}").alias(f"{side}_{s}") for s in _S]
        cuts = cuts.select("*", *keys).join(known.select(*[F.col(s).alias(f"{side}_{s}") for s in _S], F.col("a").alias(n)), [f"{side}_{s}" for s in _S])
    number = F.expr(f"(cast(a as decimal(20,0)) * {scale}) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = cuts.select(*_S, "a", F.struct(number.alias("score"), F.col("cut.k").alias("k"), "l", "r").alias("best")).groupBy(*_S, "a").agg(F.min("best").alias("best"))
    return best.select(*_S, "a", "best.l", "best.r", "best.score")


def uncovered(phrases: DataFrame, covered: int = COVERED) -> DataFrame:
    """``phrases`` without those that a longer phrase holds in ``covered`` percent of their occurrences."""
    parts = [F.when(F.col("size") == k, _key(lo, hi)) for k in range(3, LONGEST + 1) for lo in range(k - 1) for hi in range(lo + 1, k) if hi - lo < k - 1]
    held = (phrases.withColumn("size", _size()).filter("size > 2").select(F.explode(F.array_compact(F.array(*parts))).alias("part"), "a")
            .groupBy(*[F.col(f"part.{s}").alias(s) for s in _S]).agg(F.max("a").alias("longer")))
    kept = phrases.join(held, _S, "left")
    return kept.filter(f"longer is null or cast(longer as decimal(20,0)) * 100 < cast(a as decimal(20,0)) * {covered}").drop("longer")


def mine_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, keep: int = KEEP,
                 shard: int = SHARD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``keep`` best phrases of each language.

    Words are runs of anything but space, tab and ``.,;:!?`` or line controls,
    A-Z lower-cased; a phrase does not run over the latter. ``a`` is the
    phrase's number of occurrences (overlaps included, ``min_count`` at least), ``l`` and ``r`` those of its
    two parts at the lowest-scoring cut, ``n`` the language's words, ``score``
    floor(2,000,000 a / (l + r)). Phrases that lie inside a longer one in 80 % of
    their occurrences are left out. Null texts have no words; a null language is
    ``und``; repeated rows count each time; equal scores are ordered by ``a`` and
    then by the phrase's bytes. Other columns are not looked at; an empty table
    gives an empty result."""
    lang = F.coalesce(F.col(lang_col), F.lit(NO_LANGUAGE))
    texts = docs.select(F.xxhash64(lang).alias("key"), F.col(text_col).alias("text"), lang.alias("lang"))
    words = written(count_words(texts).filter((F.col("n") >= min_count) | (F.col("word") == "")), "words")
    totals = words.filter("word = ''").select("lang", F.col("n").alias("total"))
    often = words.filter("word <> ''").select("lang", "word", F.col("name").alias("s1"), "n")
    runs = written(frequent_runs(texts, often), "runs", large_rows=True)
    spark, levels, parts = docs.sparkSession, [], often.select("s1")
    for k in range(2, LONGEST + 1):
        found = candidates(runs, parts, k, min_count)
        with small_batches(spark, PACKED):
            parts = written(found, f"phrases-{k}")
        levels.append(parts.select(*_S[:k], *[F.lit(0).cast("long").alias(s) for s in _S[k:]]))
    every = levels[0]
    for more in levels[1:]:
        every = every.unionAll(more)
    counted = frequencies(runs, every, shard).filter(F.col("a") >= min_count)
    with small_batches(spark, PACKED):
        phrases = written(counted, "frequent")
    rows = written(scored(uncovered(phrases), phrases, often), "scored")
    for k, s in enumerate(_S):
        named = often.select(F.col("s1").alias(s), F.col("word").alias(f"w{k}"), *([F.col("lang")] if k == 0 else []))
        rows = rows.join(named, s, "inner" if k < 2 else "left")
    rows = rows.select("lang", F.concat_ws(" ", *[f"w{k}" for k in range(LONGEST)]).alias("phrase"), "a", "l", "r", "score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = rows.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= keep)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")

