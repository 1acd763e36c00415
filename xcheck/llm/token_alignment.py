"""Cross-tokenizer alignment by divide and conquer at shared cuts.

Two tokenizers split the same bytes differently. A byte offset at which tokens
of both end is a shared cut; between neighbouring cuts lie groups of tokens that
cover the same bytes. A group is found by dividing: near the middle of an
interval of tokens a token end of the one side is looked up by bisect among the
other side's ends; where both end, the interval is cut there and both halves go
on in the same way. An interval without such an end inside is a leaf, one group.
numpy takes a step of all open intervals at once.

Texts are first cut where both tokenizers always end a token (a space after an
ASCII character that is none), each distinct stretch between such places is
encoded and aligned once and kept by the worker for later batches, in flat arrays.
A text is the row of its stretches, so what is aligned once serves wherever it occurs.

Links are pairs of token occurrences whose byte ranges overlap. The texts of a
piece are aligned once and written as the piece's different stretches, their
links and the texts' places. From these the links of each pair of ids are
counted over the whole corpus by shuffle, and then looked up: pairs with more
than ``HOT`` of all links (fewer than ``1 / HOT`` of them) are sent to the tasks,
a text's other pairs meet their counts by join, so that no join key is hot.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sentencepiece_codec import Vocabulary
from .tables import give_back, small_batches, with_results, written
from .token_words import _hashes, stretches
from .words import pieces, utf8

KEPT = 400_000          # distinct stretches whose alignment a worker keeps
STEP = 1 << 18          # bytes of text whose stretches are looked up at a time
BATCH = 2_000           # texts that a task is sent at a time
PACKED = 4              # pieces that a task is sent at a time
HELD = 1_000_000        # distinct id pairs that a task holds before it sends them on
HOT = 2e-6              # share of all links above which a pair's count is sent to the tasks
WIDTH = 1 << 31         # a pair is first id * WIDTH + second id

_OPENS = np.arange(256) == 0x20
_BEFORE = np.ones(256, bool)
_BEFORE[[0x20, *range(9, 14), *range(0x1C, 0x20)]] = False
_BEFORE[128:] = False


def shared_groups(end_a: np.ndarray, end_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First token of every group on each side, in order.

    ``end_a`` and ``end_b`` are rising byte offsets of token ends; part ``i``
    has the tokens ``first_a[i]:first_a[i + 1]`` and ``first_b[i]:first_b[i + 1]``,
    which cover the same bytes. Every interval looks for a common end next to its
    middle: the middle one, then by turns one further to the right and to the left."""
    a0, a1, b0, b1 = (x.astype(np.int64) for x in (first_a[:-1], first_a[1:], first_b[:-1], first_b[1:]))
    filled = a1 > a0
    a0, a1, b0, b1 = a0[filled], a1[filled], b0[filled], b1[filled]
    tried = np.zeros(len(a0), np.int64)
    leaves = []
    while len(a0):
        inner = a1 - a0 - 1         # token ends strictly inside
        leaf = (tried >= inner) | (b1 - b0 < 2)
        if leaf.any():
            leaves.append((a0[leaf], b0[leaf]))
            a0, a1, b0, b1, tried, inner = (x[~leaf] for x in (a0, a1, b0, b1, tried, inner))
            if not len(a0):
                break
        # 0, +1, -1, +2, ... from the middle; every inner end comes once
        step = (tried + 1) // 2 * np.where(tried % 2, 1, -1)
        probe = a0 + (inner - 1) // 2 + step
        at = np.searchsorted(end_b, end_a[probe])       # ends rise over all parts: bisect inside the interval gives the same
        hit = end_b[np.minimum(at, len(end_b) - 1)] == end_a[probe]
        cut_a, cut_b = probe[hit] + 1, at[hit] + 1
        tried = np.concatenate([np.where(hit, 0, tried + 1), np.zeros(len(cut_a), np.int64)])
        a0, b0 = np.concatenate([a0, cut_a]), np.concatenate([b0, cut_b])
        a_left, b_left = a1.copy(), b1.copy()
        a_left[hit], b_left[hit] = cut_a, cut_b
        a1, b1 = np.concatenate([a_left, a1[hit]]), np.concatenate([b_left, b1[hit]])
    if not leaves:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = (np.concatenate(x) for x in zip(*leaves))
    order = np.argsort(a)
    return a[order], b[order]


def overlaps(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token of a, token of b) of all pairs whose byte ranges overlap: between
    two neighbouring ends of either side lies just one pair."""
    ends = np.union1d(end_a, end_b)
    return np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)


class ByteLevelTokens:
    """Ids of a byte-level vocabulary file, and their bytes. The file's merges
    are in the order of their ids, so its entries are ranks; its pre-tokenizer is
    the byte-level one with its usual pattern. A cut before a space is a token
    end, so stretches that do not end in white space are encoded in one call."""

    PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, file: str):
        import json

        import tiktoken
        with open(file, encoding="utf-8") as f:
            model = json.load(f)
        # the byte-level alphabet: printable Latin-1 characters stand for themselves, the other bytes for U+0100 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        special = {t["content"] for t in model["added_tokens"]}
        vocabulary = {t: i for t, i in model["model"]["vocab"].items() if t not in special}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocabulary.items()}
        known = model["model"]["vocab"]
        last = -1
        for m in model["model"]["merges"]:
            to = known["".join(m if isinstance(m, list) else m.split(" "))]
            if to <= last:
                raise ValueError("merges that are not in the order of their ids")
            last = to
        self.model = tiktoken.Encoding("alignment", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.bytes[i] = t
        self.length = np.array([len(x) for x in self.bytes], np.int64)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        alone = [k for k, w in enumerate(words) if w[:1] != b" " or w[-1:].isspace() or w[-1] > 127]
        parts: list = [None] * len(words)
        for k in alone:
            parts[k] = self.model.encode_ordinary(words[k].decode())
        mark = set(alone)
        many = [k for k in range(len(words)) if k not in mark]
        flat = np.array(self.model.encode_ordinary(b"".join([words[k] for k in many]).decode()), np.int64)
        upto = np.searchsorted(np.cumsum(self.length[flat]), np.cumsum([len(words[k]) for k in many], dtype=np.int64), "right")
        if not alone:
            return flat, np.diff(upto, prepend=0)
        listed = flat.tolist()
        for k, x, y in zip(many, [0, *upto.tolist()], upto.tolist()):
            parts[k] = listed[x:y]
        return np.array([i for x in parts for i in x], np.int64), np.array([len(x) for x in parts], np.int64)


class PieceTokens:
    """Ids of a SentencePiece model file, and their lengths in bytes."""

    def __init__(self, file: str):
        self.vocabulary = Vocabulary(file)
        self.bytes = self.vocabulary.out
        self.length = np.array([len(x) for x in self.bytes], np.int64)
        if not self.vocabulary.cuts:
            raise ValueError("pieces that hold an inner space cannot be aligned by stretches")

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return self.vocabulary.encode(words)


class Aligner:
    """Aligned stretches of a worker. Per stretch: tokens of each side, groups,
    links (as pairs of ids) and the groups as text (each after a semicolon); a
    stretch that one side does not give back byte by byte is marked as lost."""

    def __init__(self, a, b):
        self.a, self.b = a, b
        # tokens in a group's text, by what stands before them: the first of a, another of a, the first of b, another of b
        self.said = np.array([f"{mark}{i}" for mark, side in ((";", a), (",", a), ("|", b), (",", b)) for i in range(len(side.bytes))], object)
        self.said_size = np.array([len(x) for x in self.said], np.int64)
        self.clear()

    def clear(self):
        self.hash = np.zeros(0, np.uint64)          # rising
        self.number = np.zeros(0, np.int32)         # stretch of each hash
        self.text = bytearray()
        self.text_first = np.zeros(1, np.int64)
        self.sizes = np.zeros((0, 4), np.int32)     # tokens of a and b, groups, lost
        self.pairs = np.zeros(0, np.int64)
        self.first = np.zeros(1, np.int64)

    def _learn(self, words: list[bytes]):
        ids, counts, ends, lost = [], [], [], np.zeros(len(words), bool)
        size = np.array([len(w) for w in words], np.int64)
        for side in (self.a, self.b):
            flat, count = side.encode(words)
            upto = np.concatenate([[0], np.cumsum(side.length[flat])])
            first = np.concatenate([[0], np.cumsum(count)])
            lost |= upto[first[1:]] - upto[first[:-1]] != size
            if b"".join([side.bytes[i] for i in flat.tolist()]) != b"".join(words):
                spans = zip(first[:-1].tolist(), first[1:].tolist(), words)
                lost |= np.array([b"".join([side.bytes[i] for i in flat[x:y].tolist()]) != w for x, y, w in spans], bool)
            ids.append(flat), counts.append(count)
        for k, side in enumerate((self.a, self.b)):
            good = np.repeat(~lost, counts[k])
            ids[k] = ids[k][good]
            counts[k] = np.where(lost, 0, counts[k])
            ends.append(np.cumsum(side.length[ids[k]]))
        firsts = [np.concatenate([[0], np.cumsum(c)]) for c in counts]
        group_a, group_b = shared_groups(*ends, *firsts)
        groups = np.diff(np.searchsorted(group_a, firsts[0]))
        at_a, at_b = overlaps(*ends)
        links = np.diff(np.searchsorted(at_a, firsts[0]))
        self.sizes = np.concatenate([self.sizes, np.column_stack([*counts, groups, lost]).astype(np.int32)])
        self.pairs = np.concatenate([self.pairs, ids[0][at_a].astype(np.int64) * WIDTH + ids[1][at_b]])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(links)])
        # a group's tokens of a, then those of b
        n, size = [len(x) for x in ids], [len(side.bytes) for side in (self.a, self.b)]
        first = [np.zeros(k, bool) for k in n]
        first[0][group_a] = first[1][group_b] = True
        of = [np.cumsum(f) - 1 for f in first]
        said = np.empty(sum(n), np.int64)
        said[np.arange(n[0]) + np.append(group_b, n[1])[of[0]]] = np.where(first[0], 0, size[0]) + ids[0]
        said[np.arange(n[1]) + np.append(group_a, n[0])[of[1] + 1]] = 2 * size[0] + np.where(first[1], 0, size[1]) + ids[1]
        self.text += "".join(self.said[said].tolist()).encode()
        upto = np.concatenate([[0], np.cumsum(self.said_size[said])])
        self.text_first = np.concatenate([self.text_first, self.text_first[-1] + upto[(firsts[0] + firsts[1])[1:]]])

    def stretches(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(stretch at each place, first place of each text) of consecutive texts;
        every text begins with the space that both sides see."""
        start = stretches(data, offsets, _OPENS, _BEFORE)
        if not len(start):
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        end = np.append(start[1:], len(data))
        h, first, back = np.unique(_hashes(data, start), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hash, h)
        known = np.zeros(len(h), bool)
        inside = np.flatnonzero(at < len(self.hash))
        known[inside] = self.hash[at[inside]] == h[inside]
        word = np.zeros(len(h), np.int32)
        word[known] = self.number[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            self._learn([raw[x:y] for x, y in zip(start[first[new]].tolist(), end[first[new]].tolist())])
            word[new] = np.arange(len(self.hash), len(self.hash) + len(new))
            self.hash, self.number = np.insert(self.hash, at[new], h[new]), np.insert(self.number, at[new], word[new])
        return word[back], np.searchsorted(start, offsets)

    def column(self, column: pa.Array):
        """(first row, last row, stretches, places of each text) in pieces."""
        data, off = utf8(column)
        for lo, hi in pieces(off):
            if len(self.hash) > KEPT:
                self.clear()
            words, firsts, n = [], [np.zeros(1, np.int64)], 0
            for x, y in pieces(off[lo:hi + 1], STEP):
                d, o = data[off[lo + x]:off[lo + y]], off[lo + x:lo + y + 1] - off[lo + x]
                filled = o[1:] > o[:-1]
                d = np.insert(d, o[:-1][filled], 0x20)
                word, first = self.stretches(d, o + np.concatenate([[0], np.cumsum(filled)]))
                words.append(word), firsts.append(first[1:] + n)
                n += len(word)
            yield lo, hi, np.concatenate(words), np.concatenate(firsts)

    def sums(self, word: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(tokens of a and b, groups, lost stretches, links) of each text."""
        out = np.zeros((len(first) - 1, 5), np.int64)
        upto = np.zeros(len(word) + 1, np.int64)
        for k in range(5):
            np.cumsum(self.sizes[word, k] if k < 4 else self.first[word + 1] - self.first[word], out=upto[1:])
            out[:, k] = upto[first[1:]] - upto[first[:-1]]
        return out

    def said_of(self, word: np.ndarray) -> bytes:
        """The groups of a text."""
        text = self.text
        return b"".join([text[x:y] for x, y in zip(self.text_first[word].tolist(), self.text_first[word + 1].tolist())])[1:]

    def links(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pairs of the places in order, place of each)."""
        size = self.first[word + 1] - self.first[word]
        to = np.concatenate([[0], np.cumsum(size)])
        return self.pairs[np.arange(to[-1]) + np.repeat(self.first[word] - to[:-1], size)], np.repeat(np.arange(len(word)), size)


_ALIGNERS: dict[tuple, Aligner] = {}


def _aligner(file_a: str, file_b: str) -> Aligner:
    """Once per worker."""
    key = (file_a, file_b)
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(ByteLevelTokens(file_a), PieceTokens(file_b))
    return _ALIGNERS[key]


def token_groups(docs: DataFrame, file_a: str, file_b: str, text_col: str = "text", groups_col: str = "groups") -> DataFrame:
    """All columns of ``docs`` plus ``groups_col``: each text's groups as
    ``a1,a2|b1;a3|b2`` (decimal ids of both sides in order). Null and empty
    texts, and texts that one side does not give back, have the empty string."""

    def compute(column):
        aligner = _aligner(file_a, file_b)
        for lo, hi, word, first in aligner.column(column):
            lost = aligner.sums(word, first)[:, 3] > 0
            yield lo, hi, [pa.array(["" if gone else aligner.said_of(word[x:y]).decode()
                                     for x, y, gone in zip(first[:-1].tolist(), first[1:].tolist(), lost.tolist())], pa.string())]

    return with_results(docs, text_col, compute, [(groups_col, "string")])


_PIECE = ["n_a", "n_b", "n_groups", "n_links", "sha"]


def aligned_pieces(docs: DataFrame, file_a: str, file_b: str) -> DataFrame:
    """One row per piece of texts, from (id, text): ids and what is known of each
    text, and, packed, the different pairs of the piece, the links of its
    different stretches (as places among the pairs), where each stretch's links
    begin, the stretches at the texts' places, and where each text begins. Texts that
    one side does not give back have no places."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            aligner = _aligner(file_a, file_b)
            for lo, hi, word, first in aligner.column(b.column(1)):
                sums = aligner.sums(word, first)
                lost = sums[:, 3] > 0
                sums[lost] = 0
                said = [hashlib.sha256(aligner.said_of(word[x:y])).hexdigest() if y > x and not gone else ""
                        for x, y, gone in zip(first[:-1].tolist(), first[1:].tolist(), lost.tolist())]
                size = np.where(lost, 0, np.diff(first))
                some, back = np.unique(word[np.repeat(~lost, np.diff(first))], return_inverse=True)
                linked, place = aligner.links(some)
                pairs, links = np.unique(linked, return_inverse=True)
                packed = [pairs, links.astype(np.int32), np.searchsorted(place, np.arange(len(some) + 1)).astype(np.int32), back.astype(np.int32), np.concatenate([[0], np.cumsum(size)])]
                lists = [b.column(0).slice(lo, hi - lo), *[pa.array(np.ascontiguousarray(sums[:, k])) for k in (0, 1, 2, 4)], pa.array(said, pa.string())]
                ends = pa.array([0, hi - lo], pa.int32())
                yield pa.RecordBatch.from_arrays([*[pa.ListArray.from_arrays(ends, x) for x in lists], *[pa.array([x.tobytes()], pa.binary()) for x in packed]],
                                                 names=["ids", *_PIECE, "pairs", "links", "edges", "places", "firsts"])
                give_back()
        for aligner in _ALIGNERS.values():
            aligner.clear()
        give_back()

    schema = f"ids array<{kind}>, " + ", ".join(f"{c} array<{'string' if c == 'sha' else 'bigint'}>" for c in _PIECE)
    return docs.select("id", "text").mapInArrow(run, schema + ", pairs binary, links binary, edges binary, places binary, firsts binary")


def _unpacked(row: list) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x, kind in zip(row, (np.int64, np.int32, np.int32, np.int32, np.int64))]


def pair_counts(pieces_of_texts: DataFrame) -> DataFrame:
    """(pair, n, best): how often each pair of ids is linked in all texts, and
    whether no other pair of its second id is linked more often."""

    def run(batches):
        held, size = [], 0

        def merged():
            pair, n = (np.concatenate(x) for x in zip(*held))
            uniq, back = np.unique(pair, return_inverse=True)
            order = np.argsort(back, kind="stable")
            return uniq, np.add.reduceat(n[order], np.searchsorted(back[order], np.arange(len(uniq)))) if len(uniq) else n

        for b in batches:
            for row in zip(*b.columns):
                pairs, links, edges, places, _ = _unpacked(row)
                times = np.bincount(places, minlength=len(edges) - 1)
                n = np.bincount(links, np.repeat(times, np.diff(edges)), len(pairs)).astype(np.int64)       # of one piece: exact in a float
                held.append((pairs, n))
                size += len(pairs)
                if size > HELD:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["pair", "n"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], names=["pair", "n"])
        held = []
        give_back()

    packed = pieces_of_texts.select("pairs", "links", "edges", "places", "firsts")
    with small_batches(pieces_of_texts.sparkSession, PACKED):
        pairs = written(packed.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    second = F.expr(f"pair % {WIDTH}L")
    most = pairs.groupBy(second.alias("second")).agg(F.max("n").alias("most"))       # one row an id
    return pairs.withColumn("second", second).join(most, "second").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align_tokens(docs: DataFrame, file_a: str, file_b: str, id_col: str = "doc_id", text_col: str = "text", hot: float = HOT) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row for each row of ``docs``.

    Side a encodes a space and the text with the byte-level vocabulary ``file_a``,
    side b the text with the SentencePiece model ``file_b`` (which puts the space
    before it itself). ``count_sum`` adds up, over the text's links, how often the link's pair of
    ids is linked in all texts; ``n_best`` counts the links whose pair is its second id's most
    frequent one, ties included. ``groups_sha256`` is the hash of the groups, as
    ``a1,a2|b1;a3|b2``. Null and empty texts, and texts that one side does not
    give back byte by byte, have no tokens: zeros and the empty string. Repeated
    rows and ids count each time and keep their rows; other columns are not
    looked at; an empty table gives an empty result."""
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    with small_batches(spark, BATCH):
        made = written(aligned_pieces(plain, file_a, file_b), "pieces", large_rows=True)
    counts = written(pair_counts(made), "pair-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = counts.filter(F.col("n") > hot * total).toArrow()       # fewer than 1 / hot rows
    order = np.argsort(np.asarray(often["pair"]))
    sent = spark.sparkContext.broadcast((np.asarray(often["pair"])[order], np.asarray(often["n"])[order], np.asarray(often["best"])[order]))

    def run(batches):
        known, count, best = sent.value
        for b in batches:
            for row in zip(*b.columns[len(_PIECE) + 1:], range(b.num_rows)):
                pairs, links, edges, places, firsts = _unpacked(row[:-1])
                at = np.minimum(np.searchsorted(known, pairs), max(0, len(known) - 1))
                is_hot = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
                totals = []
                for x in (count, best):
                    of_pair = np.where(is_hot, x[at], 0).astype(np.int64) if len(known) else np.zeros(len(pairs), np.int64)
                    upto = np.concatenate([[0], np.cumsum(of_pair[links])])
                    upto = np.concatenate([[0], np.cumsum((upto[edges[1:]] - upto[edges[:-1]])[places])])
                    totals.append(upto[firsts[1:]] - upto[firsts[:-1]])
                # links of the other pairs, text by text
                cold = np.flatnonzero(~is_hot[links])
                edge = np.searchsorted(cold, edges)
                few = np.diff(edge)
                use = np.flatnonzero(few[places] > 0)
                size = few[places[use]]
                to = np.concatenate([[0], np.cumsum(size)])
                rest = pairs[links[cold[np.arange(to[-1]) + np.repeat(edge[places[use]] - to[:-1], size)]]] if len(use) else np.zeros(0, np.int64)
                text = np.repeat(np.searchsorted(firsts, use, "right") - 1, size)
                k, n = row[-1], len(firsts) - 1
                own = [b.column(j).slice(k, 1).flatten() for j in range(len(_PIECE) + 1)]
                yield pa.RecordBatch.from_arrays([*own, *[pa.array(x) for x in totals],
                                                  pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(n + 1)).astype(np.int32)), pa.array(rest))], names=names)
        give_back()

    names = ["id", *_PIECE, "hot_sum", "hot_best", "cold"]
    kinds = [plain.schema["id"].dataType.simpleString(), *["long"] * 4, "string", "long", "long", "array<long>"]
    rows = made.mapInArrow(run, ", ".join(f"{c} {k}" for c, k in zip(names, kinds)))
    with small_batches(spark, PACKED):
        rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "aligned")
    cold = rows.select("row", F.explode("cold").alias("pair")).groupBy("row", "pair").agg(F.count("*").alias("times"))
    met = cold.join(counts.filter(F.col("n") <= hot * total), "pair")
    rest = met.groupBy("row").agg(F.sum(F.col("n") * F.col("times")).alias("cold_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("cold_best"))
    zero = F.lit(0).cast("long")
    both = rows.join(rest, "row", "left")
    sums = [(F.col("hot_best") + F.coalesce("cold_best", zero)).alias("n_best"), (F.col("hot_sum") + F.coalesce("cold_sum", zero)).alias("count_sum"), F.col("sha").alias("groups_sha256")]
    return both.select(F.col("id").alias(id_col), *_PIECE[:-1], *sums)
