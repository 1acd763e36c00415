"""LM scoring by cross-entropy difference.

A target model (documents labelled of good quality) and a background model (all
documents) score each document: the difference of their mean losses per token
says whether the text is more like the target. Both are bigram models with
unigram back-off over one vocabulary, every word of the corpus, and they are
matched in size: the background's counts are scaled to the target's token total.

Counts are exact and cover all documents. Words and contexts are counted first;
words of more than ``HOT / WORDS`` of all tokens (fewer than ``WORDS / HOT``) are
hot: their counts are sent to the tasks. A pair of two words above ``HOT * WORDS``
that makes up more than ``HOT`` itself (fewer than ``1 / HOT``) is sent too, so
that no key has many rows. Every other pair with a hot word crosses one shuffle, a
row for each document that has it: its task counts it, knows both words, and gives
its losses back to the documents, summed by document. The few pairs of two cold words meet the counts of both
by join. The one shuffle goes part by part of the keys, over texts read again, and
its files are freed after each part: the disk holds one part at a time. Words are
named by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import shuffles_freed, written
from .words import SPACES, byte_class, mix, pieces, scan, utf8

BACK_OFF = 0.4          # weight of the unigram estimate
HOT = 1e-5              # share of all tokens above which a pair is sent to the tasks
WORDS = 10              # hot words start at a tenth of that share, the words of such pairs at ten times
PARTS = 2               # parts of the pairs, one on disk at a time; a power of two
HELD = 2_000_000        # distinct names a task holds before it sends them on
START = 0               # the word before a text's first

# what stands beside a pair's key: a hot word's place, twice (one more if the key is the context), or
BOTH = 1 << 40          # the key is a pair of places
AS_WORD, AS_CONTEXT = -2, -1    # the key's own counts, in ``n`` (targets) and ``doc`` (all)
PLACE_BITS = 32
SUMS = "doc long, n long, sum_0 double, sum_1 double"
PLACE_MASK = (1 << PLACE_BITS) - 1

_CLASSES = byte_class(SPACES, True)
_U = np.uint64
_PRIME = _U(0x9E3779B97F4A7C15)


def _pieces_of(column):
    data, off = utf8(column)
    for lo, hi in pieces(off):
        yield lo, hi, scan(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], _CLASSES)


def _positions(w) -> tuple[np.ndarray, np.ndarray]:
    """(is a text's first word, row) of every word."""
    first = np.zeros(len(w.hash), bool)
    first[w.first[:-1][w.first[:-1] < w.first[1:]]] = True
    return first, np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))


def _summed(name, *counts):
    """The counts of each name added up."""
    uniq, back = np.unique(name, return_inverse=True)
    return uniq, *(np.bincount(back, x, len(uniq)).astype(np.int64) for x in counts)


def _added(texts: DataFrame, names, fields: str) -> DataFrame:
    """Sums by name over all texts (doc, is_target, text); ``names`` gives (names,
    counts ...) of one piece. A task adds up its own before it sends them."""
    labels = [f.split()[0] for f in fields.split(", ")]

    def run(batches):
        held, size = [], 0

        def merged():
            return _summed(*(np.concatenate(x) for x in zip(*held)))

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in rows], names=labels)

        for b in batches:
            flag = np.asarray(b.column(1)).astype(np.int64)
            for lo, hi, w in _pieces_of(b.column(2)):
                held.append(_summed(*names(w, flag[lo:hi])))
                size += len(held[-1][0])
                if size > HELD:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield out(held[0])
                        held, size = [], 0
        if held:
            yield out(merged())

    return texts.mapInArrow(run, fields).groupBy(labels[0]).agg(*[F.sum(c).alias(c) for c in labels[1:]])


def _word_counts(w, flag):
    """Each word's occurrences, in targets and in all, and those with a word after it; START comes before first words."""
    first, row = _positions(w)
    last = np.roll(first, -1)
    one, is_target = np.ones(len(row), np.int64), flag[row]
    starts = is_target[first]
    return (np.concatenate([w.hash, np.full(len(starts), START, _U)]), np.concatenate([is_target, 0 * starts]), np.concatenate([one, 0 * starts]),
            np.concatenate([is_target * ~last, starts]), np.concatenate([one * ~last, 0 * starts + 1]))


class Model:
    """Losses of pairs from counts; model 0 is the target, 1 the background."""

    def __init__(self, size: int, target: int, whole: int, back_off: float):
        self.back_off = back_off
        self.scale = 1.0, min(1.0, max(1, target) / max(1, whole))      # matched size
        self.total = [max(1.0, n * s + size) for n, s in zip((target, whole), self.scale)]

    def loss(self, k, pair, word, before, log=np.log):
        """Of model ``k``, from the counts of pair, word and context (arrays, or columns with ``F.log``)."""
        alone = (word * self.scale[k] + 1) / self.total[k]
        return -log(self.back_off * alone + (1 - self.back_off) * (pair * self.scale[k] + alone) / (before * self.scale[k] + 1))


class Sent:
    """The hot words' counts, and the hot pairs' losses, as tasks use them."""

    def __init__(self, words, common: float):
        order = np.argsort(words[0])
        self.name, *self.counts = (x[order] for x in words)
        self.counts = np.stack(self.counts)             # word in targets, in all, as context in targets, in all
        self.is_common = self.counts[1] > common        # a hot pair's words are common
        self.pair, self.losses = np.zeros(0, np.int64), np.zeros((2, 0))
        if len(self.name) and self.name[0] == START:
            self.is_common[0] = True

    def places(self, w, first) -> tuple[np.ndarray, np.ndarray]:
        """Place among the hot words of every word and of the one before it; -1: cold."""
        if not len(self.name):
            return np.full((2, len(first)), -1)
        at = np.minimum(np.searchsorted(self.name, w.hash), len(self.name) - 1)
        at[self.name[at] != w.hash] = -1
        before = np.roll(at, 1)
        before[first] = 0       # START
        return at, before

    def hot_pairs(self, word, before) -> np.ndarray:
        """Place among the hot pairs; -1: none."""
        if not len(self.pair):
            return np.full(len(word), -1)
        name = before << PLACE_BITS | word
        at = np.minimum(np.searchsorted(self.pair, name), len(self.pair) - 1)
        at[(self.pair[at] != name) | (word < 0) | (before < 0)] = -1
        return at


def _before(w, first) -> np.ndarray:
    before = np.roll(w.hash, 1)
    before[first] = START
    return before


def _doc_pairs(row, *names):
    """The distinct pairs of each text among words: (place of one of its words, how often)."""
    pair = row.astype(_U) + _U(1)
    for x in names:
        pair = mix(pair) * _PRIME + x.view(_U)
    _, one, n = np.unique(mix(pair), return_index=True, return_counts=True)
    order = np.argsort(one)      # a text's pairs stay together
    return one[order], n[order]


def _near_sums(texts: DataFrame, words: DataFrame, sent, model: Model, part: int) -> DataFrame:
    """Loss sums by doc of the pairs with one hot word or two that are not hot
    pairs, of one part of the keys. A pair's key is its cold word, or the pair of
    places; a cold word's counts go to its key's task ahead of the pairs."""

    def rows(batches):
        s = sent.value
        for b in batches:
            doc, flag = np.asarray(b.column(0)), np.asarray(b.column(1))
            for lo, hi, w in _pieces_of(b.column(2)):
                first, row = _positions(w)
                word, before = s.places(w, first)
                both = (word >= 0) & (before >= 0)
                key = np.where(both, before << PLACE_BITS | word, np.where(word < 0, w.hash.view(np.int64), _before(w, first).view(np.int64)))
                mine = np.where(both, mix(key.view(_U)).view(np.int64), key) & (PARTS - 1) == part
                at = np.flatnonzero(mine & ((word >= 0) | (before >= 0)))
                at = at[s.hot_pairs(word[at], before[at]) < 0]
                key, word, before, row = key[at], word[at], before[at], row[at]
                other = np.where(word < 0, 2 * before, np.where(before < 0, 2 * word + 1, BOTH))
                one, n = _doc_pairs(row, key, other)
                row = row[one] + lo
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[one], other[one], doc[row], np.where(flag[row], n, -n))],
                                                 names=["key", "other", "doc", "n"])

    def scored(key, other, doc, n):
        s = sent.value
        of = np.cumsum(np.diff(key, prepend=key[:1]) != 0)      # number of the row's key
        own = np.zeros((4, int(of[-1]) + 1), np.int64)
        for place, kind in ((0, AS_WORD), (2, AS_CONTEXT)):
            fact = other == kind
            own[place][of[fact]], own[place + 1][of[fact]] = n[fact], doc[fact]
        pairs = np.flatnonzero(other >= 0)
        if not len(pairs):
            return None
        key, other, doc, n, of = (x[pairs] for x in (key, other, doc, n, of))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (other[1:] != other[:-1])
        start, group = np.flatnonzero(new), np.cumsum(new) - 1
        key, other, of, size = key[start], other[start], of[start], np.abs(n)
        counts = np.add.reduceat(np.maximum(n, 0), start), np.add.reduceat(size, start)
        both, cold_word = other == BOTH, other & 1 == 0
        word, before = np.where(both, key & PLACE_MASK, other >> 1), np.where(both, key >> PLACE_BITS, other >> 1)
        sums = []
        for k in (0, 1):
            as_word = np.where(~both & cold_word, own[k][of], s.counts[k][np.where(~both & cold_word, 0, word)])
            as_context = np.where(~both & ~cold_word, own[2 + k][of], s.counts[2 + k][np.where(~both & ~cold_word, 0, before)])
            loss = model.loss(k, counts[k], as_word, as_context).astype(np.float32)
            sums.append(loss[group] * size.astype(float))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (doc, size, *sums)], names=["doc", "n", "sum_0", "sum_1"])

    def run(batches):
        """Whole keys at a time."""
        held, size, limit = [], 0, HELD // 4
        for b in batches:
            held.append([np.asarray(c) for c in b.columns])
            size += b.num_rows
            if size > limit:
                whole = [np.concatenate(x) for x in zip(*held)]
                cut = int(np.searchsorted(whole[0], whole[0][-1]))      # the last key may go on
                if cut and (got := scored(*(x[:cut] for x in whole))) is not None:
                    yield got
                held, size = [[x[cut:] for x in whole]], size - cut
                limit = max(HELD // 4, 2 * size)
        if size and (got := scored(*(np.concatenate(x) for x in zip(*held)))) is not None:
            yield got

    mine = words.filter(~F.col("is_hot") & (F.col("word").bitwiseAND(PARTS - 1) == part))
    facts = [mine.select(F.col("word").alias("key"), F.lit(kind).cast("long").alias("other"), F.col(f"{c}whole").alias("doc"), F.col(f"{c}target").alias("n"))
             for kind, c in ((AS_WORD, ""), (AS_CONTEXT, "before_"))]
    both = texts.mapInArrow(rows, "key long, other long, doc long, n long").unionByName(facts[0]).unionByName(facts[1])
    dealt = both.repartition("key").sortWithinPartitions("key", "other")
    return _by_doc(dealt.mapInArrow(run, SUMS).withColumn("copies", F.lit(0)))


def _own_and_far_sums(texts: DataFrame, words: DataFrame, sent, model: Model) -> DataFrame:
    """Loss sums by doc of the hot pairs, a row for every text, and of the pairs
    of two cold words: their counts meet the counts of both words by join."""

    def rows(batches):
        s = sent.value
        for b in batches:
            doc, flag = np.asarray(b.column(0)), np.asarray(b.column(1))
            for lo, hi, w in _pieces_of(b.column(2)):
                first, row = _positions(w)
                word, before = s.places(w, first)
                hot = s.hot_pairs(word, before)
                is_hot = hot >= 0
                own = [np.bincount(row[is_hot], x[hot[is_hot]], hi - lo).astype(float) for x in s.losses]
                at = np.flatnonzero((word < 0) & (before < 0))
                names, row_of = (_before(w, first)[at], w.hash[at]), row[at]
                one, n = _doc_pairs(row_of, *names)
                row_of = row_of[one] + lo
                k = len(one)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([doc[lo:hi], doc[row_of]])),
                    pa.array(np.concatenate([np.bincount(row[is_hot], minlength=hi - lo), np.where(flag[row_of], n, -n)])),
                    *[pa.array(np.concatenate([x, np.zeros(k)])) for x in own],
                    *[pa.concat_arrays([pa.nulls(hi - lo, pa.int64()), pa.array(x[one].view(np.int64))]) for x in names]],
                    names=["doc", "n", "sum_0", "sum_1", "before", "word"])

    found = written(texts.mapInArrow(rows, f"{SUMS}, before long, word long"), "own")
    own, far = found.filter("word is null"), found.filter("word is not null").select("doc", "n", "before", "word")
    pairs = far.groupBy("before", "word").agg(F.sum(F.greatest("n", F.lit(0))).alias("pair_0"), F.sum(F.abs("n")).alias("pair_1"))
    cold = words.filter(~F.col("is_hot"))
    pairs = pairs.join(cold.select("word", F.col("target").alias("word_0"), F.col("whole").alias("word_1")), "word")
    pairs = pairs.join(cold.select(F.col("word").alias("before"), F.col("before_target").alias("before_0"), F.col("before_whole").alias("before_1")), "before")
    loss = [model.loss(k, *(F.col(f"{c}_{k}") for c in ("pair", "word", "before")), log=F.log).cast("float").alias(f"loss_{k}") for k in (0, 1)]
    met = far.join(pairs.select("before", "word", *loss), ["before", "word"])
    met = met.select("doc", F.abs("n").alias("n"), *[(F.abs("n") * F.col(f"loss_{k}")).cast("double").alias(f"sum_{k}") for k in (0, 1)], F.lit(0).alias("copies"))
    return _by_doc(own.drop("before", "word").withColumn("copies", F.lit(1)).unionByName(met))


def _by_doc(sums: DataFrame) -> DataFrame:
    return sums.groupBy("doc").agg(*[F.sum(c).alias(c) for c in ("n", "sum_0", "sum_1", "copies")])


def _name_of(id_column, text):
    return F.xxhash64(id_column, F.xxhash64(text))


def cross_entropy_difference(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                             back_off: float = BACK_OFF, hot: float = HOT) -> DataFrame:
    """(id, n_words, target_loss, background_loss, score), one row for each row
    of ``docs``; ``targets`` has the ids of target documents in ``id_col``.
    ``score`` is target loss minus background loss per token: lower is more like
    the target.

    Null and word-less texts have no losses and no score (null). Repeated rows
    count and score each; a null id is no target. Without targets or documents
    the losses still stand (a model without counts is uniform). Other columns
    are not looked at."""
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("text"))
    with shuffles_freed(spark):
        wanted = targets.select(F.col(id_col).alias("__id")).filter("__id is not null").distinct()
        ids = docs.select(F.col(id_col).alias("__doc")).filter("__doc is not null").join(wanted, F.col("__doc") == F.col("__id"), "left_semi").distinct()
        flagged = plain.join(ids.withColumnRenamed("__doc", "__target"), F.col(id_col) == F.col("__target"), "left")
        texts = written(flagged.select(_name_of(F.col(id_col), F.col("text")).alias("doc"), F.col("__target").isNotNull().alias("is_target"), "text"), "texts")

        words = written(_added(texts, _word_counts, "word long, target long, whole long, before_target long, before_whole long"), "words")
        size, target, tokens = (x or 0 for x in words.agg(F.count_if(F.col("whole") > 0), F.sum("target"), F.sum("whole")).first())
        model = Model(size, target, tokens, back_off)
        words = words.withColumn("is_hot", (F.col("whole") > hot * tokens / WORDS) | (F.col("word") == START))
        found = words.filter("is_hot").drop("is_hot").toArrow()      # fewer than WORDS / hot rows
        sent = Sent([np.asarray(found[0]).view(_U), *(np.asarray(found[k]) for k in range(1, 5))], hot * tokens * WORDS)
        hot_words = spark.sparkContext.broadcast(sent)

        def common_pairs(w, flag):
            first, row = _positions(w)
            word, before = hot_words.value.places(w, first)
            common = np.append(hot_words.value.is_common, False)        # place -1
            at = np.flatnonzero(common[word] & common[before])
            return (before[at] << PLACE_BITS | word[at]).view(_U), flag[row[at]], np.ones(len(at), np.int64)

        often = _added(texts, common_pairs, "pair long, target long, whole long").filter(F.col("whole") > hot * tokens).toArrow()      # fewer than 1 / hot rows
        pair, *counts = (np.asarray(often[k]) for k in range(3))
        order = np.argsort(pair)
        sent.pair = pair[order]
        sent.losses = np.stack([model.loss(k, counts[k][order], sent.counts[k][sent.pair & PLACE_MASK], sent.counts[2 + k][sent.pair >> PLACE_BITS]).astype(np.float32)
                                for k in (0, 1)]).astype(float)
        known = spark.sparkContext.broadcast(sent)
        sums = written(_own_and_far_sums(texts, words, known, model), "sums")
        for part in range(PARTS):
            sums = sums.unionByName(written(_near_sums(texts, words, known, model, part), "sums"))

    # rows alike in id and text have the same sums, each of them once
    name = plain.select(id_col, _name_of(F.col(id_col), F.col("text")).alias("name"))
    both = name.join(_by_doc(sums), F.col("name") == F.col("doc"), "left")
    a, b = (F.when(F.col("n") > 0, F.col(f"sum_{k}") / F.col("n")) for k in (0, 1))
    n_words = F.expr("n div copies").alias("n_words")
    return both.select(id_col, n_words, a.alias("target_loss"), b.alias("background_loss"), (a - b).alias("score"))
