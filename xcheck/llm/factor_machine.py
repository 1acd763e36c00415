"""Quality classifier: a factorisation machine.

Features of a text are its hashed words, statistics of its structure and what
the row says of it besides (``n_chars``), all as one sparse vector x. The score
is the logistic of ``w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j``: pairs of
features weigh in by the product of two short vectors, and the sum over all
pairs is found in linear time as half of ``sum_f (sum_i v_if x_i)^2 - sum_i (v_if x_i)^2``.

Labels, language, source and id are never features. Training reads a bounded
sample: of each label the ``per_label`` distinct texts with the smallest hashes
(so copies of a text weigh once, and a label with any text is never without
one). Ids and hashes alone are joined with the labels; the chosen texts are then
fetched by their ids. Scoring reads whole texts in the tasks, without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import with_results, written
from .words import SPACES, byte_class, mix, pieces, scan, utf8

PER_LABEL = 2000        # distinct texts of a label that train the machine, at most
BITS = 13               # hashed word features: 2^BITS
RANK = 8
EPOCHS = 12
BATCH = 64
RATE, DECAY = 0.05, 1e-4
LEAST = 0.3             # score from which a text is predicted to be good
STEPS = 12              # cells of each statistic
_STATISTICS = ["words", "word_length", "upper", "digit", "symbol", "stop", "comma", "other_ascii", "beyond_ascii", "line_words", "same_lines", "same_words", "repeats",
               "longest", "row_chars"]
SIZE = (1 << BITS) + len(_STATISTICS) * STEPS

_CLASSES = byte_class(SPACES, True)
_U = np.uint64
_KIND = np.zeros(256, np.int8)          # 1 upper, 2 digit, 3 symbol, 4 full stop and the like, 5 comma and the like, 6 other ASCII, 7 beyond ASCII
_KIND[33:127] = 6
_KIND[list(range(65, 91))] = 1
_KIND[list(range(48, 58))] = 2
_KIND[list(b"#*$%&|<>{}[]=\\^~_@+/")] = 3
_KIND[list(b".!?")] = 4
_KIND[list(b",;:")] = 5
_KIND[list(range(97, 123))] = 0
_KIND[128:] = 7


def _cell(value: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.searchsorted(edges, value, "right")


_SHARE = np.array([1e-9, 0.002, 0.005, 0.01, 0.02, 0.04, 0.07, 0.12, 0.2, 0.35, 0.6])
_COUNT = np.array([1, 3, 8, 20, 50, 120, 300, 800, 2000, 5000, 12000], float)
_LENGTH = np.array([1e-9, 2, 3, 3.6, 4.2, 4.8, 5.4, 6, 6.8, 8, 12])


def _distinct(key: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Number of different keys of each row."""
    if not len(key):
        return np.zeros(rows, np.int64)
    order = np.lexsort((key, row))
    k, r = key[order], row[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    return np.bincount(r[new], minlength=rows)


def featured(text: pa.Array, chars: np.ndarray):
    """Per piece of rows: (first row, last row, row, feature, value) of the
    sparse vectors, ordered by row. Words have norm 1 together, and so have the
    statistics; ``chars`` is what the rows say of their lengths (-1: nothing)."""
    data, off = utf8(text)
    for lo, hi in pieces(off):
        d, o = data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        rows = hi - lo
        w = scan(d, o, _CLASSES)
        n = np.diff(w.first)
        owner = np.repeat(np.arange(rows), n)
        bucket = (w.hash >> _U(64 - BITS)).astype(np.int64)
        # distinct (row, bucket): present or not, however often
        cell = np.unique(owner * (1 << BITS) + bucket)
        row, feature = cell >> BITS, cell & ((1 << BITS) - 1)
        value = 1 / np.sqrt(np.bincount(row, minlength=rows).clip(1))[row]
        kind = _KIND[d]
        length = np.diff(o)
        upto = np.zeros(len(d) + 1, np.int64)

        def share(k):
            np.cumsum(kind == k, out=upto[1:])
            return (upto[o[1:]] - upto[o[:-1]]) / length.clip(1)

        ends = np.flatnonzero(d == 10)
        line_of = np.searchsorted(ends, w.lo)           # lines of different texts differ by row
        line_row = line_of + owner * (len(ends) + 1)
        lines = _distinct(line_row, owner, rows)
        # a line's words in order, as one number
        start = np.flatnonzero(np.concatenate([[True], line_row[1:] != line_row[:-1]])) if len(line_row) else np.zeros(0, np.int64)
        said = np.add.reduceat(mix(w.hash + np.arange(len(w.hash), dtype=_U) - np.repeat(start, np.diff(np.append(start, len(w.hash)))).astype(_U)), start) if len(start) else np.zeros(0, _U)
        other_lines = _distinct(said, owner[start], rows)
        words = _distinct(w.hash, owner, rows)
        two = mix(w.hash[:-1] * _U(3) + w.hash[1:]) if len(w.hash) > 1 else np.zeros(0, _U)
        inside = owner[:-1] == owner[1:]
        pairs = _distinct(two[inside], owner[:-1][inside], rows)
        size = np.zeros(len(w.hash) + 1, np.int64)
        np.cumsum(w.hi - w.lo, out=size[1:])
        longest = np.zeros(rows, np.int64)
        np.maximum.at(longest, owner, w.hi - w.lo)
        told = chars[lo:hi]
        cells = [_cell(n, _COUNT), _cell((size[w.first[1:]] - size[w.first[:-1]]) / n.clip(1), _LENGTH), *[_cell(share(k), _SHARE) for k in range(1, 8)],
                 _cell(n / lines.clip(1), _COUNT), _cell(1 - other_lines / lines.clip(1), _SHARE), _cell(1 - words / n.clip(1), _SHARE),
                 _cell(1 - pairs / (n - 1).clip(1), _SHARE), _cell(longest, _COUNT), np.where(told < 0, 0, np.minimum(1 + _cell(told, _COUNT * 6), STEPS - 1))]
        number = (1 << BITS) + np.arange(len(cells)) * STEPS + np.column_stack(cells)
        row = np.concatenate([row, np.repeat(np.arange(rows), len(cells))])
        feature = np.concatenate([feature, number.ravel()])
        value = np.concatenate([value, np.full(number.size, 1 / np.sqrt(len(cells)))])
        order = np.argsort(row, kind="stable")
        yield lo, hi, row[order], feature[order], value[order].astype(np.float32)


class FactorMachine:
    """Weights ``w0``, ``w`` and factors ``v`` (SIZE, RANK)."""

    def __init__(self, size: int = SIZE, rank: int = RANK, seed: int = 11):
        self.w0, self.w = 0.0, np.zeros(size)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (size, rank))

    def margins(self, rows: int, row: np.ndarray, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
        """w0 + linear part + half of (square of the sum - sum of the squares), per row."""
        out = np.full(rows, self.w0) + np.bincount(row, self.w[feature] * value, rows)
        for f in range(self.v.shape[1]):
            x = self.v[feature, f] * value
            out += 0.5 * (np.bincount(row, x, rows) ** 2 - np.bincount(row, x * x, rows))
        return out

    def fit(self, row, feature, value, label, epochs: int = EPOCHS, seed: int = 5) -> FactorMachine:
        """Log loss by mini-batches with adaptive steps (sums of squared gradients)."""
        rows = len(label)
        first = np.searchsorted(row, np.arange(rows + 1))
        share = label.mean()
        self.w0 = float(np.log(share / (1 - share)))
        seen_w, seen_v, seen_0 = np.full(len(self.w), 1e-8), np.full(self.v.shape, 1e-8), 1e-8
        order = np.random.default_rng(seed)
        for _ in range(epochs):
            turn = order.permutation(rows)
            for at in range(0, rows, BATCH):
                pick = turn[at:at + BATCH]
                size = first[pick + 1] - first[pick]
                to = np.concatenate([[0], np.cumsum(size)])
                place = np.arange(to[-1]) + np.repeat(first[pick] - to[:-1], size)
                r, j, x = np.repeat(np.arange(len(pick)), size), feature[place], value[place].astype(float)
                vx = self.v[j] * x[:, None]
                total = np.zeros((len(pick), self.v.shape[1]))
                np.add.at(total, r, vx)
                margin = self.w0 + np.bincount(r, self.w[j] * x, len(pick)) + 0.5 * (total ** 2).sum(axis=1) - 0.5 * np.bincount(r, (vx ** 2).sum(axis=1), len(pick))
                slope = (1 / (1 + np.exp(-margin.clip(-30, 30))) - label[pick]) / len(pick)
                used, back = np.unique(j, return_inverse=True)
                gw = np.bincount(back, slope[r] * x, len(used)) + DECAY * self.w[used]
                gv = np.zeros((len(used), self.v.shape[1]))
                np.add.at(gv, back, (slope[r] * x)[:, None] * (total[r] - vx))
                gv += DECAY * self.v[used]
                g0 = slope.sum()
                seen_w[used] += gw ** 2
                seen_v[used] += gv ** 2
                seen_0 += g0 ** 2
                self.w[used] -= RATE * gw / np.sqrt(seen_w[used])
                self.v[used] -= RATE * gv / np.sqrt(seen_v[used])
                self.w0 -= RATE * g0 / np.sqrt(seen_0)
        return self


def _chars(column: pa.Array | None, rows: int) -> np.ndarray:
    return np.full(rows, -1) if column is None else np.asarray(column.cast(pa.int64()).fill_null(-1))


def training_texts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, chars_col: str | None, per_label: int) -> DataFrame:
    """(text, chars, label): of each label the ``per_label`` distinct texts with
    the smallest hashes. A document with several labels has the lowest."""
    marks = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    chars = F.col(chars_col).cast("long") if chars_col else F.lit(None).cast("long")
    ids = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("hash")).filter("id is not null")
    named = written(ids.join(marks, "id").groupBy("label", "hash").agg(F.min("id").alias("id")), "labelled")
    chosen = named.filter("label = 0").orderBy("hash").limit(per_label).unionAll(named.filter("label = 1").orderBy("hash").limit(per_label))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), chars.alias("chars"))
    got = texts.join(F.broadcast(chosen), "id").filter(F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("hash"))      # 2 * per_label rows at most
    return got.dropDuplicates(["label", "hash"]).select("text", "chars", "label")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          chars_col: str | None = "n_chars", per_label: int = PER_LABEL) -> FactorMachine | float:
    """The machine; a number (the smoothed share of label 1) if the labels are
    not of both kinds, for then nothing can be told apart."""

    def run(batches):
        for b in batches:
            label = np.asarray(b.column(2))
            for lo, hi, row, feature, value in featured(b.column(0), _chars(b.column(1), b.num_rows)):
                first = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(label[lo:hi]), pa.ListArray.from_arrays(pa.array(first), pa.array(feature.astype(np.int32))),
                                                  pa.ListArray.from_arrays(pa.array(first), pa.array(value))], names=["label", "feature", "value"])

    chosen = training_texts(docs, labels, id_col, text_col, label_col, chars_col, per_label)
    got = chosen.mapInArrow(run, "label int, feature array<int>, value array<float>").orderBy("label", "feature").toArrow()
    label = np.asarray(got["label"]) == 1
    if label.all() or not label.any():
        return float((label.sum() + 1) / (len(label) + 2))
    feature, value = got["feature"].combine_chunks(), got["value"].combine_chunks()
    row = np.repeat(np.arange(len(label)), np.asarray(feature.value_lengths()))
    return FactorMachine().fit(row, np.asarray(feature.flatten()), np.asarray(value.flatten()), label.astype(float))


def score_quality(docs: DataFrame, model: FactorMachine | float, text_col: str = "text", chars_col: str | None = "n_chars", score_col: str = "score") -> DataFrame:
    """All columns of ``docs`` plus ``score_col`` (0 to 1, higher: label 1 is
    likelier). Null texts are empty ones; every row has a score. Whole texts are
    read; rows are independent; the new column's name must be free."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at_text = docs.columns.index(text_col)
    at_chars = docs.columns.index(chars_col) if chars_col else None
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    both = plain.withColumn("both", F.struct(F.col(f"c{at_text}").cast("string").alias("text"), (F.col(f"c{at_chars}") if at_chars is not None else F.lit(None)).cast("long").alias("chars")))

    def compute(column):
        text, chars = column.field("text"), _chars(column.field("chars"), len(column))
        if isinstance(sent.value, float):
            yield 0, len(column), [pa.array(np.full(len(column), sent.value))]
            return
        for lo, hi, row, feature, value in featured(text, chars):
            yield lo, hi, [pa.array(1 / (1 + np.exp(-sent.value.margins(hi - lo, row, feature, value).clip(-30, 30))))]

    return with_results(both, "both", compute, [("score", "double")]).drop("both").toDF(*docs.columns, score_col)


def held_out(id_column):
    """True where crc32 of the id as text can be divided by 5."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def classify_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                     chars_col: str | None = "n_chars", least: float = LEAST, per_label: int = PER_LABEL) -> DataFrame:
    """(id, held_out, score, predicted), one row for each row of ``docs``; only
    labels of rows that are not held out are learned from. ``predicted`` is 1 if
    the score reaches ``least``. A null id counts as the empty text for the fold
    and has no label; null and empty texts are scored by their statistics;
    repeated rows each have their row and train once. Without labels of both
    kinds every score is the smoothed share of label 1 (one half without any).
    Other columns are not looked at; an empty table gives an empty result."""
    cols = [F.col(id_col).alias(id_col), F.col(text_col).alias("text"), (F.col(chars_col) if chars_col else F.lit(None)).cast("long").alias("chars")]
    plain = docs.select(*cols)
    known = labels.filter(~held_out(F.col(id_col)))
    model = train(plain.filter(~held_out(F.col(id_col))), known, id_col, "text", label_col, "chars", per_label)
    rows = score_quality(plain, model, "text", "chars")
    return rows.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
