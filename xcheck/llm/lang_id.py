"""Language identification in two levels.

Linear support vector machines over hashed byte n-grams (1 to 3 bytes, of the
lower-cased text) first separate language families, one against the rest; inside
the predicted family, one-versus-one machines separate its languages and vote.
Training reads a bounded sample of labelled rows; prediction reads whole texts.

A text of no learned language can lie far on one side of every machine, so the
model also says how usual a text is: the mean log frequency of its n-grams, each
as in the learned language that has most of it. Score and usualness of the
learned rows set what a text must reach to count as identified.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import with_results, written
from .words import pieces, utf8

# Families of common languages; any other language is a family of its own.
FAMILY = {
    **dict.fromkeys("en de nl sv da no nb nn is af fy lb".split(), "germanic"),
    **dict.fromkeys("fr es it pt ro ca gl oc la".split(), "romance"),
    **dict.fromkeys("ru uk be bg sr hr bs mk sl cs sk pl".split(), "slavic"),
    **dict.fromkeys("fi et hu".split(), "uralic"),
    **dict.fromkeys("hi ur bn mr ne pa gu".split(), "indic"),
}
BITS = 12               # hashed feature space of 2^BITS
PER_LANGUAGE = 240      # distinct labelled texts a language gives at most
ROUNDS = 30
UNKNOWN = "und"
LOW = 0.01              # quantile of the learned rows' scores and usualness
PART = 0.5              # share of that score, and of that mean n-gram frequency, which a text must reach (at most its inverse above)
RARE = 1e-6             # least frequency of an n-gram

_SIZE = 1 << BITS
_U32 = np.uint32
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[*range(0, 65), *range(91, 97), *range(123, 128)]] = 32


def _grams(b: np.ndarray) -> list[np.ndarray]:
    """Feature of the 1-, 2- and 3-grams that start at each byte."""
    x = b.astype(_U32)
    two, three = x.copy(), x.copy()
    two[:-1] = x[:-1] * _U32(257) + x[1:] + _U32(0x10000)
    three[:-2] = (x[:-2] * _U32(257) + x[1:-1]) * _U32(257) + x[2:] + _U32(0x2000000)
    return [((g * _U32(0x9E3779B1)) >> _U32(32 - BITS)).astype(np.int64) for g in (x, two[:-1], three[:-2])]


def _prepared(data: np.ndarray) -> np.ndarray:
    return _FOLD[data]


def features(column) -> np.ndarray:
    """Row-normalised n-gram frequencies (training sample only)."""
    data, off = utf8(column)
    out = np.zeros((len(off) - 1, _SIZE), np.float32)
    for k in range(len(off) - 1):
        b = _prepared(data[off[k]:off[k + 1]])
        if len(b) > 2:
            for g in _grams(b):
                out[k] += np.bincount(g, minlength=_SIZE)
            out[k] /= 3 * len(b)
    return out


def linear_svm(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, cost: float = 1.0) -> np.ndarray:
    """Weights (bias last) of an L2-regularised squared-hinge machine by dual
    coordinate descent; classes weigh alike."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    share = {s: len(y) / (2 * max(1, (y == s).sum())) for s in (-1, 1)}
    soft = np.array([1 / (2 * cost * share[s]) for s in y])
    diagonal = (x * x).sum(axis=1) + soft
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for i in order.permutation(len(x)):
            gradient = y[i] * (x[i] @ w) - 1 + soft[i] * alpha[i]
            step = max(alpha[i] - gradient / diagonal[i], 0.0) - alpha[i]
            if step:
                alpha[i] += step
                w += step * y[i] * x[i]
    return w


class Hierarchy:
    """Family machines and, per family, one machine for each pair of languages."""

    def __init__(self, x: np.ndarray, languages: list[str], family=FAMILY, rounds: int = ROUNDS):
        self.languages = sorted(set(languages))
        label = np.array([self.languages.index(v) for v in languages])
        self.families = sorted({family.get(v, v) for v in self.languages})
        self.family_of = np.array([self.families.index(family.get(v, v)) for v in self.languages])
        scale = 1 / (x.std(axis=0) + 1e-4) / np.sqrt(_SIZE)
        z = x * scale
        rows, self.machines = [], []      # (kind, positive, negative)
        if len(self.families) > 1:
            for f in range(len(self.families)):
                rows.append(linear_svm(z, np.where(self.family_of[label] == f, 1, -1), rounds))
                self.machines.append(("family", f, -1))
        for a in range(len(self.languages)):
            for b in range(a + 1, len(self.languages)):
                if self.family_of[a] == self.family_of[b]:
                    pick = (label == a) | (label == b)
                    rows.append(linear_svm(z[pick], np.where(label[pick] == a, 1, -1), rounds))
                    self.machines.append(("pair", a, b))
        w = np.array(rows).reshape(len(rows), _SIZE + 1)
        self.weight = (w[:, :-1] * scale).astype(np.float32)
        self.bias = w[:, -1].astype(np.float32)
        often = np.stack([x[label == k].mean(axis=0) for k in range(len(self.languages))]).max(axis=0)
        self.usual = np.log(np.maximum(often, RARE)).astype(np.float32)
        _, score = self._decided(x @ self.weight.T + self.bias)
        self.least_score = float(np.quantile(score, LOW)) * PART
        low, high = np.quantile((x @ self.usual) / x.sum(axis=1).clip(1e-9), [LOW, 1 - LOW])
        self.usual_range = float(low + np.log(PART)), float(high - np.log(PART))      # beyond: blanks and digits around a letter

    def margins(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """(texts, machines) margins over whole texts, and how usual each is."""
        n = len(off) - 1
        out = np.zeros((n, len(self.machines) + 1), np.float64)
        inside = np.zeros(n, np.int64)
        if len(data):
            # a text's n-grams do not run into the next one: they are cut by its length
            length = np.diff(off)
            grams = _grams(_prepared(data)) if len(data) > 2 else []
            for k, g in enumerate(grams):
                upto = np.maximum(length - k, 0)
                stop = np.minimum(off[:-1] + upto, len(g))
                inside += stop - np.minimum(off[:-1], stop)
                for m, weight in enumerate([*self.weight, self.usual]):
                    run = np.zeros(len(g) + 1, np.float64)
                    np.cumsum(weight[g], out=run[1:])
                    out[:, m] += run[stop] - run[np.minimum(off[:-1], stop)]
            out[:, :-1] /= np.maximum(3 * length, 1)[:, None]
        return out[:, :-1] + self.bias, out[:, -1] / np.maximum(inside, 1)

    def predict(self, data: np.ndarray, off: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, reaches what the learned rows ask for) of each text."""
        m, usual = self.margins(data, off)
        best, score = self._decided(m)
        return [self.languages[k] for k in best], score, (score >= self.least_score) & (usual >= self.usual_range[0]) & (usual <= self.usual_range[1])

    def _decided(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the language, score) by the machines' margins."""
        n = len(m)
        sure = 1 / (1 + np.exp(-2 * np.clip(m, -15, 15)))
        family_p = np.zeros((n, len(self.families)))
        if len(self.families) == 1:
            family_p[:] = 1
        votes, certain = np.zeros((n, len(self.languages))), np.ones((n, len(self.languages)))
        for k, (kind, a, b) in enumerate(self.machines):
            if kind == "family":
                family_p[:, a] = sure[:, k]
            else:
                votes[:, a] += sure[:, k] > 0.5
                votes[:, b] += sure[:, k] <= 0.5
                certain[:, a] = np.minimum(certain[:, a], sure[:, k])
                certain[:, b] = np.minimum(certain[:, b], 1 - sure[:, k])
        chosen = family_p.argmax(axis=1)
        inside = self.family_of[None, :] == chosen[:, None]
        best = np.where(inside, votes + certain * 0.5, -1).argmax(axis=1)
        score = family_p.max(axis=1) * certain[np.arange(n), best]
        return best, np.clip(score, 0, 1)


def train(labelled: DataFrame, text_col: str, lang_col: str, per_language: int = PER_LANGUAGE) -> Hierarchy | None:
    """Fit on ``per_language`` distinct texts a language at most, those with the
    smallest hashes: copies weigh once, and no language with a text is without
    one. Features are made in the tasks. None if there is no labelled text."""
    named = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang is not null and length(text) > 2").withColumn("hash", F.xxhash64("text"))
    order = Window.partitionBy("lang").orderBy("hash")
    chosen = written(named.select("lang", "hash").distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_language).drop("rank"), "drawn")
    if chosen.isEmpty():
        return None
    # a task sends one row of each chosen text
    sample = named.join(F.broadcast(chosen), ["lang", "hash"]).groupBy("lang", "hash").agg(F.max("text").alias("text")).select("text", "lang")

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                x = features(part.column(0))
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), part.column(1)], names=["x", "lang"])

    got = sample.mapInArrow(run, "x binary, lang string").orderBy("lang", "x").toArrow()
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(got.num_rows, _SIZE)
    return Hierarchy(x, got["lang"].to_pylist())


def predict(docs: DataFrame, model: Hierarchy | None, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score",
            sure_name: str = "__sure") -> DataFrame:
    """All columns of ``docs`` plus the predicted language, its certainty (0 to 1)
    and whether the text is like the learned ones. Null texts and texts without a
    letter, and any text if there is no model, are ``und`` with score 0; without a
    model texts with a letter are taken as sure. Whole texts are read; rows are
    independent."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    import regex
    letter = regex.compile(r"\p{L}")

    def compute(column):
        data, off = utf8(column)
        for lo, hi in pieces(off):
            d, o = data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
            texts = column.slice(lo, hi - lo).to_pylist()
            blank = np.array([t is None or letter.search(t) is None for t in texts], bool)
            if sent.value is None:
                lang, score, sure = [UNKNOWN] * (hi - lo), np.zeros(hi - lo), np.ones(hi - lo, bool)
            else:
                lang, score, sure = sent.value.predict(d, o)
            yield lo, hi, [pa.array([UNKNOWN if x else v for v, x in zip(lang, blank)], pa.string()), pa.array(np.where(blank, 0.0, score)), pa.array(sure & ~blank)]

    return with_results(docs, text_col, compute, [(lang_name, "string"), (score_name, "double"), (sure_name, "boolean")])


def held_out(id_column) -> object:
    """True where crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score), one row for each row of ``docs``; only
    rows that are not held out and have a language are learned from. A null id
    counts as the empty text for the fold."""
    model = train(docs.filter(~held_out(F.col(id_col))), text_col, lang_col)
    plain = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("__text"))
    return predict(plain, model, "__text").select(id_col, held_out(F.col(id_col)).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` (all columns) whose language is identified: texts
    without a letter go, and texts whose score or usualness lies outside what
    the learned rows have (``LOW``, ``PART``). Without a row to learn from, every
    text with a letter stays."""
    model = train(docs.filter(~held_out(F.col(id_col))), text_col, lang_col)
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])     # columns go by place, whatever their names
    return predict(plain, model, f"c{docs.columns.index(text_col)}").filter("__sure").select(*plain.columns).toDF(*docs.columns)
