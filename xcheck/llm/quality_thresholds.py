"""Quality rules with adaptive thresholds.

Fixed rules decide the plain cases (``base_failed``). For the rest, each
document's ratios are compared with fences of its own language and source. A
quantile sketch counts a group's values by logarithmic cells (a value is known to
``ACCURACY``, relatively); counts add, so sketches of (language, source) merge to
those of a language and to one over everything, and the same rows always give
the same fences. The fence of a ratio is
``upper + reach * max(upper - median, floor)``, ``upper`` being the ratio's own
upper quantile in the group. The floor decides only where that quantile equals
the median, as in groups that have no symbols at all. A group with fewer than ``min_group`` documents uses its language's sketch, a language with fewer
the overall one. A sketch has some 2,000 cells at most, so a source with a third of all
rows costs no more than any other; fences are joined back to the documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import with_results, written
from .words import SPACES, byte_class, mix, ngrams_of_texts, pieces, scan, utf8

MIN_WORDS = 10
REPEAT_PERCENT = 20
WINDOW = 5
MIN_GROUP = 100         # documents below which a wider group's sketch is used
# ratio -> (upper quantile, distances from the median to it that a fence lies above it, smallest distance)
RATIOS = {"symbol_ratio": (0.9, 1.0, 0.02), "dup_line_ratio": (0.99, 1.0, 0.05), "repeat_ratio": (0.99, 1.0, 0.01), "word_length": (0.9, 2.0, 0.1)}
REACH = 1.0             # factor on the distances
ACCURACY = 0.005        # relative error of a sketch's quantiles
NOTHING = 1e-4          # values up to here are taken as zero

_CLASSES = byte_class(SPACES, False)
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _lines(text: str | None) -> tuple[int, int]:
    """(lines that are not blank, those that repeat an earlier one)"""
    if not text:
        return 0, 0
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    return len(lines), len(lines) - len(set(lines))


def _measure(column):
    column = column.cast(pa.large_string())
    data, off = utf8(column)
    for lo, hi in pieces(off):
        d, o = data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        w = scan(d, o, _CLASSES)
        points = np.zeros(len(d) + 1, np.int64)
        np.cumsum((d & 0xC0) != 0x80, out=points[1:])
        chars = np.zeros(len(w.hash) + 1, np.int64)
        np.cumsum(points[w.hi] - points[w.lo], out=chars[1:])
        symbols = np.zeros(len(d) + 1, np.int64)
        np.cumsum(_SYMBOLS[d], out=symbols[1:])
        gram, at = ngrams_of_texts(w, WINDOW)
        row = np.searchsorted(w.first, at, "right") - 1
        _, back, count = np.unique(mix(gram ^ mix(row.astype(np.uint64) + np.uint64(1))), return_inverse=True, return_counts=True)
        covered = np.zeros(len(w.hash) + 1, np.int64)
        again = at[count[back] > 1] if len(at) else at
        np.add.at(covered, again, 1)
        np.add.at(covered, again + WINDOW, -1)
        inside = np.zeros(len(w.hash) + 1, np.int64)
        np.cumsum(np.cumsum(covered[:-1]) > 0, out=inside[1:])
        lines = np.array([_lines(t) for t in column.slice(lo, hi - lo).to_pylist()], np.int64)
        yield lo, hi, [pa.array(np.diff(w.first)), pa.array(np.diff(chars[w.first])), pa.array(np.diff(symbols[o])),
                       pa.array(lines[:, 1]), pa.array(np.diff(inside[w.first])), pa.array(lines[:, 0])]


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``__n_words``, ``__word_chars``, ``__n_symbols``,
    ``__n_dup_lines``, ``__n_repeat_words`` and ``__n_lines`` of the whole text."""
    return with_results(docs, text_col, _measure, [(f"__{c}", "long") for c in [*_BASE, "n_lines"]])


def _ratio(name: str):
    words = F.greatest("n_words", F.lit(1))
    return {"symbol_ratio": F.col("n_symbols") / words, "dup_line_ratio": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
            "repeat_ratio": F.col("n_repeat_words") / words, "word_length": F.col("word_chars") / words}[name]


_STEP = float(np.log((1 + ACCURACY) / (1 - ACCURACY)))


def sketches(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by..., ratio, cell, n): how many values of each ratio lie in each
    logarithmic cell; cell 0 has the values up to ``NOTHING``."""
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("ratio"), F.col(c).alias("value")) for c in RATIOS])).alias("x")
    cell = F.when(F.col("x.value") <= NOTHING, F.lit(0)).otherwise(F.greatest(F.lit(1), F.ceil(F.log(F.col("x.value") / NOTHING) / _STEP))).cast("long")
    return rows.select(*by, values).groupBy(*by, F.col("x.ratio").alias("ratio"), cell.alias("cell")).agg(F.count("*").alias("n"))


def sketch_fences(cells: DataFrame, by: list[str], reach: float) -> DataFrame:
    """(by..., n, <ratio>_fence...) of sketches merged by ``by``."""
    merged = cells.groupBy(*by, "ratio", "cell").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "ratio")
    upto = merged.withColumn("upto", F.sum("n").over(group.orderBy("cell"))).withColumn("total", F.sum("n").over(group))
    value = F.when(F.col("cell") == 0, F.lit(0.0)).otherwise(F.exp((F.col("cell") - 0.5) * _STEP) * NOTHING)
    parts = [F.max("total").alias("n")]
    for c, (level, far, floor) in RATIOS.items():
        middle, upper = (F.min(F.when((F.col("ratio") == c) & (F.col("upto") >= F.col("total") * q), F.col("value"))) for q in (0.5, level))
        parts.append((upper + F.greatest(upper - middle, F.lit(floor)) * far * reach).alias(f"{c}_fence"))
    return upto.withColumn("value", value).groupBy(*by).agg(*parts)


def fences(rows: DataFrame, reach: float, min_group: int) -> DataFrame:
    """(lang, source, <ratio>_fence...) from merged quantile sketches."""
    cells = written(sketches(rows, ["lang", "source"]), "sketches")
    own, lang = sketch_fences(cells, ["lang", "source"], reach), sketch_fences(cells, ["lang"], reach)
    whole = sketch_fences(cells, [], reach).first()         # one row
    names = [f"{c}_fence" for c in RATIOS]
    lang = lang.select(F.col("lang").alias("of"), F.col("n").alias("lang_n"), *[F.col(c).alias(f"lang_{c}") for c in names])
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("of")))
    chosen = [F.when(F.col("n") >= min_group, F.col(c)).when(F.col("lang_n") >= min_group, F.col(f"lang_{c}")).otherwise(F.lit(whole[c])).alias(c) for c in names]
    return joined.select("lang", "source", *chosen)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                  reach: float = REACH, min_group: int = MIN_GROUP) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, failed, kept), one row for each row of ``docs``.

    ``base_failed``: fewer than 10 words, or over a fifth of the words in
    repeated 5-word windows. ``failed`` lists the ratios above their group's
    fence; ``kept`` is false if either holds. Null text has no words (it fails);
    null language or source are groups of their own; repeated rows each get
    their row and weigh in the sketches; values on a fence are kept. Other
    columns are not looked at; an empty table gives an empty result."""
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    m = measures(plain).select("id", "lang", "source", *[F.col(f"__{c}").alias(c) for c in [*_BASE, "n_lines"]])
    m = m.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT))
    m = written(m.select("*", *[_ratio(c).alias(c) for c in RATIOS]), "measures")
    # fences come from the documents that the fixed rules pass
    limits = fences(m.filter("not base_failed"), reach, min_group)
    # the larger side keeps its rows where they are: one fence row per group, checked small by Spark, or a skew-split join
    out = (m.alias("m").join(limits.alias("f"), F.col("m.lang").eqNullSafe(F.col("f.lang")) & F.col("m.source").eqNullSafe(F.col("f.source")), "left"))
    over = F.array(*[F.when(F.col(c) > F.col(f"{c}_fence"), F.lit(c)) for c in RATIOS])
    failed = F.array_compact(over)
    return out.select(F.col("id").alias(id_col), *_BASE, "base_failed", failed.alias("failed"), (~F.col("base_failed") & (F.size(failed) == 0)).alias("kept"))
