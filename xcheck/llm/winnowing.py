"""Benchmark decontamination by winnowing.

A text's fingerprints are the smallest k-gram hash of every window of
``span - k + 1`` consecutive k-grams (the rightmost of equal ones). Two texts
that share ``span`` consecutive words share a whole window, hence a fingerprint:
no shared span of that length is missed. Fingerprints of documents and items are
joined, and every hit is extended along its diagonal over equal words. Items of
fewer words than ``span`` are one window each: all their own-length n-grams are
fingerprints.

A benchmark whose texts hold at most ``BROADCAST_BYTES`` goes to the tasks as a
whole and documents are read in one pass without a shuffle; beyond that,
fingerprints meet in a shuffled join and only candidate (document, item) texts
are fetched for the extension. Both ways give the same rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import with_results, written
from .words import NON_ALNUM, Words, byte_class, ngrams, pieces, scan, utf8

SPAN = 10                       # words of a window
GRAM = 5                        # words of a fingerprinted k-gram
BROADCAST_BYTES = 16 << 20      # of benchmark text

_CLASSES = byte_class(NON_ALNUM, True)


def _text_of(words: Words) -> np.ndarray:
    return np.searchsorted(words.first, np.arange(len(words.hash)), "right") - 1


def fingerprints(words: Words, text: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word position) of the winnowed k-grams."""
    g = ngrams(words.hash, gram)
    width = span - gram + 1
    n = len(g) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    least = g[:n].copy()
    for j in range(1, width):
        np.minimum(least, g[j:j + n], out=least)
    open_ = text[:n] == text[span - 1:span - 1 + n]
    chosen = np.zeros(len(g), bool)
    for j in range(width - 1, -1, -1):
        here = open_ & (g[j:j + n] == least)
        chosen[j:j + n] |= here
        open_ &= ~here
    at = np.flatnonzero(chosen)
    return g[at], at


class Index:
    """Fingerprints of the items, as sorted arrays."""

    def __init__(self, texts: list[str | None], span: int, gram: int):
        self.span, self.gram = span, gram
        data, off = utf8(pa.array(texts, pa.large_string()))
        w = scan(data, off, _CLASSES)
        self.hash, self.first = w.hash, w.first
        n = np.diff(w.first)
        text = _text_of(w)
        h, at = fingerprints(w, text, span, gram)
        tables = {span: (h, at)}
        for size in np.unique(n[(n > 0) & (n < span)]).tolist():
            item = np.flatnonzero(n == size)
            tables[size] = (ngrams(w.hash, size)[w.first[item]], w.first[item])
        self.tables = {}
        for size, (h, at) in tables.items():
            order = np.argsort(h, kind="stable")
            self.tables[size] = (h[order], at[order], text[at[order]])

    def matches(self, w: Words):
        """Per document of ``w`` with a hit: (document, sorted hit word offsets, items)."""
        text = _text_of(w)
        pairs: dict[int, tuple[set, list]] = {}
        seen: set[tuple[int, int, int]] = set()
        for size, (known, at, item) in self.tables.items():
            if not len(known):
                continue
            if size == self.span:
                h, pos = fingerprints(w, text, self.span, self.gram)
            else:
                h = ngrams(w.hash, size)
                pos = np.flatnonzero(text[:len(h)] == text[size - 1:size - 1 + len(h)])
                h = h[pos]
            lo = np.searchsorted(known, h, "left")
            hit = np.flatnonzero((lo < len(known)) & (known[np.minimum(lo, len(known) - 1)] == h))
            hi = np.searchsorted(known, h[hit], "right")
            for p, a, b in zip(pos[hit].tolist(), lo[hit].tolist(), hi.tolist()):
                d = int(text[p])
                for k in range(a, b):
                    i, q = int(item[k]), int(at[k])
                    if (d, i, p - q) in seen:
                        continue
                    seen.add((d, i, p - q))
                    start = max(int(w.first[d]), p - q + int(self.first[i]))
                    end = min(int(w.first[d + 1]), p - q + int(self.first[i + 1]))
                    same = w.hash[start:end] == self.hash[start - (p - q):end - (p - q)]
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
                    for x, y in zip(edge[::2].tolist(), edge[1::2].tolist()):
                        if y - x >= size:
                            found = pairs.setdefault(d, (set(), []))
                            found[0].add(i)
                            found[1].append((start + x - int(w.first[d]), start + y - int(w.first[d])))
        for d, (items, spans) in pairs.items():
            yield d, sorted(_joined(spans)), items


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open ranges."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SPANS = "array<struct<lo:long,hi:long>>"
_FIELDS = [("__n_words", "long"), ("__n_hit", "long"), ("__spans", _SPANS), ("__item_ids", "array<string>")]
_SPAN_TYPE = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))


def _scan_pieces(column):
    data, off = utf8(column)
    for lo, hi in pieces(off):
        yield lo, hi, scan(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], _CLASSES)


def _by_broadcast(docs: DataFrame, text_col: str, items: list[tuple[str, list[str]]], span: int, gram: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(items)
    built: list[Index] = []

    def compute(column):
        if not built:
            built.append(Index([t for t, _ in sent.value], span, gram))
        for lo, hi, w in _scan_pieces(column):
            spans, ids = [[] for _ in range(hi - lo)], [[] for _ in range(hi - lo)]
            for d, s, found in built[0].matches(w):
                spans[d] = [{"lo": a, "hi": b} for a, b in s]
                ids[d] = sorted({x for i in found for x in sent.value[i][1]})
            hit = np.array([sum(x["hi"] - x["lo"] for x in s) for s in spans], np.int64)
            yield lo, hi, [pa.array(np.diff(w.first)), pa.array(hit), pa.array(spans, _SPAN_TYPE), pa.array(ids, pa.list_(pa.string()))]

    return with_results(docs, text_col, compute, _FIELDS)


def _by_join(docs: DataFrame, text_col: str, bench: DataFrame, span: int, gram: int) -> DataFrame:
    """The same columns, with items as the keys of their texts."""
    sizes = sorted(r[0] for r in with_results(bench, "item_text", _count, [("n", "long")])
                   .filter(F.col("n").between(1, span - 1)).select("n").distinct().collect())   # at most span - 1 rows

    def prints(whole: bool):
        def run(batches):
            for b in batches:
                for lo, hi, w in _scan_pieces(b.column(1)):
                    text, n = _text_of(w), np.diff(w.first)
                    for size in [span, *sizes]:
                        if size == span:
                            h, at = fingerprints(w, text, span, gram)
                        else:
                            h = ngrams(w.hash, size)
                            at = np.flatnonzero(text[:len(h)] == text[size - 1:size - 1 + len(h)])
                            if whole:   # an item's own single window
                                at = at[n[text[at]] == size]
                            h = h[at]
                        rows = text[at]
                        yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo).take(pa.array(rows)),
                                                          pa.array(np.full(len(h), size)), pa.array(h.view(np.int64))], names=["key", "size", "print"])
        return run

    doc_texts = docs.select(F.md5(text_col).alias("key"), F.col(text_col).alias("text")).filter("key is not null").dropDuplicates(["key"])
    item_texts = bench.select("item_key", "item_text").dropDuplicates(["item_key"])
    schema = "key string, size long, print long"
    left = doc_texts.mapInArrow(prints(False), schema).distinct()
    right = item_texts.mapInArrow(prints(True), schema).distinct().withColumnRenamed("key", "item_key")
    pairs = written(left.join(right, ["size", "print"]).select("key", "item_key").distinct(), "winnow-pairs")
    both = pairs.join(doc_texts, "key").join(item_texts, "item_key").select("key", "item_key", "text", "item_text")

    def extend(batches):
        for b in batches:
            keys, items, spans = [], [], []
            for key, item_key, text, item in zip(*(b.column(k).to_pylist() for k in range(4))):
                data, off = utf8(pa.array([text], pa.large_string()))
                for _, s, _ in Index([item], span, gram).matches(scan(data, off, _CLASSES)):
                    keys.append(key), items.append(item_key), spans.append([{"lo": x, "hi": y} for x, y in s])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(items, pa.string()), pa.array(spans, _SPAN_TYPE)], names=["key", "item_key", "spans"])

    found = both.mapInArrow(extend, f"key string, item_key string, spans {_SPANS}")
    ids = bench.select("item_key", "item_id").distinct()
    found = found.join(ids, "item_key")
    # lists are bounded by the one text they belong to
    found = found.groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("__item_ids"), F.flatten(F.collect_list("spans")).alias("s"))
    found = found.select(F.col("key").alias("__key"), "__item_ids", _union("s").alias("__spans"))
    counted = with_results(docs, text_col, _count, [("__n_words", "long")])
    out = counted.join(found, F.md5(counted[text_col]) == F.col("__key"), "left")
    spans = F.coalesce("__spans", F.array().cast(_SPANS))
    return out.select(*counted.columns, F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x["hi"] - x["lo"]).alias("__n_hit"),
                      spans.alias("__spans"), F.coalesce("__item_ids", F.array().cast("array<string>")).alias("__item_ids"))


def _union(spans):
    merge = F.udf(lambda s: _joined([(x["lo"], x["hi"]) for x in s]), _SPANS, useArrow=True)
    return merge(spans)


def _count(column):
    for lo, hi, w in _scan_pieces(column):
        yield lo, hi, [pa.array(np.diff(w.first))]




def winnowed(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id",
             item_text_col: str = "text", span: int = SPAN, gram: int = GRAM, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """All columns of ``docs`` plus ``__n_words``, ``__n_hit``, ``__spans`` (word
    ranges that benchmark windows cover) and ``__item_ids``."""
    bench = (benchmark.select(F.col(item_id_col).cast("string").alias("item_id"), F.col(item_text_col).alias("item_text"))
             .filter("item_text is not null").withColumn("item_key", F.md5("item_text")))
    row = F.octet_length("item_text") + F.coalesce(F.octet_length("item_id"), F.lit(0)) + 64
    if (bench.agg(F.sum(row)).first()[0] or 0) > broadcast_bytes:
        return _by_join(docs, text_col, bench, span, gram)
    rows = bench.groupBy("item_key").agg(F.first("item_text").alias("t"), F.collect_set("item_id").alias("ids")).orderBy("item_key").collect()
    return _by_broadcast(docs, text_col, [(r.t, list(r.ids)) for r in rows], span, gram)


def winnow_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, n_words, n_hit, item_ids, spans, contaminated), one row for each row of ``docs``.

    Words are runs of digits, letters (A-Z lower-cased) and non-ASCII
    characters. A hit word lies in an occurrence of ``span`` consecutive item
    words (items of fewer words: the whole item). ``item_ids`` are the distinct
    ids of the items that occur, as strings, sorted. Null or word-less texts
    have no hits and items without words never occur; repeated documents each
    get their row; repeated items count once per id; an item with a null id
    makes hits but is not listed. Other columns are not looked at; either table
    may be empty."""
    found = winnowed(docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias(text_col)), benchmark, text_col, **options)
    return found.select(F.col(id_col), F.col("__n_words").alias("n_words"), F.col("__n_hit").alias("n_hit"),
                        F.col("__item_ids").alias("item_ids"), F.col("__spans").alias("spans"), (F.col("__n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` (all columns) that no benchmark window occurs in.
    Null and empty texts stay."""
    return winnowed(docs, benchmark, text_col, **options).filter("__n_hit = 0").select(*docs.columns)
