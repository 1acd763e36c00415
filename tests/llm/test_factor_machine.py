"""The factorisation machine: its identity against all pairs, its gradient,
accuracy on rows it has not learned from, and odd tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from xcheck.llm import factor_machine as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, both string"


def vectors(rows, seed=1, size=40):
    rng = np.random.default_rng(seed)
    row = np.repeat(np.arange(rows), rng.integers(1, 9, rows))
    return row, rng.integers(0, size, len(row)), rng.normal(0, 1, len(row)).astype(np.float32)


def test_sum_of_squares_equals_all_pairs():
    row, feature, value = vectors(30)
    m = M.FactorMachine(40, 5, 3)
    m.w0, m.w = 0.3, np.random.default_rng(2).normal(0, 1, 40)
    got = m.margins(30, row, feature, value)
    for r in range(30):
        at = np.flatnonzero(row == r)
        want = m.w0 + sum(m.w[feature[i]] * value[i] for i in at)
        want += sum(m.v[feature[i]] @ m.v[feature[j]] * value[i] * value[j] for x, i in enumerate(at) for j in at[x + 1:])
        assert abs(got[r] - want) < 1e-6


def test_pairs_are_learned():
    """A label that is the exclusive or of two features has no linear part."""
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 2, (2, 1200))
    row = np.repeat(np.arange(1200), 2)
    feature = np.column_stack([a, 2 + b]).ravel()
    m = M.FactorMachine(4, 4, 1).fit(row, feature, np.ones(2400), (a ^ b).astype(float), epochs=40)
    said = m.margins(1200, row, feature, np.ones(2400)) > 0
    assert (said == (a ^ b)).mean() > 0.97


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    got = M.classify_quality(docs, labels).filter("held_out").join(labels, "doc_id").toPandas()
    assert len(got) > 40
    low, high = got[got.quality == 0].score, got[got.quality == 1].score
    auc = np.mean([(h > x) + 0.5 * (h == x) for x in low for h in high])
    assert auc > 0.97
    assert (got[got.quality == 1].predicted == 1).mean() > 0.97 and (got.predicted == got.quality).mean() > 0.9


def test_nothing_but_text_and_length_is_looked_at(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    one = M.classify_quality(docs, labels).toPandas().set_index("doc_id").score
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    again = M.classify_quality(other.repartition(5), labels).toPandas().set_index("doc_id").score
    assert (one == again[one.index]).all()


def rows():
    good = [(i, f"plain words of a good text number {i} go on and on", "en", "s", 40, "", "") for i in range(40)]
    bad = [(100 + i, f"$$$ %%% ### {i} *** &&& !!!", "en", "s", 40, "", "") for i in range(40)]
    odd = [(200, None, None, None, None, None, None), (201, "", "en", "s", 0, "", ""), (None, "null id", "en", "s", 7, "", ""), (202, "x" * 300_000, "en", "s", -5, "", ""),
           (203, "word " * 100_000, "en", "s", 1 << 40, "", ""), (1, good[1][1], "en", "s", 40, "", ""), (204, "\n\n \t\n", "en", "s", 5, "", "")]
    return good + bad + odd


def test_odd_rows_and_copies(spark):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(4)
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(40)] + [(None, 1), (5, None), (999, 0), (1, 1)], "doc_id long, quality int")
    got = M.classify_quality(docs, labels).collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    by = {r.doc_id: r for r in got}
    assert all(by[i].predicted == 1 for i in range(40)) and all(by[100 + i].predicted == 0 for i in range(40))
    # a text with a great many copies counts once
    many = docs.filter("doc_id < 200").unionAll(spark.range(1000, 4000).select(F.col("id").alias("doc_id"), F.lit(rows()[3][1]), *[F.lit("").alias(c) for c in ("a", "b")], F.lit(40).cast("long"), F.lit(""), F.lit("")))
    marks = labels.unionAll(spark.range(1000, 4000).select("id", F.lit(1)))
    chosen = M.training_texts(many, marks, "doc_id", "text", "quality", None, 50)
    kinds = {r.label: r.n for r in chosen.groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert kinds == {0: 40, 1: 40}
    assert M.training_texts(many, marks, "doc_id", "text", "quality", None, 10).count() == 20


@pytest.mark.parametrize("kind, score", [([], 0.5), ([(0, 1), (1, 1), (2, 1)], None), ([(100, 0), (101, 0)], None)])
def test_labels_of_one_kind(spark, kind, score):
    docs = spark.createDataFrame(rows(), SCHEMA)
    got = {r.score for r in M.classify_quality(docs, spark.createDataFrame(kind, "doc_id long, quality int")).collect()}
    assert len(got) == 1 and (score is None or got == {score})


def test_empty_table(spark):
    assert M.classify_quality(spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, 1)], "doc_id long, quality int")).collect() == []
