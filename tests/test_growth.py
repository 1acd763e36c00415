"""Work is done once: no expression, side or group is computed per filter, field or handful of rows."""

from __future__ import annotations

import collections
import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from xcheck.operators import commerce as C
from xcheck.operators import housekeeping as H
from xcheck.operators import records as RC
from xcheck.operators import retrieval as R
from xcheck.plans import q_commerce as QC
from xcheck.session import configure
from xcheck.streaming import core as S


@pytest.fixture
def plan(spark):
    configure(spark)
    was = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    yield lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.set("spark.sql.debug.maxToStringFields", was)


class _State:
    exists, hasTimedOut = False, False

    def update(self, value):
        self.get, self.exists = value, True

    def getCurrentWatermarkMs(self):
        return 0

    def setTimeoutTimestamp(self, at):
        self.closes = at


def test_daily_budget_takes_a_cell_of_users_at_once():
    fold, state = S._daily_budget_fn(10.0, 0), _State()
    t0 = dt.datetime(2024, 1, 2)
    for batch in (0, 1):
        rows = [(u, 10 * batch + i, t0 + dt.timedelta(minutes=10 * batch + i), 3.0) for i in range(2) for u in ("a", "b")]
        got = pd.concat(fold(("2024-01-02", 7), iter([pd.DataFrame(rows, columns=["key", "event_id", "ts", "weight"])]), state))
        assert sorted(got["key"]) == ["a|2024-01-02"] * 2 + ["b|2024-01-02"] * 2
        for u in "ab":
            mine = got[got["key"] == f"{u}|2024-01-02"]
            assert mine["allowed"].tolist() == ([True, True] if batch == 0 else [True, False])
            assert mine["used"].tolist() == ([3.0, 6.0] if batch == 0 else [9.0, 9.0])
    assert dict(zip(*state.get)) == {"a": 9.0, "b": 9.0}


def test_lsh_gives_the_pairs_of_the_row_join_without_candidate_rows(spark, plan):
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 6))
    x[60:] = x[:60] + rng.normal(scale=0.2, size=(60, 6))
    rows = [(i, x[i].tolist()) for i in range(120)] + [(5, x[5].tolist())]          # one row twice
    df = R.with_unit(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = R.lsh_neighbors(df, 0.4, bucket_length=0.5)
    assert " Join " not in plan(got)
    v = df.select("vec_id", array_to_vector("unit").alias("f"))
    m = BucketedRandomProjectionLSH(inputCol="f", outputCol="hashes", bucketLength=0.5, numHashTables=3, seed=7).fit(v)
    want = m.approxSimilarityJoin(v, v, 0.4, distCol="dist").select(F.col("datasetA.vec_id").alias("a"), F.col("datasetB.vec_id").alias("b"), "dist").where("a < b")
    want = sorted(tuple(r) for r in want.collect())
    assert want and sorted(tuple(r) for r in got.collect()) == want


def test_feed_json_is_written_and_parsed_once(spark, plan):
    raw = spark.range(3).select(F.lit("shop-1").alias("connection_id"), F.col("id").alias("ix"), F.to_json(F.struct(
        F.col("id").cast("string").alias("id"), F.lit("paid").alias("financial_status"), F.lit("2024-01-01T00:00:00Z").alias("created_at"))).alias("raw_json"))
    n = C.normalize_orders(raw, "shopify", keep=("connection_id", "ix")).where("order_date >= timestamp'2023-01-01'")
    text = plan(n)
    assert text.count("from_json(") == 1 and text.count("StructsToJsonEvaluator") + text.count("to_json(") == 1
    assert n.count() == 3


def test_amazon_events_are_parsed_once(spark, plan, tmp_path):
    ts = dt.datetime(2024, 1, 5)
    spark.createDataFrame([(1, 1, ts)], "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(1, 2)], "c_custkey long, c_nationkey int").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(1, 10.0, 0.1, 0.02, "N"), (1, 4.5, 0.1, 0.0, "R"), (1, 5.25, 0.05, 0.0, "A")],
                          "l_orderkey long, l_extendedprice double, l_discount double, l_tax double, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    out = QC.amazon_financials(spark, str(tmp_path))
    assert plan(out).count("from_json(") == 1
    r = out.collect()[0]
    assert (r["connection_id"], r["revenue"], r["refunds"], r["fees"], r["net_proceeds"]) == ("shop-2", 15.25, 4.5, 15.0, -4.25)


def test_order_feeds_are_read_back_not_derived_again(spark, plan, tmp_path):
    ts = dt.datetime(2024, 1, 5)
    rows = [(i, 1, "P" if i == 2 else "F", 1.0, ts + dt.timedelta(hours=20 * i), "1-URGENT") for i in range(1, 4)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(1, 2)], "c_custkey long, c_nationkey int").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(1, 4.5, 0.1, 0.0, "R", "F")], "l_orderkey long, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string").write.parquet(str(tmp_path / "lineitem.parquet"))
    out = QC.sync_window(spark, str(tmp_path))
    assert "from_json(" not in plan(out)
    assert [tuple(r) for r in out.collect()] == [("shop-2", 3)]


def test_facts_are_extracted_once(spark, plan):
    from xcheck.functions.registered import register_all
    register_all(spark)
    spark.createDataFrame([(1, "Total price: $1,234.50.")], "doc_id long, text string").createOrReplaceTempView("growth_texts")
    df = spark.sql("SELECT doc_id, f.label, f.value FROM (SELECT doc_id, extract_facts(text) AS facts FROM growth_texts) LATERAL VIEW explode(facts) e AS f")
    assert plan(df).count("regexp_extract_all(") == 3                              # one pass per pattern
    assert ("total price", 1234.5) in {(r["label"], r["value"]) for r in df.collect()}


def test_label_tokens_are_not_made_for_a_filter(spark, plan):
    from xcheck.operators import discrepancy as D
    from xcheck.operators import facts as FX
    docs = spark.createDataFrame([(1, "Total price: $100.00.")], "doc_id long, text string")
    rows = spark.createDataFrame([(1, 110.0)], "k long, total_price double")
    out = D.checked_pairs(FX.extract_facts(docs), FX.facts_from_table(rows, "k", ["total_price"]))
    assert plan(out).count("array_except(") == 2                                   # one per side
    assert [tuple(r) for r in out.collect()] == [(1, 1)]


def test_missing_labels_counts_rows_of_both_sides_once(spark, plan):
    pred = spark.createDataFrame([(1,), (1,), (2,), (None,)], "doc_id long").withColumn("label", F.upper(F.lit("q")))
    gold = spark.createDataFrame([(1,), (3,), (3,), (None,), (None,)], "doc_id long").withColumn("label", F.upper(F.lit("q")))
    out = H.missing_labels(pred, gold, ["doc_id", "label"])
    assert plan(out).count("LogicalRDD") == 2
    assert collections.Counter(tuple(r) for r in out.collect()) == {(1, "Q", "fp"): 1, (2, "Q", "fp"): 1, (3, "Q", "fn"): 2, (None, "Q", "fn"): 1}


def test_semantic_chunks_leave_the_vectors_behind(spark, plan):
    docs = spark.createDataFrame([(1, "One a. Two b. Three c.", "financial"), (2, "Four d. Five e.", "financial")], "doc_id long, text string, doc_type string")
    vectors = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (1, 2, [0.0, 1.0]), (2, 0, [1.0, 0.0])], "doc_id long, ix int, unit array<double>")
    out = RC.chunk_semantic(docs, vectors)
    assert "unit#" not in plan(out)
    got = {(r["doc_id"], r["chunk_ix"]): (r["chunk"], r["method"]) for r in out.collect()}
    assert got == {(1, 0): ("One a. Two b.", "semantic"), (1, 1): ("Three c.", "semantic"), (2, 0): ("Four d. Five e.", "length")}


def test_semantic_vectors_are_shuffled_once_and_by_parts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "One a. Two b. Three c.", "financial") for i in range(12)], "doc_id long, text string, doc_type string")
    vectors = spark.createDataFrame([(i, ix, [1.0, 0.0] if ix < 2 else [0.0, 1.0]) for i in range(12) for ix in range(3)], "doc_id long, ix int, unit array<double>")
    written, real = [], RC.materialize

    def recorded(df, what):
        plan = df._jdf.queryExecution().executedPlan().toString()
        out = real(df, what)
        written.append((plan.count("Exchange "), {r["doc_id"] for r in out.collect()}))
        return out

    monkeypatch.setattr(RC, "materialize", recorded)
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    got = {(r["doc_id"], r["chunk_ix"]): (r["chunk"], r["method"]) for r in RC.chunk_semantic(docs, vectors).collect()}
    assert got == {(i, k): (c, "semantic") for i in range(12) for k, c in enumerate(["One a. Two b.", "Three c."])}
    assert len(written) == RC.VECTOR_PARTS and all(n == 2 for n, _ in written)      # sentences and vectors, each once
    assert sorted(i for _, ids in written for i in ids) == list(range(12)) and spark.conf.get(name) == before
