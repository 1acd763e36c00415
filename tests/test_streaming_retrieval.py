"""Stateful stream folds and vector search against brute force on fixtures."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from xcheck.operators import retrieval as R
from xcheck.streaming import core as S


def _events(spark, tmp_path):
    rnd = random.Random(3)
    t0 = dt.datetime(2024, 1, 1)
    rows, t = [], 0.0
    for i in range(400):
        t += rnd.choice([1, 5, 20, 40, 90])
        rows.append((i, t0 + dt.timedelta(seconds=t), rnd.choice([1, 2, 3]), rnd.choice(["click", "view", "signup"])))
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string")
    df.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    return rows


def test_rate_limit_and_budget_match_fold(spark, tmp_path):
    rows = _events(spark, tmp_path)
    ev = S.file_stream(spark, str(tmp_path), "events")
    got = {r["event_id"]: r["allowed"] for r in
           S.run_available_now(S.sliding_rate_limit(ev, "user_id", "ts", "event_id", 3, 60), "t-rl").collect()}
    w = {"click": 1, "view": 2, "signup": 5}
    bud = {r["event_id"]: r["allowed"] for r in S.run_available_now(
        S.budget(ev, F.col("user_id"), "ts", "event_id",
                 F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 2).otherwise(5), 40.0),
        "t-bu").collect()}
    for u in (1, 2, 3):
        mine = sorted([r for r in rows if r[2] == u], key=lambda r: (r[1], r[0]))
        times = [(r[1] - dt.datetime(1970, 1, 1)).total_seconds() for r in mine]
        want = S.rate_limit_reference(times, 3, 60)
        assert [got[r[0]] for r in mine] == want
        assert [bud[r[0]] for r in mine] == S.budget_reference([w[r[3]] for r in mine], 40.0)


def test_topk_matches_bruteforce(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(300, 16))
    Q = rng.normal(size=(7, 16))
    corpus = R.with_unit(spark.createDataFrame([(i, X[i].tolist()) for i in range(300)], "vec_id long, embedding array<double>"))
    qs = R.with_unit(spark.createDataFrame([(j, Q[j].tolist()) for j in range(7)], "qid long, e array<double>"),
                     vec="e", out="qunit")
    got = {}
    for r in R.topk(qs, corpus, 5).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["vec_id"]))
    Xn = X / np.linalg.norm(X, axis=1, keepdims=True)
    Qn = Q / np.linalg.norm(Q, axis=1, keepdims=True)
    for j in range(7):
        want = list(np.argsort(-(Xn @ Qn[j]), kind="stable")[:5])
        assert [v for _, v in sorted(got[j])] == want


def test_blocks_equal_sent_queries(spark, monkeypatch):
    """Both ways of the top-k, with tenants of unlike sizes, ties and a floor."""
    rng = np.random.default_rng(2)
    X = rng.integers(-3, 4, (900, 6)).astype(float)
    Q = rng.integers(-3, 4, (120, 6)).astype(float)
    tenant = lambda i: int(min(i % 7, 3))
    corpus = R.with_unit(spark.createDataFrame([(i, X[i].tolist(), tenant(i)) for i in range(900)], "vec_id long, embedding array<double>, t int")).repartition(5)
    qs = R.with_unit(spark.createDataFrame([(j, Q[j].tolist(), tenant(j)) for j in range(120)], "qid long, e array<double>, t int"), vec="e", out="qunit")
    monkeypatch.setattr(R, "CORPUS_BLOCK", 70)
    monkeypatch.setattr(R, "QUERY_BLOCK", 11)
    monkeypatch.setattr(R, "_STEP", 16)
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    score = unit(Q) @ unit(X).T
    for keys in ([], ["t"]):
        got = [{(r.qid, r.rank): (r.vec_id, round(r.score, 9)) for r in R.topk(qs, corpus, 4, partition_cols=keys, min_score=0.2, sent_bytes=b).collect()} for b in (1 << 20, 0)]
        assert got[0] == got[1]
        for j in range(120):
            mine = [i for i in range(900) if score[j, i] >= 0.2 and (not keys or tenant(i) == tenant(j))]
            want = sorted(mine, key=lambda i: (-round(score[j, i], 9), i))[:4]
            assert [round(got[0][j, k + 1][1], 6) for k in range(len(want))] == [round(score[j, i], 6) for i in want]


def test_lsh_finds_planted_duplicates(spark):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(200, 8))
    X[150:160] = X[0:10] + rng.normal(scale=0.01, size=(10, 8))     # near copies
    df = R.with_unit(spark.createDataFrame([(i, X[i].tolist()) for i in range(200)], "vec_id long, embedding array<double>"))
    thr = (2 - 2 * 0.99) ** 0.5
    pairs = {(r["a"], r["b"]) for r in R.lsh_neighbors(df, thr, bucket_length=0.5, num_tables=8).collect()}
    Xn = X / np.linalg.norm(X, axis=1, keepdims=True)
    sims = Xn @ Xn.T
    truth = {(i, j) for i in range(200) for j in range(i + 1, 200) if sims[i, j] >= 0.99}
    assert truth and pairs <= truth and len(pairs & truth) >= 0.8 * len(truth)


def test_daily_budget_resets_per_day(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1, 22)
    rows = [(i, t0 + dt.timedelta(hours=i * 0.5), 1, "signup") for i in range(12)]   # crosses midnight
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string")
    df.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    ev = S.file_stream(spark, str(tmp_path), "events")
    out = S.run_available_now(S.daily_budget(ev, "user_id", "ts", "event_id", F.lit(5.0), 10.0), "t-day").collect()
    got = {r["event_id"]: r["allowed"] for r in out}
    by_day = {}
    for i, t, _, _ in rows:
        by_day.setdefault(t.date(), []).append(i)
    for day, ids in by_day.items():
        assert [got[i] for i in ids] == S.budget_reference([5.0] * len(ids), 10.0)


def test_daily_budget_late_event_keeps_both_days(spark, tmp_path):
    day = dt.datetime(2024, 1, 2, 1)
    rows = [(1, day, 1), (2, day - dt.timedelta(hours=2), 1), (3, day + dt.timedelta(hours=1), 1)]
    for r in rows:
        (spark.createDataFrame([r], "event_id long, ts timestamp, user_id long").coalesce(1)
         .write.mode("append").parquet(str(tmp_path / "events.parquet")))
    ev = S.file_stream(spark, str(tmp_path), "events", max_files=1)
    out = S.run_available_now(S.daily_budget(ev, "user_id", "ts", "event_id", F.lit(10.0), 10.0), "t-late").collect()
    assert {r["event_id"]: r["allowed"] for r in out} == {1: True, 2: True, 3: False}


def test_stream_upsert_resumes_and_keeps_rows(spark, tmp_path):
    feed, table = str(tmp_path / "feed"), str(tmp_path / "table")
    schema = "k string, v long, ix long"

    def pull(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(feed)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(feed)
        return {r["k"]: r["v"] for r in S.stream_upsert(stream, table, ["k"], "ix").collect()}

    assert pull([("a", 1, 0), ("b", 1, 0)]) == {"a": 1, "b": 1}
    assert pull([("a", 2, 1), ("c", 1, 1)]) == {"a": 2, "b": 1, "c": 1}
    assert pull([("d", 1, 2)]) == {"a": 2, "b": 1, "c": 1, "d": 1}
    assert {r[0] for r in spark.read.parquet(f"{table}/rows").select("updated_at").distinct().collect()} == {0, 1, 2}
