"""Routing ladders, housekeeping, registers, webhooks, percentiles, upsert."""

import datetime as dt

from pyspark.sql import functions as F

from xcheck.operators import audit as A
from xcheck.operators import commerce as C
from xcheck.operators import housekeeping as H
from xcheck.operators import routing as RT
from xcheck.operators import webhooks as WH
from xcheck.sources import edgar as ED


def test_route_tool_ladder(spark):
    rows = [("Fetch revenue data for heatmap", True, False, False, "sql_query"),
            ("Plot the trend", True, False, False, "python_analysis"),
            ("Summarize the contract", True, True, False, "doc_search"),
            ("Count orders", False, True, False, "doc_search"),
            ("Count orders", False, False, False, "unsupported"),
            ("Count orders", True, False, True, "python_analysis")]
    df = spark.createDataFrame([r[:4] for r in rows], "s string, db boolean, docs boolean, csv boolean")
    got = [r[0] for r in df.select(RT.route_tool("s", "db", "docs", "csv")).collect()]
    assert got == [r[4] for r in rows]


def test_route_source_and_flags(spark):
    df = spark.createDataFrame([(False, True, "sql"), (True, False, "doc"), (True, True, "SQL "), (True, True, "x")],
                               "db boolean, docs boolean, lab string")
    assert [r[0] for r in df.select(RT.route_source("db", "docs", "lab")).collect()] == ["doc", "sql", "sql", "hybrid"]
    q = spark.createDataFrame([("Can you forecast next quarter?",), ("draw a bar chart",), ("modelling",)], "t string")
    f = [tuple(r[0]) for r in q.select(RT.question_flags("t")).collect()]
    assert f == [(True, True, False), (False, False, True), (False, False, False)]


def test_form_fields(spark):
    rows = [(1, 0, "H1B_JobTitle", "Engineer"), (1, 1, "jobTitle", "dup"), (1, 2, "optOut", "Off"),
            (1, 3, "employer-name", " ACME "), (2, 0, "x", "")]
    df = spark.createDataFrame(rows, "doc_id long, ix long, name string, value string")
    got = {r["doc_id"]: r["text"] for r in H.form_fields_to_text(df).collect()}
    assert got == {1: "H1B Job Title: Engineer\njob Title: dup\nemployer name: ACME"}


def test_classification_report(spark):
    p = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a")], "k long, label string")
    g = spark.createDataFrame([(1, "a"), (4, "a")], "k long, label string")
    r = H.classification_report(p, g, "k", "label").first()
    assert (r["tp"], r["fp"], r["fn"]) == (1, 2, 1)
    assert abs(r["precision"] - 1 / 3) < 1e-12 and abs(r["recall"] - 0.5) < 1e-12
    e = spark.createDataFrame([], "k long, label string")
    r0 = H.classification_report(e, e, "k", "label").first()
    assert (r0["precision"], r0["recall"]) == (1.0, 1.0)


def test_latency_percentiles_match_python(spark):
    import statistics
    vals = [5.0, 1.0, 3.0, 3.0, 10.0, 7.0, 2.0, 8.0, 8.0, 4.0, 6.5]
    df = spark.createDataFrame([("g", v) for v in vals] + [("h", 1.0), ("h", 2.0)], "k string, v double")
    got = {r["k"]: r for r in A.latency_percentiles(df, ["k"], "v").collect()}
    for k, xs in (("g", vals), ("h", [1.0, 2.0])):
        s = sorted(xs)
        assert got[k]["p50"] == statistics.median(s)
        assert got[k]["p95"] == s[max(0, int(round(0.95 * len(s))) - 1)]


def test_upsert_batch_wins_and_hot_key(spark):
    t = spark.createDataFrame([("c", "1", "old", dt.datetime(2020, 1, 1)), ("c", "2", "keep", dt.datetime(2020, 1, 1))],
                              "cid string, oid string, status string, updated_at timestamp")
    b = spark.createDataFrame([("c", "1", f"v{i}", i) for i in range(50)], "cid string, oid string, status string, ix long")
    out = {r["oid"]: r["status"] for r in C.upsert(t, b, ["cid", "oid"], now=F.lit(dt.datetime(2021, 1, 1))).collect()}
    assert out == {"1": "v49", "2": "keep"}


def test_company_search_ranks(spark):
    c = spark.createDataFrame([("AB", "Alpha Beta", 0), ("ABC", "Gamma", 1), ("X", "the ab corp", 2), ("AB2", "z", 3)],
                              "ticker string, name string, ix long")
    q = spark.createDataFrame([("ab",)], "q string")
    got = [(r["ticker"], r["rank"]) for r in ED.company_search(c, q).orderBy("rank", "ix").collect()]
    assert got == [("AB", 0), ("ABC", 1), ("AB2", 1), ("X", 2)]


def test_history_page_and_filings(spark):
    h = spark.createDataFrame([(1, 7, dt.datetime(2024, 1, i + 1), s) for i, s in enumerate(["15 rows", "error", "3 rows"])],
                              "id long, cid long, ts timestamp, summary string")
    got = [(r["id"], r["row_count"]) for r in ED.history_page(h, "cid", "ts", 0).collect()]
    assert got == [(1, 3)]
    subs = spark.createDataFrame([(9, ["10-K", "8-K", "10-k", "10-K"], ["a", "b", "c", "d"])],
                                 "cik long, form array<string>, accession array<string>")
    assert [r["accession"] for r in ED.filing_list(subs, "cik", "10-K", 2).orderBy("pos").collect()] == ["a", "c"]


def test_webhook_hmac(spark):
    body, secret = '{"id": 1}', "s3cret"
    good = WH.hmac_b64(secret, body)
    df = spark.createDataFrame([(secret, body, good), (secret, body + " ", good)], "secret string, body string, h string")
    assert WH.verified_events(df, "secret", "body", "h").count() == 1


def test_retention_and_purge(spark):
    now = dt.datetime(2024, 1, 1, 12)
    up = spark.createDataFrame([(1, now - dt.timedelta(hours=3)), (2, now - dt.timedelta(hours=1)), (3, None)],
                               "sid long, ts timestamp")
    dep = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "sid long, x string")
    ku, kd = H.retention_sweep(up, dep, "sid", "ts", F.lit(now))
    assert sorted(r["sid"] for r in ku.collect()) == [2, 3] and sorted(r["sid"] for r in kd.collect()) == [2, 3]
    left = H.purge({"d": dep}, "sid", spark.createDataFrame([(1,)], "sid long"))
    assert sorted(r["sid"] for r in left["d"].collect()) == [2, 3]


def test_trailing_count_hot_key_across_buckets(spark):
    import random
    rnd = random.Random(5)
    t0 = dt.datetime(2024, 1, 1, 0, 58)
    rows, t = [], 0.0
    for i in range(600):                       # one hot key crossing several hour buckets
        t += rnd.choice([0.5, 3, 11, 29, 61])
        rows.append((i, "hot" if i % 4 else "cold", t0 + dt.timedelta(seconds=t)))
    df = spark.createDataFrame(rows, "event_id long, k string, ts timestamp")
    got = {r["event_id"]: r["trailing"] for r in A.trailing_count(df, "k", "ts", 60, bucket_seconds=600).collect()}
    for i, k, ts in rows:
        want = sum(1 for _, k2, ts2 in rows if k2 == k and ts - dt.timedelta(seconds=60) <= ts2 <= ts)
        assert got[i] == want


def test_percentiles_approx_close(spark):
    df = spark.createDataFrame([("g", float(v)) for v in range(1, 1001)], "k string, v double")
    exact = A.latency_percentiles(df, ["k"], "v").first()
    appr = A.latency_percentiles(df, ["k"], "v", approx=True).first()
    assert abs(exact["p50"] - appr["p50"]) <= 1 and abs(exact["p95"] - appr["p95"]) <= 1


def test_shopify_feed_cases(spark):
    import json
    order = {"id": 1001, "total_price": "150.00", "currency": "USD", "financial_status": "partially_refunded",
             "fulfillment_status": None, "created_at": "2024-03-05T10:00:00Z", "customer": {"email": "a@b.co"},
             "total_tax": "10.00", "total_discounts": "5.00",
             "refunds": [{"transactions": [{"kind": "refund", "amount": "25.00"}, {"kind": "sale", "amount": "9.00"}]}]}
    no_id = dict(order, id=None)
    raw = spark.createDataFrame([("c1", 0, json.dumps(order)), ("c1", 1, json.dumps(no_id))],
                                "connection_id string, ix long, raw_json string")
    n = C.normalize_orders(raw, "shopify").collect()
    assert len(n) == 1 and n[0]["status"] == "confirmed" and n[0]["total_amount"] == 150.0
    assert n[0]["order_date"] == dt.datetime(2024, 3, 5, 10, 0)
    fin = C.shopify_financials(raw.where("ix = 0").withColumn("p", F.lit("2024-03")), ["connection_id", "p"]).first()
    assert (fin["revenue"], fin["refunds"], fin["fees"], fin["net_proceeds"], fin["order_count"]) == \
        (150.0, 25.0, 0.0, 125.0, 1)
    empty = C.shopify_financials(raw.where("ix < 0").withColumn("p", F.lit("2024-03")), ["connection_id", "p"])
    assert empty.count() == 0
