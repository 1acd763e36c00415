"""Typing, routing, expansion, status maps, HTML, SELECT gate."""

import pytest
from pyspark.sql import functions as F

from xcheck.operators import commerce as C
from xcheck.operators import docs as DO
from xcheck.operators import retrieval as R
from xcheck.operators import sqlgate as G


def _one(spark, col, text):
    return spark.createDataFrame([(text,)], "t string").select(col(F.col("t")).alias("x")).first()["x"]


def test_chunk_doc_type(spark):
    assert _one(spark, DO.chunk_doc_type, "FORM 10-K annual report of the registrant") == "financial"
    assert _one(spark, DO.chunk_doc_type, "This Agreement is made between the parties") == "legal"
    assert _one(spark, DO.chunk_doc_type, "hello world") == "general"
    assert _one(spark, DO.chunk_doc_type, "x" * 500 + " annual report") == "general"


def test_doc_type_and_extractable(spark):
    fin = "revenue margin budget forecast quarter " + "word " * 60
    assert _one(spark, DO.doc_type, fin) == "financial"
    assert _one(spark, DO.doc_type, "revenue margin budget") == "general"           # < 50 tokens
    tie = "agreement contract party revenue margin budget " + "w " * 60
    assert _one(spark, DO.doc_type, tie) == "financial"                             # tie -> first
    nums = " ".join(f"v{i}" for i in range(98)) + " 12 13"
    assert _one(spark, DO.is_extractable, nums) is True
    assert _one(spark, DO.is_extractable, "word " * 100) is False


def test_route_question(spark):
    r = lambda q: _one(spark, lambda c: DO.route_question(c)["persona"], q)
    assert r("What is the diagnosis for this patient?") == "Doctor"
    assert r("Show revenue and profit by quarter") == "Finance Expert"
    assert r("hello there") == "Generalist"
    assert r("health") == "Generalist"                 # 1 point < 2
    assert r("sql query on the table") == "Data Analyst"


def test_expand_queries(spark):
    df = spark.createDataFrame([(1, "His position or title?"), (2, "nothing to see")], "qid long, q string")
    rows = R.expand_queries(df, "qid", "q").orderBy("qid", "ix").collect()
    q1 = [r["query"] for r in rows if r["qid"] == 1]
    assert q1[0] == "His position or title?"
    assert q1[1:4] == ["job title", "position title", "job title occupation title"]
    assert len(q1) == len({x.lower() for x in q1})
    assert [r["query"] for r in rows if r["qid"] == 2] == ["nothing to see"]


def test_shopify_status(spark):
    df = spark.createDataFrame([("paid", "fulfilled"), ("paid", None), ("voided", None), ("weird", None),
                                ("paid", "unknown_state")], "fin string, ful string")
    got = [r[0] for r in df.select(C.shopify_status("fin", "ful")).collect()]
    assert got == ["delivered", "confirmed", "cancelled", "weird", "confirmed"]


def test_html_to_text(spark):
    html = ('<html><head><title>T &amp; C</title><style>p{}</style><script>var a="</p>";</script>'
            '<meta charset="utf-8"></head><body><!-- c --><p> one </p><p></p><div>two<br>three</div></body></html>')
    assert _one(spark, DO.html_to_text, html) == "T & C\none\ntwo\nthree"


@pytest.mark.parametrize("sql", [
    "SELECT 1 AS a", "WITH x AS (SELECT 1 AS a) SELECT a FROM x",
    "WITH x AS (SELECT 1 AS a UNION ALL SELECT 2) SELECT a FROM x",
])
def test_gate_accepts(spark, sql):
    df = G.safe_select(spark, sql)
    assert df.count() >= 1


@pytest.mark.parametrize("sql", [
    "DROP TABLE t", "SELECT 1 UNION SELECT 2", "WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x",
    "SELECT reflect('java.lang.Thread', 'sleep', 1)", "SELECT * FROM parquet.`/tmp/x`", "VALUES (1)",
    "SELECT 1; SELECT 2", "CREATE TABLE z AS SELECT 1", "this is not sql",
])
def test_gate_rejects(spark, sql):
    with pytest.raises(G.QueryRejected) as e:
        G.safe_select(spark, sql)
    assert sql not in str(e.value)


def test_gate_limit(spark):
    spark.range(1000).createOrReplaceTempView("gate_t")
    assert G.safe_select(spark, "SELECT id FROM gate_t").count() == 500
    assert G.safe_select(spark, "SELECT id FROM gate_t LIMIT 10").count() == 10
    assert G.safe_select(spark, "SELECT id FROM gate_t LIMIT 10", cap=700, replace=True).count() == 700


def test_gate_limit_with_offset_comment_and_literals(spark):
    spark.range(1000).createOrReplaceTempView("gate_t")
    for sql in ("SELECT id FROM gate_t ORDER BY id LIMIT 10 OFFSET 2", "SELECT id FROM gate_t LIMIT 10 -- tail",
                "SELECT id, 'limit 3 (' AS s FROM (SELECT id FROM gate_t LIMIT 999) LIMIT 10"):
        assert G.safe_select(spark, sql, cap=700, replace=True).count() == 700
    assert G.safe_select(spark, "SELECT id FROM gate_t ORDER BY id LIMIT 10 OFFSET 2", cap=700, replace=True).first()[0] == 2
    assert G.safe_select(spark, "SELECT 'reflect(x)' AS s").first()[0] == "reflect(x)"


@pytest.mark.parametrize("sql", [
    "SELECT 1 AS k UNION SELECT 2 ORDER BY k LIMIT 5", "SELECT 1 AS k UNION ALL SELECT 2 ORDER BY k",
    "WITH a AS (SELECT 1 AS k) SELECT k FROM a UNION ALL SELECT k FROM a LIMIT 3",
    "SELECT 'a' AS s, `reflect`('java.lang.Thread', 'sleep') AS r",
])
def test_gate_rejects_root_set_operations(spark, sql):
    with pytest.raises(G.QueryRejected):
        G.safe_select(spark, sql)


def test_html_references_and_quoted_gt(spark):
    assert _one(spark, DO.html_to_text, "<p>Caf&eacute; &#8217;26 &#x41; &copy;</p>") == "Café ’26 A ©"
    assert _one(spark, DO.html_to_text, '<p title="a > b">x</p> 1 < 2') == "x\n1 < 2"


def test_chunks_cut_at_the_coarsest_separator(spark):
    from xcheck.operators.chunking import chunk_recursive, chunks_of
    para = " ".join(f"word{i}" for i in range(400))
    text = para[:600] + "\n\n" + para + "\nshort line\n\n" + "x" * 2500
    got = chunks_of(text, 1000, 200)
    assert all(0 < len(c) <= 1000 for c in got) and got[0] == para[:600]
    words = set(text.split())
    assert all(w in words for c in got[:3] for w in c.split())          # no word is cut before the long one
    assert all(any(w in c for c in got) for w in words if len(w) < 100)
    assert got[1].split()[-1] in got[2].split()                         # whole words are repeated
    assert sum(c.count("x") for c in got) >= 2500
    df = spark.createDataFrame([(1, text), (2, "tiny"), (3, ""), (4, None), (5, " \n ")], "doc_id long, text string")
    rows = chunk_recursive(df).orderBy("doc_id", "chunk_ix").collect()
    assert [r["chunk"] for r in rows if r["doc_id"] == 1] == got
    assert [(r["doc_id"], r["chunk"]) for r in rows if r["doc_id"] > 1] == [(2, "tiny")]


def test_chunk_page_is_the_first_that_holds_its_head(spark):
    pages = spark.createDataFrame([(1, 1, "intro " + "a" * 50), (1, 2, "b" * 90), (1, 3, "a" * 50)],
                                  "doc_id long, page int, page_text string")
    chunks = spark.createDataFrame([(1, 0, "a" * 50), (1, 1, "b" * 85), (1, 2, "zz"), (1, 3, ""), (1, 4, "a" * 45)],
                                   "doc_id long, chunk_ix int, chunk string")
    got = {r["chunk_ix"]: r["page"] for r in DO.attach_page_meta(chunks, pages).collect()}
    assert got == {0: 3, 1: 2, 2: 1, 3: 1, 4: 1}


def test_schema_summary_and_drift(spark):
    rows = [("c", "wide", i, f"col{i}", "int") for i in range(30)] + [("c", "untyped", 0, "a", None),
                                                                        ("c", "empty", 0, None, None)]
    cols = spark.createDataFrame(rows, "connection_id string, table_name string, ordinal int, column_name string, data_type string")
    got = {r["table_name"]: r["summary"] for r in G.schema_summary(cols).collect()}
    assert got["wide"].startswith("wide: col0 (int), col1 (int)") and got["wide"].count("(int)") == 20
    assert got["untyped"] == "untyped: a (unknown)" and got["empty"] == "empty"
    old = spark.createDataFrame([("c", "t", "a", "int"), ("c", "t", "b", "text")],
                                "connection_id string, table_name string, column_name string, data_type string")
    new = spark.createDataFrame([("c", "t", "a", "bigint"), ("c", "t", "c", "text")],
                                "connection_id string, table_name string, column_name string, data_type string")
    drift = {r["column_name"]: r["change"] for r in G.schema_drift(old, new).collect()}
    assert drift == {"a": "retyped", "b": "removed", "c": "added"}


def test_page_marks_find_every_head(spark):
    """Any 40 characters of a page meet it, in pages with few different characters too."""
    import random
    r = random.Random(6)
    pages, chunks = [], []
    for d in range(12):
        texts = ["".join(r.choice("ab " if d % 3 else "abcdefghi é漢😀") for _ in range(r.randint(20, 400))) for _ in range(6)]
        pages += [(d, k + 1, t) for k, t in enumerate(texts)]
        for ix in range(25):
            t = r.choice(texts)
            at = r.randrange(max(1, len(t) - 39))
            chunks.append((d, ix, t[at:at + r.choice([10, 39, 40, 41, 60])] if ix % 5 else "".join(r.choice("ab ") for _ in range(45))))
    p = spark.createDataFrame(pages, "doc_id long, page int, page_text string")
    c = spark.createDataFrame(chunks, "doc_id long, chunk_ix int, chunk string")
    got = {(x.doc_id, x.chunk_ix): x.page for x in DO.attach_page_meta(c, p).collect()}
    for d, ix, text in chunks:
        mine = [(k, t) for e, k, t in pages if e == d]
        exact = [k for k, t in mine if t[:80] == text[:80]]
        held = [k for k, t in mine if text[:40] in t]
        assert got[d, ix] == (max(exact) if exact else min(held) if held else 1)
