"""Exports, error rules, explanations and semantic chunks on small tables."""

from pyspark.sql import functions as F

from xcheck.operators import records as RC


def test_error_rules(spark):
    cases = [("ORA: Access denied for user", "x", "Authentication failed. Please check your username and password."),
             ("ssl connection is required", "x", "SSL configuration mismatch. Check whether the server requires or rejects SSL connections."),
             ("ssl handshake", "x", "Database error: ssl handshake"), ('column "a" does not exist', "x", "Table not found. The schema may have changed — try refreshing the schema."),
             ("bad column a", "x", "Column not found. The table structure may have changed — try refreshing the schema."),
             ("snapshot isolation off", "azure_sql", "Azure SQL snapshot isolation is not enabled on this database."), ("snapshot isolation off", "mysql", "Database error: snapshot isolation off"),
             ("y" * 300, "x", "Database error: " + "y" * 200)]
    df = spark.createDataFrame([(m, d) for m, d, _ in cases], "m string, d string")
    assert [r[0] for r in df.select(RC.classify_error("m", "d")).collect()] == [w for _, _, w in cases]


def test_explanations(spark):
    df = spark.createDataFrame([("select sum(x) from t where a group by b order by 1", ["t"]), ("select * from a join b", ["a", "b"]), ("select 1", [])], "q string, t array<string>")
    assert [r[0] for r in df.select(RC.explain_select("q", "t")).collect()] == [
        "This query groups results, orders by a column, filters rows by a condition, computes aggregates from t.", "This query joins multiple tables from a, b.", "This query queries the database."]


def test_exports(spark):
    m = spark.createDataFrame([(1, 0, "user", 'a "q"\n'), (1, 1, "assistant", "b"), (2, 0, "user", None)], "conv_id long, turn long, role string, text string")
    s = spark.createDataFrame([(1, 1, 1, "y.pdf", 9), (1, 1, 0, "x.pdf", 2)], "conv_id long, turn long, ix int, source string, page long")
    got = {(r.conv_id, r.position): r.message for r in RC.export_json(m, s).collect()}
    assert got[1, 1] == '{"role":"assistant","content":"b","sources":[{"source":"x.pdf","page":2},{"source":"y.pdf","page":9}]}'
    assert got[1, 0] == '{"role":"user","content":"a \\"q\\"\\n","sources":[]}' and got[2, 0] == '{"role":"user","content":null,"sources":[]}'
    head = spark.createDataFrame([(1, "Lawyer", ["x.pdf", "y.pdf"])], "conv_id long, persona string, files array<string>")
    blocks = [r.block for r in RC.export_markdown(m.where("conv_id = 1"), s, head).orderBy("position").collect()]
    assert blocks[0].startswith("# Conversation Export\n\n**Session ID:** 1\n**Persona:** Lawyer\n**Files:** x.pdf, y.pdf\n") and blocks[2] == (
        "\n### **Assistant**\n\nb\n\n**Sources:**\n- x.pdf, Page 2\n- y.pdf, Page 9\n\n---\n")


def test_chunks_fall_back(spark):
    docs = spark.createDataFrame([(1, "One. Two! Three? Four.", "legal"), (2, "One. Two.", "general"), (3, "No vector. Here.", "legal"), (4, "Alone", "legal")],
                                 "doc_id long, text string, doc_type string")
    v = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (1, 2, [0.0, 1.0]), (1, 3, [0.0, 1.0]), (3, 0, [1.0, 0.0]), (4, 0, [1.0, 0.0])], "doc_id long, ix int, unit array<double>")
    got = {(r.doc_id, r.chunk_ix): (r.chunk, r.method) for r in RC.chunk_semantic(docs, v).collect()}
    assert got == {(1, 0): ("One. Two!", "semantic"), (1, 1): ("Three? Four.", "semantic"), (2, 0): ("One. Two.", "length"), (3, 0): ("No vector. Here.", "length"), (4, 0): ("Alone", "semantic")}


def test_ingest_outcomes(spark):
    feed = spark.createDataFrame([(1, "long " * 40), (2, "short"), (3, None), (4, "x" * 200)], "doc_id long, text string")
    cache = spark.createDataFrame([(4,), (4,)], "doc_id long")
    got = {r.doc_id: (r.status, r.message) for r in RC.ingest_results(feed, cache, "doc_id").collect()}
    assert got == {1: ("ingested", None), 2: ("failed", "only 5 characters of text"), 3: ("failed", "only 0 characters of text"), 4: ("cached", None)}
    files = spark.createDataFrame([("s", "a", 3, 10), ("s", "b", None, None)], "s string, filename string, pages int, size long")
    assert tuple(RC.files_summary(files, "s").first()) == ("s", 1, 3, 10, 1)
