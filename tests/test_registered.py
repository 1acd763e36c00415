"""SQL functions against their Column twins."""

from pyspark.sql import functions as F

from xcheck.functions import text as T
from xcheck.functions.registered import register_all
from xcheck.operators import chunking, facts, pii

TEXTS = [None, "", "Total revenue: $1,234.50M. Net sales were 12k and losses -3", "call 555-867-5309 or bob@test.com", "Sales = 5 ; sales: 5.001; Cost at €7bn",
         "word " * 700, "AB: 12", "+31 6 1234 5678, 4111 1111 1111 1111 a@b.co"]


def test_scalar_twins(spark):
    names = register_all(spark)
    assert {"mask_pii", "extract_facts", "chunk_text", "cosine", "jaccard_labels", "align_scale", "parse_amount"} <= set(names)
    df = spark.createDataFrame([(i, t, TEXTS[-1 - i], float(10 ** i), 3.7) for i, t in enumerate(TEXTS)], "i int, s string, t string, a double, b double")
    a2, b2 = T.align_scale("a", "b")
    columns = {"normalize_label(s)": T.normalize_label("s"), "label_tokens(s)": T.label_tokens("s"), "parse_amount(s)": T.parse_amount("s"), "mask_pii(s)": pii.mask_value("s"),
               "mask_email(s)": pii.mask_email("s"), "jaccard_labels(s, t)": T.jaccard(T.label_tokens("s"), T.label_tokens("t")), "align_scale(a, b).a": a2, "align_scale(a, b).b": b2,
               "clean_column_name(s)": T.clean_column_name("s"), "squeeze_spaces(s)": T.squeeze_spaces("s"), "cosine(array(a, b), array(b, a))": T.cosine(F.array("a", "b"), F.array("b", "a"))}
    for sql, column in columns.items():
        rows = df.select("i", F.expr(sql).alias("x"), column.alias("y")).collect()
        assert all(r.x == r.y or (isinstance(r.x, float) and abs(r.x - r.y) < 1e-9) for r in rows), sql
    amounts = spark.createDataFrame([("$2.4M",), ("15%",), ("3k",), ("x",), (None,)], "s string")
    assert [r[0] for r in amounts.select(F.expr("parse_amount(s)")).collect()] == [2.4e6, 15.0, 3000.0, None, None]


def test_facts_and_chunks(spark):
    register_all(spark)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    df.createOrReplaceTempView("some_docs")
    got = spark.sql("SELECT doc_id, f.ix, f.label, f.value, f.raw_text FROM (SELECT doc_id, extract_facts(text) AS facts FROM some_docs) LATERAL VIEW explode(facts) e AS f").collect()
    want = facts.extract_facts(df).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want
    got = spark.sql("SELECT doc_id, chunk_ix, chunk FROM some_docs, LATERAL chunk_text(text, 500, 50)").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, chunking.chunk_recursive(df, size=500, overlap=50).collect()))
