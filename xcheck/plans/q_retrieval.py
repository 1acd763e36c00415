"""Retrieval queries over ``embeddings`` (vectors are inputs; no model runs).

Questions are the label centroids (one per label, a bounded batch derived from
the table); an item is relevant to a question when it carries that label.
Query variants of a question mix its centroid with the neighbouring labels'
centroids, standing in for phrase expansions.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..session import Tables
from .registry import query


def corpus(t: Tables) -> DataFrame:
    return R.with_unit(t.embeddings.select("vec_id", "label", "embedding"))


def centroids(t: Tables) -> DataFrame:
    """(qid = label, qunit): normalised mean vector per label (MLlib Summarizer:
    one partial-aggregated pass)."""
    e = t.embeddings.select("label", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("v"))
    m = e.groupBy("label").agg(vector_to_array(Summarizer.mean(F.col("v"))).alias("c"))
    return R.with_unit(m.select(F.col("label").cast("long").alias("qid"), "c"), vec="c", out="qunit").drop("c")


def variants(t: Tables) -> DataFrame:
    """(qid, list_ix, qunit): 0 = the centroid, 1/2 = centroid plus the next /
    previous label's centroid, renormalised."""
    c = centroids(t)
    nxt = c.select(((F.col("qid") + 9) % 10).alias("qid"), F.col("qunit").alias("n"))
    prv = c.select(((F.col("qid") + 1) % 10).alias("qid"), F.col("qunit").alias("p"))
    j = c.join(nxt, "qid").join(prv, "qid")
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    v = j.select("qid", F.array(F.struct(F.lit(0).alias("list_ix"), F.col("qunit").alias("v")),
                                F.struct(F.lit(1).alias("list_ix"), add("qunit", "n").alias("v")),
                                F.struct(F.lit(2).alias("list_ix"), add("qunit", "p").alias("v"))).alias("vs"))
    v = v.select("qid", F.explode("vs").alias("x")).select("qid", "x.list_ix", F.col("x.v").alias("v"))
    return R.with_unit(v, vec="v", out="qunit").drop("v")


def _sql_unit(x: str) -> str:
    return f"list_transform({x}, lambda e: CASE WHEN sqrt(list_dot_product({x}, {x})) = 0 THEN 0 ELSE e / sqrt(list_dot_product({x}, {x})) END)"


_SQL_BASE = f"""
  corp AS (SELECT vec_id, label, {_sql_unit('CAST(embedding AS DOUBLE[])')} AS unit FROM embeddings),
  dims AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m
           FROM (SELECT label, embedding, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL),
  cen AS (SELECT CAST(label AS BIGINT) AS qid, {_sql_unit('list(m ORDER BY i)')} AS qunit FROM dims GROUP BY label)"""


def _sql_topk(queries: str, k: int, where: str = "TRUE", part: str = "TRUE") -> str:
    return f"""
  SELECT * FROM (
    SELECT q.qid, c.vec_id, list_dot_product(q.qunit, c.unit) AS score,
           row_number() OVER (PARTITION BY q.qid ORDER BY list_dot_product(q.qunit, c.unit) DESC, c.vec_id) AS rank
    FROM {queries} q JOIN corp c ON {part} WHERE {where}) WHERE rank <= {k}"""


@query("vector_topk_join", oracle=f"WITH {_SQL_BASE}, t AS ({_sql_topk('cen', 5)}) "
       "SELECT qid, vec_id, rank, round(score, 6) AS score FROM t")
def vector_topk_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    r = R.topk(centroids(t), corpus(t), 5)
    return r.select("qid", "vec_id", "rank", F.round("score", 6).alias("score"))


@query("recall_at_k", oracle=f"""WITH {_SQL_BASE}, t AS ({_sql_topk('cen', 5)}),
  best AS (SELECT t.qid, min(rank) AS best FROM t JOIN corp c ON t.vec_id = c.vec_id AND c.label = t.qid GROUP BY t.qid),
  qs AS (SELECT qid, best FROM cen LEFT JOIN best USING (qid))
SELECT round(avg(CASE WHEN best <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_1,
       round(avg(CASE WHEN best <= 3 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_3,
       round(avg(CASE WHEN best <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_5 FROM qs""")
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    c = corpus(t)
    ranked = R.topk(centroids(t), c, 5)
    gold = c.select(F.col("label").cast("long").alias("qid"), "vec_id")
    r = R.recall_at_k(ranked, gold)
    return r.select(*[F.round(x, 6).alias(x) for x in r.columns])


@query("few_shot", oracle=f"WITH {_SQL_BASE}, t AS ({_sql_topk('cen', 3, where='list_dot_product(q.qunit, c.unit) >= 0.3', part='c.label = q.qid')}) "
       "SELECT qid, vec_id, rank, round(score, 6) AS score FROM t")
def few_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenant = label; the tenant's question is its centroid; past items of
    the same tenant with cosine >= 0.3 (parameter; 0.75 in the reference),
    best 3."""
    t = Tables(spark, sf_dir)
    q = centroids(t).withColumn("label", F.col("qid").cast("int"))
    r = R.topk(q, corpus(t), 3, partition_cols=["label"], min_score=0.3)
    return r.select("qid", "vec_id", "rank", F.round("score", 6).alias("score"))


@query("select_tables", oracle=f"""WITH {_SQL_BASE},
  g AS (SELECT i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM (SELECT embedding, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i),
  gq AS (SELECT {_sql_unit('list(m ORDER BY i)')} AS qunit FROM g),
  qq AS (SELECT DISTINCT CAST(label AS BIGINT) AS qid, qunit FROM embeddings, gq),
  t AS ({_sql_topk('qq', 5, part='c.label = q.qid')})
SELECT qid, vec_id, rank, round(score, 6) AS score FROM t""")
def select_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connection = label, its tables = its vectors; the question is the
    global centroid; 5 nearest tables per connection."""
    t = Tables(spark, sf_dir)
    e = t.embeddings.select(array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("v"))
    g = e.agg(vector_to_array(Summarizer.mean(F.col("v"))).alias("c")).first()["c"]   # one 64-d vector
    conns = t.embeddings.select("label").distinct().withColumn("c", F.array(*[F.lit(float(x)) for x in g]))
    q = R.with_unit(conns, vec="c", out="qunit").select(
        F.col("label").cast("long").alias("qid"), "label", "qunit")
    r = R.topk(q, corpus(t), 5, partition_cols=["label"])
    return r.select("qid", "vec_id", "rank", F.round("score", 6).alias("score"))


# ---------------------------------------------------------------------------
# Multi-variant retrieval: union -> dedup -> rerank -> citations
# ---------------------------------------------------------------------------

_SQL_VARIANTS = """
  nx AS (SELECT (qid + 9) % 10 AS qid, qunit AS n FROM cen),
  pv AS (SELECT (qid + 1) % 10 AS qid, qunit AS p FROM cen),
  vr0 AS (SELECT qid, 0 AS list_ix, qunit AS v FROM cen
          UNION ALL SELECT qid, 1, list_transform(range(1, len(qunit) + 1), lambda i: qunit[i] + n[i]) FROM cen JOIN nx USING (qid)
          UNION ALL SELECT qid, 2, list_transform(range(1, len(qunit) + 1), lambda i: qunit[i] + p[i]) FROM cen JOIN pv USING (qid)),
  vr AS (SELECT qid * 10 + list_ix AS vqid, qid, list_ix, """ + _sql_unit("v") + """ AS qunit FROM vr0)"""


def _lists(t: Tables, k: int, min_score: float | None = None) -> DataFrame:
    v = variants(t).withColumn("vqid", F.col("qid") * 10 + F.col("list_ix"))
    r = R.topk(v.select("vqid", "qunit"), corpus(t), k, qid="vqid", min_score=min_score)
    return r.join(v.select("vqid", "qid", "list_ix"), "vqid").drop("vqid")


@query("union_retrieval", oracle=f"""WITH {_SQL_BASE}, {_SQL_VARIANTS},
  l AS (SELECT v.qid, v.list_ix, t.vec_id, t.rank FROM ({_sql_topk('vr', 8).replace('q.qid', 'q.vqid')}) t JOIN vr v ON t.vqid = v.vqid),
  d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, vec_id ORDER BY list_ix, rank) AS k FROM l) WHERE k = 1)
SELECT qid, vec_id, list_ix, rank FROM d""")
def union_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-8 per variant, merged; first occurrence per item wins (dedup_first)."""
    lists = _lists(Tables(spark, sf_dir), 8).select("qid", "vec_id", "list_ix", "rank")
    return R.dedup_ranked(lists, ["vec_id"])


def _retrieve(t: Tables) -> DataFrame:
    lists = _lists(t, 8).select("qid", "vec_id", "list_ix", "rank")
    merged = R.dedup_ranked(lists, ["vec_id"])
    c = corpus(t)
    q = centroids(t)
    scored = (merged.join(c.select("vec_id", "label", "unit"), "vec_id").join(q, "qid")
              .withColumn("rerank_score", F.aggregate(F.zip_with("qunit", "unit", lambda x, y: x * y),
                                                      F.lit(0.0), lambda a, x: a + x)))
    return R.rerank_topk(scored, 5)


@query("retrieve", oracle=f"""WITH {_SQL_BASE}, {_SQL_VARIANTS},
  l AS (SELECT v.qid, v.list_ix, t.vec_id, t.rank FROM ({_sql_topk('vr', 8).replace('q.qid', 'q.vqid')}) t JOIN vr v ON t.vqid = v.vqid),
  d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, vec_id ORDER BY list_ix, rank) AS k FROM l) WHERE k = 1),
  s AS (SELECT d.*, list_dot_product(cen.qunit, corp.unit) AS sc FROM d JOIN corp USING (vec_id) JOIN cen USING (qid)),
  f AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sc DESC, list_ix, rank) AS final_rank FROM s)
SELECT qid, vec_id, final_rank FROM f WHERE final_rank <= 5""")
def retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """expand -> search each variant (k=8) -> dedup -> rerank to 5."""
    return _retrieve(Tables(spark, sf_dir)).select("qid", "vec_id", "final_rank")


@query("cite_sources", oracle=f"""WITH {_SQL_BASE}, {_SQL_VARIANTS},
  l AS (SELECT v.qid, v.list_ix, t.vec_id, t.rank FROM ({_sql_topk('vr', 8).replace('q.qid', 'q.vqid')}) t JOIN vr v ON t.vqid = v.vqid),
  d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, vec_id ORDER BY list_ix, rank) AS k FROM l) WHERE k = 1),
  s AS (SELECT d.*, corp.label, list_dot_product(cen.qunit, corp.unit) AS sc FROM d JOIN corp USING (vec_id) JOIN cen USING (qid)),
  f AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sc DESC, list_ix, rank) AS final_rank FROM s)
SELECT qid, 'label-' || label AS source, vec_id // 10 AS page, min(final_rank) AS first_rank FROM f WHERE final_rank <= 5 GROUP BY ALL""")
def cite_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (source, page) in retrieval order: source = label collection,
    page = block of ten vector ids."""
    r = _retrieve(Tables(spark, sf_dir)).withColumn("source", F.concat(F.lit("label-"), F.col("label"))) \
        .withColumn("page", (F.col("vec_id") / 10).cast("long"))
    return R.citations(r, "source", "page")


@query("deep_retrieve", oracle=f"""WITH {_SQL_BASE}, {_SQL_VARIANTS},
  p1 AS (SELECT v.qid, v.list_ix, t.vec_id, t.rank, 1 AS pass FROM ({_sql_topk('vr', 6, where='list_dot_product(q.qunit, c.unit) >= 0.45').replace('q.qid', 'q.vqid')}) t JOIN vr v ON t.vqid = v.vqid),
  few AS (SELECT vqid FROM vr WHERE (SELECT count(*) FROM p1 WHERE p1.qid * 10 + p1.list_ix = vr.vqid) < 2),
  p2 AS (SELECT v.qid, v.list_ix, t.vec_id, t.rank, 2 AS pass FROM ({_sql_topk('vr', 12).replace('q.qid', 'q.vqid')}) t JOIN vr v ON t.vqid = v.vqid
         WHERE t.vqid IN (SELECT vqid FROM few)),
  a AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2),
  d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, vec_id ORDER BY pass, list_ix, rank) AS k FROM a) WHERE k = 1)
SELECT qid, vec_id, pass, list_ix, rank FROM d""")
def deep_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sub-questions = the variants. Pass 1: k=6 with a score floor (0.45);
    sub-questions left with fewer than 2 chunks get pass 2 (k=12, no floor);
    results merged, first occurrence wins (pass, sub-question, rank)."""
    t = Tables(spark, sf_dir)
    p1 = _lists(t, 6, min_score=0.45).withColumn("pass", F.lit(1))
    v = variants(t).select("qid", "list_ix")
    cnt = p1.groupBy("qid", "list_ix").agg(F.count(F.lit(1)).alias("n"))
    few = v.join(cnt, ["qid", "list_ix"], "left").where(F.coalesce("n", F.lit(0)) < 2).select("qid", "list_ix")
    p2 = _lists(t, 12).join(few, ["qid", "list_ix"], "left_semi").withColumn("pass", F.lit(2))
    allr = p1.unionByName(p2).select("qid", "vec_id", "pass", "list_ix", "rank")
    best = allr.groupBy("qid", "vec_id").agg(F.min_by(F.struct("pass", "list_ix", "rank"),
                                                      F.struct("pass", "list_ix", "rank")).alias("b"))
    return best.select("qid", "vec_id", "b.pass", "b.list_ix", "b.rank")


@query("lsh_neighbors")
def lsh_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate near-duplicate vector pairs (cosine >= 0.9) via bucketed
    random-projection LSH; checked against brute force on a fixture in tests."""
    c = corpus(Tables(spark, sf_dir))
    return R.lsh_neighbors(c, threshold=(2 - 2 * 0.9) ** 0.5)


# ---------------------------------------------------------------------------
# Query expansion over conversation questions
# ---------------------------------------------------------------------------

def _sql_expand() -> str:
    from ..functions import rules
    parts = ["[text]"]
    for trig, exps in rules.EXPANSION_RULES:
        tarr = "[" + ", ".join(f"'{w}'" for w in trig) + "]"
        earr = "[" + ", ".join(f"'{e}'" for e in exps) + "]"
        parts.append(f"CASE WHEN len(list_intersect(toks, {tarr})) > 0 THEN {earr} ELSE []::VARCHAR[] END")
    allq = "list_concat(" + ", ".join(parts) + ")" if len(parts) > 1 else parts[0]
    allq = parts[0]
    for p in parts[1:]:
        allq = f"list_concat({allq}, {p})"
    return f"""
WITH q AS (SELECT conv_id, turn, text, regexp_extract_all(lower(text), '[\\pL\\pN_]+') AS toks FROM conversations WHERE role = 'user'),
  a AS (SELECT conv_id, turn, {allq} AS qs FROM q),
  e AS (SELECT conv_id, turn, unnest(qs) AS query, generate_subscripts(qs, 1) AS pos FROM a),
  d AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, lower(regexp_replace(query, '^\\s+|\\s+$', '', 'g')) ORDER BY pos) AS k FROM e)
SELECT conv_id, turn, query, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) - 1 AS ix FROM d WHERE k = 1"""


@query("expand_queries", oracle=_sql_expand())
def expand_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Tables(spark, sf_dir).conversations.where(F.col("role") == "user")
    return R.expand_queries(c, ["conv_id", "turn"], "text")
