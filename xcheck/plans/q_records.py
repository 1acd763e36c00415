"""Exports, appended history, stored rows, workspace, semantic chunks, error
classes and explanations over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import records as RC
from ..operators import retrieval as R
from ..session import Tables
from ..streaming.core import scratch
from .q_convo import _MSGS, _msgs
from .q_docs import _SQL_END, _sql_strip
from .registry import query


def _sources(t: Tables) -> DataFrame:
    """Assistant turns cite the document of their conversation's number (page =
    turn) and, from the third turn on, the conversation's first page too."""
    m = _msgs(t).where("role = 'assistant'").join(t.documents.select(F.col("doc_id").alias("conv_id"), F.col("source").alias("src")), "conv_id")
    cited = F.array(F.struct(F.lit(0).alias("ix"), F.concat("src", F.lit(".pdf")).alias("source"), F.col("turn").alias("page")),
                    F.when(F.col("turn") > 2, F.struct(F.lit(1).alias("ix"), F.concat("src", F.lit(".pdf")).alias("source"), F.lit(1).cast("long").alias("page"))))
    return m.select("conv_id", "turn", F.inline(F.array_compact(cited)))


_SQL_CITED = f"""
  src AS (SELECT m.conv_id, m.turn, [{{'source': d.source || '.pdf', 'page': m.turn}}] ||
                 CASE WHEN m.turn > 2 THEN [{{'source': d.source || '.pdf', 'page': CAST(1 AS BIGINT)}}] ELSE [] END AS sources
          FROM {_MSGS} m JOIN documents d ON d.doc_id = m.conv_id WHERE role = 'assistant'),
  ci AS (SELECT m.*, coalesce(sources, []) AS sources FROM {_MSGS} m LEFT JOIN src USING (conv_id, turn))"""


@query("conversation_export_json", oracle=f"""WITH {_SQL_CITED}
SELECT conv_id, turn AS position, CAST(to_json({{'role': role, 'content': text, 'sources': sources}}) AS VARCHAR) AS message FROM ci""")
def conversation_export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return RC.export_json(_msgs(t), _sources(t))


@query("conversation_export_markdown", oracle=f"""WITH {_SQL_CITED}
SELECT conv_id, CAST(-1 AS BIGINT) AS position, '# Conversation Export' || chr(10) || chr(10) || '**Session ID:** ' || conv_id || chr(10) || '**Persona:** Generalist' || chr(10)
       || '**Files:** ' || coalesce((SELECT source || '.pdf' FROM documents WHERE doc_id = conv_id), '') || chr(10) || chr(10) || '---' || chr(10) AS block
FROM (SELECT DISTINCT conv_id FROM {_MSGS})
UNION ALL
SELECT conv_id, turn, chr(10) || '### ' || CASE WHEN role = 'user' THEN '**You**' ELSE '**Assistant**' END || chr(10) || chr(10) || text || chr(10)
       || CASE WHEN len(sources) > 0 THEN chr(10) || '**Sources:**' || chr(10) || array_to_string(list_transform(sources, lambda s: '- ' || s.source || ', Page ' || s.page || chr(10)), '') ELSE '' END
       || chr(10) || '---' || chr(10) FROM ci""")
def conversation_export_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    files = t.documents.select(F.col("doc_id").alias("conv_id"), F.array(F.concat("source", F.lit(".pdf"))).alias("files"))
    sessions = _msgs(t).select("conv_id").distinct().join(files, "conv_id", "left").select(
        "conv_id", F.lit("Generalist").alias("persona"), F.coalesce("files", F.array().cast("array<string>")).alias("files"))
    return RC.export_markdown(_msgs(t), _sources(t), sessions)


@query("turn_order", oracle=f"SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS position, role FROM {_MSGS}")
def turn_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window
    w = Window.partitionBy("conv_id").orderBy("turn")
    return _msgs(Tables(spark, sf_dir)).select("conv_id", "turn", F.row_number().over(w).cast("long").alias("position"), "role")


@query("history_append", oracle="""
SELECT e.event_id AS id, e.user_id AS connection_id, 'question ' || json_extract_string(props, '$.k') AS nl_question, CAST(len(x.embedding) AS BIGINT) AS dims
FROM events e JOIN embeddings x ON x.vec_id = e.event_id WHERE e.event_type IN ('click', 'view')""")
def history_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answered questions appended in two calls, of which the second repeats the first's rows."""
    t = Tables(spark, sf_dir)
    asked = t.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("connection_id"), "event_type", F.concat(F.lit("question "), F.get_json_object("props", "$.k")).alias("nl_question"))
    asked = asked.join(t.embeddings.select(F.col("vec_id").alias("id"), "embedding"), "id")
    folder = scratch(spark, "history")
    RC.history_append(asked.where("event_type = 'click'").drop("event_type"), folder)
    out = RC.history_append(asked.where("event_type in ('click', 'view')").drop("event_type"), folder)
    return out.select("id", "connection_id", "nl_question", F.size("embedding").cast("long").alias("dims"))


@query("snapshot_rows", oracle="""
WITH r AS (SELECT c_custkey, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey),
  n AS (SELECT *, row_number() OVER (ORDER BY orders DESC, c_custkey) - 1 AS ix, count(*) OVER () AS row_count FROM r)
SELECT 'orders_by_customer' AS name, ix, '{"c_custkey":' || c_custkey || ',"orders":' || orders || '}' AS row, row_count FROM n WHERE ix < 500""")
def snapshot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    r = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_custkey").agg(F.count(F.lit(1)).alias("orders"))
    folder = scratch(spark, "snapshots")
    return RC.snapshot_rows(r.select("c_custkey", "orders"), "orders_by_customer", folder, [F.desc("orders"), "c_custkey"])


@query("files_summary", oracle="""
SELECT source, count(*) FILTER (WHERE length(text) > 0) AS file_count, CAST(coalesce(sum(len(string_split(text, chr(10)))) FILTER (WHERE length(text) > 0), 0) AS BIGINT) AS pages,
       CAST(coalesce(sum(strlen(text)) FILTER (WHERE length(text) > 0), 0) AS BIGINT) AS size, count(*) FILTER (WHERE coalesce(length(text), 0) = 0) AS unread
FROM documents GROUP BY source""")
def files_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session per source; a document is a file, its lines are pages."""
    d = Tables(spark, sf_dir).documents
    read = F.length("text") > 0
    files = d.select("source", F.concat("doc_id", F.lit(".pdf")).alias("filename"), F.when(read, F.size(F.split("text", "\n"))).alias("pages"), F.octet_length("text").alias("size"))
    return RC.files_summary(files, "source")


@query("workspace", oracle="""
WITH b AS (SELECT user_id, 'session' AS kind, event_id AS id, ts FROM events WHERE event_type = 'signup'
           UNION ALL SELECT user_id, 'connection', event_id, ts FROM events WHERE event_type = 'purchase')
SELECT user_id, kind, id, CAST(ix AS BIGINT) AS ix FROM (SELECT *, row_number() OVER (PARTITION BY user_id, kind ORDER BY ts DESC, id DESC) AS ix FROM b) WHERE ix <= 20""")
def workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups are sessions, purchases are connections made."""
    e = Tables(spark, sf_dir).events.select("user_id", F.col("event_id").alias("id"), F.col("ts").alias("created_at"), "event_type")
    return RC.workspace(e.where("event_type = 'signup'"), e.where("event_type = 'purchase'"), "user_id").select("user_id", "kind", "id", F.col("ix").cast("long").alias("ix"))


@query("ingest_results", oracle="""
WITH r AS (SELECT doc_id, source, doc_id IN (SELECT doc_id FROM labels) AS known, length(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) AS n FROM documents)
SELECT doc_id, source, CASE WHEN known THEN 'cached' WHEN n < 100 THEN 'failed' ELSE 'ingested' END AS status,
       CASE WHEN NOT known AND n < 100 THEN 'only ' || n || ' characters of text' END AS message FROM r""")
def ingest_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every filing of the feed with its outcome; labelled documents are cached already."""
    t = Tables(spark, sf_dir)
    return RC.ingest_results(t.documents.select("doc_id", "source", "text"), t.labels, "doc_id")


_ERRORS = ["FATAL: Password authentication failed for user", "permission denied for table orders", "could not connect to server", "connection timed out", "SSL is required here",
           'relation "orders" does not exist', 'Unknown column o_total in field list', "syntax error at or near FROM", "canceling statement due to statement timeout", "Deadlock found",
           "snapshot isolation transaction failed", "disk full " + "x" * 220]


@query("classify_error", oracle="WITH m AS (SELECT event_id, [" + ", ".join("'" + e.replace("'", "''") + "'" for e in _ERRORS)
       + f"""][1 + CAST(json_extract_string(props, '$.k') AS INT) % {len(_ERRORS)}] AS msg, CASE WHEN user_id % 2 = 0 THEN 'azure_sql' ELSE 'postgresql' END AS dialect FROM events WHERE event_type = 'error')
SELECT event_id, CASE """ + " ".join("WHEN " + " OR ".join("(" + " AND ".join(f"contains(lower(msg), '{part}')" for part in p.split("&")) + ")" for p in phrases) + f" THEN '{text}'"
                                  for phrases, text in RC.ERROR_RULES)
       + f" WHEN dialect = 'azure_sql' AND contains(lower(msg), '{RC.AZURE_RULE[0]}') THEN '{RC.AZURE_RULE[1]}' ELSE 'Database error: ' || left(msg, 200) END AS said FROM m")
def classify_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events carry a driver's text, chosen by their number k."""
    e = Tables(spark, sf_dir).events.where("event_type = 'error'")
    k = F.get_json_object("props", "$.k").cast("int") % len(_ERRORS)
    texts = F.array(*[F.lit(x) for x in _ERRORS])
    dialect = F.when(F.col("user_id") % 2 == 0, "azure_sql").otherwise("postgresql")
    return e.select("event_id", RC.classify_error(F.get(texts, k), dialect).alias("said"))


_CLAUSES = [(2, "SELECT COUNT(*)", "SELECT *"), (3, " FROM orders JOIN customer ON o_custkey = c_custkey", " FROM orders"), (5, " where o_totalprice > 10", ""), (7, " GROUP BY o_orderstatus", ""),
            (4, " order by 1", "")]


@query("explain_select", oracle="WITH s AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE event_type = 'click'), q AS (SELECT event_id, k, "
       + " || ".join(f"CASE WHEN k % {n} = 0 THEN '{a}' ELSE '{b}' END" for n, a, b in _CLAUSES) + " AS sql FROM s), p AS (SELECT event_id, k, list_filter(["
       + ", ".join("CASE WHEN " + " OR ".join(f"contains(upper(sql), '{p}')" for p in phrases) + f" THEN '{text}' END" for phrases, text in RC.EXPLAIN_RULES)
       + "], lambda x: x IS NOT NULL) AS parts FROM q) SELECT event_id, 'This query ' || CASE WHEN len(parts) > 0 THEN array_to_string(parts, ', ') || ' from' ELSE 'queries' END || ' ' || "
         "CASE WHEN k % 11 = 0 THEN 'the database' WHEN k % 3 = 0 THEN 'orders, customer' ELSE 'orders' END || '.' AS explanation FROM p")
def explain_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Click events are queries of the history, with clauses by their number k."""
    e = Tables(spark, sf_dir).events.where("event_type = 'click'").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    sql = F.concat(*[F.when(F.col("k") % n == 0, a).otherwise(b) for n, a, b in _CLAUSES])
    none = F.array().cast("array<string>")
    tables = F.when(F.col("k") % 11 == 0, none).when(F.col("k") % 3 == 0, F.array(F.lit("orders"), F.lit("customer"))).otherwise(F.array(F.lit("orders")))
    return e.select("event_id", RC.explain_select(sql, tables).alias("explanation"))


_SQL_TYPED = "(SELECT doc_id, text, CASE WHEN lang = 'en' THEN 'financial' ELSE 'general' END AS doc_type FROM documents)"


@query("chunk_semantic", oracle=f"""
WITH RECURSIVE td AS {_SQL_TYPED},
  vc AS (SELECT count(*) AS n FROM embeddings),
  se AS (SELECT doc_id, unnest(string_split(t, chr(1))) AS sentence, generate_subscripts(string_split(t, chr(1)), 1) - 1 AS ix
         FROM (SELECT doc_id, regexp_replace(text, '([.?!])\\s+', '\\1' || chr(1), 'g') AS t FROM td WHERE doc_type = 'financial')),
  u AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda e: e / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS v FROM embeddings),
  sv AS (SELECT se.*, u.v FROM se, vc JOIN u ON u.vec_id = (se.doc_id * 7 + se.ix) % vc.n),
  d AS (SELECT *, 1 - list_dot_product(v, lead(v) OVER (PARTITION BY doc_id ORDER BY ix)) AS dist FROM sv),
  th AS (SELECT doc_id, quantile_cont(dist, 0.85) AS thr FROM d GROUP BY doc_id),
  b AS (SELECT d.doc_id, d.ix, d.sentence, CASE WHEN dist > thr THEN 1 ELSE 0 END AS brk FROM d JOIN th USING (doc_id)),
  n AS (SELECT *, coalesce(sum(brk) OVER (PARTITION BY doc_id ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk_ix FROM b),
  c AS (
    SELECT doc_id, text, s, {_SQL_END} AS e FROM (SELECT doc_id, text, CAST(0 AS BIGINT) AS s FROM td WHERE doc_type <> 'financial')
    UNION ALL
    SELECT doc_id, text, s, {_SQL_END} AS e FROM (
      SELECT doc_id, text, e - 200 + instr(replace(substr(text, e - 199, 200), chr(10), ' '), ' ') AS s FROM c WHERE e < length(text))),
  k AS (SELECT doc_id, s, {_sql_strip('substr(text, s + 1, e - s)')} AS chunk FROM c)
SELECT doc_id, CAST(chunk_ix AS BIGINT) AS chunk_ix, md5(string_agg(sentence, ' ' ORDER BY ix)) AS chunk_md5, 'semantic' AS method FROM n GROUP BY doc_id, chunk_ix
UNION ALL SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1, md5(chunk), 'length' FROM k WHERE chunk <> ''""")
def chunk_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents count as financial; a sentence's vector is the row of
    ``embeddings`` that its document and place number (7 * document + place, round the table)."""
    t = Tables(spark, sf_dir)
    docs = t.documents.select("doc_id", "text", F.when(F.col("lang") == "en", "financial").otherwise("general").alias("doc_type"))
    e = R.with_unit(t.embeddings.select("vec_id", "embedding")).select("vec_id", "unit")
    n = e.count()
    place = RC.sentences(docs.where("doc_type = 'financial'")).select("doc_id", "ix", F.pmod(F.col("doc_id") * 7 + F.col("ix"), F.lit(n)).alias("vec_id"))
    vectors = place.join(e, "vec_id").select("doc_id", "ix", "unit")
    out = RC.chunk_semantic(docs, vectors)
    return out.select("doc_id", F.col("chunk_ix").cast("long").alias("chunk_ix"), F.md5("chunk").alias("chunk_md5"), "method")
