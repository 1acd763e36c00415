"""Routing flags, forms, evaluation, semantic breaks, sinks, housekeeping and
scalar functions over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import docs as DO
from ..operators import facts as FX
from ..operators import housekeeping as H
from ..operators import retrieval as R
from ..operators import routing as RT
from ..session import Tables, checkpoint_dir
from .q_docs import _sql_doc_type
from .q_discrepancy import order_statements
from .q_pii import SQL_MASKED
from .registry import query


def _sql_word(p: str) -> str:
    return f"regexp_matches(lower(text), '(^|[^\\pL\\pN_])({p})([^\\pL\\pN_]|$)')"


@query("question_flags", oracle=f"""
SELECT conv_id, turn, {_sql_word(RT.NEEDS_MODEL)} AS needs_model, {_sql_word(RT.IS_FORECAST)} AS is_forecast,
       {_sql_word(RT.WANTS_PLOT)} AS wants_plot FROM conversations WHERE role = 'user'""")
def question_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Tables(spark, sf_dir).conversations.where(F.col("role") == "user")
    f = RT.question_flags("text")
    return c.select("conv_id", "turn", f["needs_model"].alias("needs_model"), f["is_forecast"].alias("is_forecast"),
                    f["wants_plot"].alias("wants_plot"))


def _conv_sources(t: Tables) -> DataFrame:
    """Per conversation: a database is connected when some answer is longer than
    100 characters; documents when a summary (system turn) exists."""
    c = t.conversations
    flags = c.groupBy("conv_id").agg(F.max((F.col("role") == "assistant") & (F.length("text") > 100)).alias("has_db"),
                                     F.max(F.col("role") == "system").alias("has_docs"))
    return c.where(F.col("role") == "user").join(flags, "conv_id")


_SQL_FLAGS = """
  fl AS (SELECT conv_id, bool_or(role = 'assistant' AND length(text) > 100) AS has_db, bool_or(role = 'system') AS has_docs
         FROM conversations GROUP BY conv_id),
  u AS (SELECT c.conv_id, c.turn, lower(c.text) AS s, has_db, has_docs, false AS has_csv
        FROM conversations c JOIN fl USING (conv_id) WHERE role = 'user')"""


def _sql_list(xs):
    return "[" + ", ".join("'" + x + "'" for x in xs) + "]"


_SQL_TOOL = f"""
  k AS (SELECT *, len(list_filter({_sql_list(RT.PYTHON_KEYWORDS)}, lambda x: contains(s, x))) > 0 AS has_chart,
               len(list_filter({_sql_list(RT.DATA_FETCH)}, lambda x: starts_with(s, x) OR contains(s, ' ' || x))) > 0 AS has_fetch,
               len(list_filter({_sql_list(RT.DOC_KEYWORDS)}, lambda x: contains(s, x))) > 0 AS has_doc FROM u),
  r AS (SELECT *, CASE WHEN NOT has_db AND NOT has_docs AND NOT has_csv THEN 'unsupported'
                   WHEN has_csv AND NOT has_doc THEN 'python_analysis'
                   WHEN has_chart AND NOT has_fetch THEN 'python_analysis'
                   WHEN has_doc THEN 'doc_search'
                   WHEN has_fetch OR NOT has_chart THEN CASE WHEN has_db AND NOT has_csv THEN 'sql_query'
                        WHEN has_csv THEN 'python_analysis' WHEN has_docs THEN 'doc_search' ELSE 'python_analysis' END
                   WHEN has_db AND NOT has_csv THEN 'sql_query' WHEN has_docs THEN 'doc_search'
                   ELSE 'python_analysis' END AS tool FROM k)"""


@query("route_tool", oracle=f"WITH {_SQL_FLAGS}, {_SQL_TOOL} SELECT conv_id, turn, tool FROM r")
def route_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _conv_sources(Tables(spark, sf_dir))
    return u.select("conv_id", "turn", RT.route_tool("text", "has_db", "has_docs", F.lit(False)).alias("tool"))


@query("route_source", oracle=f"""WITH {_SQL_FLAGS}, {_SQL_TOOL}
SELECT conv_id, turn, CASE WHEN NOT has_db THEN 'doc' WHEN NOT has_docs THEN 'sql'
  WHEN (CASE tool WHEN 'sql_query' THEN 'sql' WHEN 'doc_search' THEN 'doc' ELSE 'other' END) IN ('sql', 'doc', 'hybrid')
  THEN (CASE tool WHEN 'sql_query' THEN 'sql' WHEN 'doc_search' THEN 'doc' ELSE 'other' END) ELSE 'hybrid' END AS source
FROM r""")
def route_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sources present -> the intent label (here the tool route mapped to
    sql/doc; anything else is not a valid label and becomes hybrid)."""
    u = _conv_sources(Tables(spark, sf_dir)).withColumn(
        "tool", RT.route_tool("text", "has_db", "has_docs", F.lit(False)))
    label = F.when(F.col("tool") == "sql_query", "sql").when(F.col("tool") == "doc_search", "doc").otherwise("other")
    return u.select("conv_id", "turn", RT.route_source("has_db", "has_docs", label).alias("source"))


# ---------------------------------------------------------------------------
# Form fields: every customer is a form
# ---------------------------------------------------------------------------

def _forms(t: Tables) -> DataFrame:
    c = t.customer
    f = F.array(
        F.struct(F.lit(0).alias("ix"), F.lit("customer_Name").alias("name"), F.col("c_name").alias("value")),
        F.struct(F.lit(1).alias("ix"), F.lit("mktSegment").alias("name"), F.col("c_mktsegment").alias("value")),
        F.struct(F.lit(2).alias("ix"), F.lit("account--balance").alias("name"),
                 F.format_string("%.2f", "c_acctbal").alias("value")),
        F.struct(F.lit(3).alias("ix"), F.lit("optIn").alias("name"),
                 F.when(F.col("c_acctbal") < 0, "Off").otherwise("True").alias("value")),
        F.struct(F.lit(4).alias("ix"), F.lit("Customer name").alias("name"), F.lit("duplicate").alias("value")),
        F.struct(F.lit(5).alias("ix"), F.lit("NationKey").alias("name"), F.col("c_nationkey").cast("string").alias("value")))
    return c.select(F.col("c_custkey").alias("doc_id"), F.explode(f).alias("f")).select("doc_id", "f.*")


@query("form_fields_to_text", oracle="""
SELECT c_custkey AS doc_id,
  'customer Name: ' || c_name || chr(10) || 'mkt Segment: ' || c_mktsegment || chr(10) || 'account balance: ' || printf('%.2f', c_acctbal)
  || CASE WHEN c_acctbal < 0 THEN '' ELSE chr(10) || 'opt In: True' END || chr(10) || 'Nation Key: ' || c_nationkey AS text
FROM customer""")
def form_fields_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.form_fields_to_text(_forms(Tables(spark, sf_dir)))


# ---------------------------------------------------------------------------
# Evaluation: the extractability rule against the quality labels
# ---------------------------------------------------------------------------

def _pred_gold(t: Tables):
    pred = (DO.with_extractable(t.documents.select("doc_id", "text")).where("extractable")
            .select("doc_id", F.lit("quality").alias("label")))
    gold = t.labels.where(F.col("quality") == 1).select("doc_id", F.lit("quality").alias("label"))
    return pred, gold


@query("classification_report", oracle=_sql_doc_type() + """,
  p AS (SELECT doc_id FROM t WHERE ntok >= 50 AND (doc_type <> 'general' OR ndig / ntok >= 0.015)),
  g AS (SELECT doc_id FROM labels WHERE quality = 1),
  c AS (SELECT count(*) FILTER (WHERE p.doc_id IS NOT NULL AND g.doc_id IS NOT NULL) AS tp,
               count(*) FILTER (WHERE g.doc_id IS NULL) AS fp, count(*) FILTER (WHERE p.doc_id IS NULL) AS fn
        FROM p FULL OUTER JOIN g USING (doc_id)),
  m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0 END AS precision,
               CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0 END AS recall FROM c)
SELECT tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1 FROM m""")
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred, gold = _pred_gold(Tables(spark, sf_dir))
    r = H.classification_report(pred, gold, "doc_id", "label")
    return r.select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("missing_labels", oracle=_sql_doc_type() + """,
  p AS (SELECT doc_id FROM t WHERE ntok >= 50 AND (doc_type <> 'general' OR ndig / ntok >= 0.015)),
  g AS (SELECT doc_id FROM labels WHERE quality = 1)
SELECT doc_id, 'quality' AS label, 'fn' AS kind FROM (SELECT doc_id FROM g EXCEPT ALL SELECT doc_id FROM p)
UNION ALL SELECT doc_id, 'quality', 'fp' FROM (SELECT doc_id FROM p EXCEPT ALL SELECT doc_id FROM g)""")
def missing_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred, gold = _pred_gold(Tables(spark, sf_dir))
    return H.missing_labels(pred, gold, ["doc_id", "label"])


# ---------------------------------------------------------------------------
# Semantic breaks: embeddings as sentence vectors, documents = labels
# ---------------------------------------------------------------------------

@query("semantic_breaks", oracle="""
WITH u AS (SELECT vec_id, vec_id // 50 AS doc, list_transform(CAST(embedding AS DOUBLE[]), lambda e: e / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS v FROM embeddings),
  d AS (SELECT *, 1 - list_dot_product(v, lead(v) OVER (PARTITION BY doc ORDER BY vec_id)) AS dist FROM u),
  th AS (SELECT doc, quantile_cont(dist, 0.85) AS thr FROM d GROUP BY doc),
  b AS (SELECT d.vec_id, d.doc, CASE WHEN dist > thr THEN 1 ELSE 0 END AS brk FROM d JOIN th USING (doc))
SELECT vec_id, doc, CAST(coalesce(sum(brk) OVER (PARTITION BY doc ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS chunk_id FROM b""")
def semantic_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence vectors = ``embeddings`` in id order; a document = 50
    consecutive sentences. Chunk boundaries where the distance to the next
    sentence is above the document's 85th percentile."""
    e = Tables(spark, sf_dir).embeddings.select("vec_id", "embedding",
                                                  F.floor(F.col("vec_id") / 50).cast("long").alias("doc"))
    s = R.with_unit(e)
    return H.semantic_breaks(s, "doc", "vec_id").select("vec_id", "doc", F.col("chunk_id").cast("long"))


# ---------------------------------------------------------------------------
# Sinks and housekeeping
# ---------------------------------------------------------------------------

_REL_JOIN = """SELECT n_name, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"""


@query("snapshot_result", oracle=f"SELECT 'orders_by_nation' AS name, count(*) AS row_count, least(count(*), 500) AS stored_rows, "
       f"['n_name', 'orders'] AS columns FROM ({_REL_JOIN})")
def snapshot_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..session import register_views
    register_views(spark, sf_dir, ["orders", "customer", "nation"])
    return H.snapshot_manifest(spark.sql(_REL_JOIN), "orders_by_nation")


@query("purge_session", oracle="""
SELECT 'documents' AS tbl, count(*) AS remaining FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def purge_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purge every document flagged toxic from the documents and labels tables."""
    t = Tables(spark, sf_dir)
    ids = t.labels.where(F.col("toxic") == 1).select("doc_id")
    left = H.purge({"documents": t.documents, "labels": t.labels}, "doc_id", ids)
    parts = [df.agg(F.count(F.lit(1)).alias("remaining")).select(F.lit(n).alias("tbl"), "remaining")
             for n, df in left.items()]
    return parts[0].unionByName(parts[1])


@query("retention_sweep", oracle="""
WITH up AS (SELECT user_id, ts FROM events WHERE event_type = 'view'),
  now AS (SELECT max(ts) AS now FROM events),
  gone AS (SELECT DISTINCT user_id FROM up, now WHERE ts + INTERVAL 2 HOURS <= now)
SELECT 'uploads' AS tbl, count(*) AS kept FROM up WHERE user_id NOT IN (SELECT user_id FROM gone)
UNION ALL SELECT 'queries', count(*) FROM events WHERE event_type = 'click' AND user_id NOT IN (SELECT user_id FROM gone)""")
def retention_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads (views) expire 2 h after they happen, measured at the newest
    event; a user's expired uploads take the user's cached rows (queries) along."""
    e = Tables(spark, sf_dir).events
    now = e.agg(F.max("ts")).first()[0]
    up = e.where(F.col("event_type") == "view").select("user_id", "ts")
    dep = e.where(F.col("event_type") == "click").select("user_id", "event_id")
    ku, kd = H.retention_sweep(up, dep, "user_id", "ts", F.lit(now))
    return (ku.agg(F.count(F.lit(1)).alias("kept")).select(F.lit("uploads").alias("tbl"), "kept")
            .unionByName(kd.agg(F.count(F.lit(1)).alias("kept")).select(F.lit("queries").alias("tbl"), "kept")))


@query("sink_append_only", oracle=f"SELECT conv_id, turn, {SQL_MASKED} AS detail FROM conversations")
def sink_append_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns appended to an insert-only audit folder, detail masked."""
    import uuid
    c = Tables(spark, sf_dir).conversations.select("conv_id", "turn", F.col("text").alias("detail"))
    path = f"{checkpoint_dir(spark).rstrip('/')}/xcheck-audit/{uuid.uuid4().hex}"
    return H.append_audit(c, path, ["detail"])


@query("sink_csv_export", oracle="SELECT " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '') AS {c}"
                                                        for c in ("event_id", "ts", "user_id", "event_type", "value", "props")) + " FROM events")
def sink_csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events exported as CSV (nulls as empty strings) and read back."""
    import uuid
    path = f"{checkpoint_dir(spark).rstrip('/')}/xcheck-export/{uuid.uuid4().hex}"
    H.export_csv(Tables(spark, sf_dir).events, path)
    return spark.read.option("header", True).csv(path)


@query("ingest_summary", oracle="""
SELECT source, count(*) AS total,
       count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 100) AS ingested
FROM documents GROUP BY source""")
def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per feed batch (source): filings seen and filings ingested (new and long enough)."""
    t = Tables(spark, sf_dir)
    feed = t.documents.withColumn("accession", F.concat("source", F.lit("-"), "doc_id"))
    cache = t.labels.join(feed.select("doc_id", "accession"), "doc_id")
    new = DO.new_filings(feed, cache, "accession").groupBy("source").agg(F.count(F.lit(1)).alias("ingested"))
    tot = feed.groupBy("source").agg(F.count(F.lit(1)).alias("total"))
    return tot.join(new, "source", "left").select("source", "total", F.coalesce("ingested", F.lit(0)).alias("ingested"))


@query("verify_spans", oracle="""
WITH s AS (SELECT o_orderkey AS doc_id, o_orderpriority, printf('Order %d for customer %d. Total price: $%s. Priority is %s.', o_orderkey, o_custkey,
                format('{:,.2f}', o_totalprice), o_orderpriority) AS text, format('{:,.2f}', o_totalprice) AS amt FROM orders),
  f AS (SELECT doc_id, text, CASE WHEN o_orderpriority = '1-URGENT' THEN 'Total price: $0.00' ELSE 'Total price: $' || amt END AS span FROM s)
SELECT doc_id, 'total price' AS name, CAST(replace(regexp_extract(span, '\\$([0-9,.]+)', 1), ',', '') AS DOUBLE) AS value, span
FROM f WHERE contains(text, span)""")
def verify_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted fields keep only spans found verbatim in their document; the
    value is re-read from the span. Urgent orders carry a tampered span."""
    t = Tables(spark, sf_dir)
    st = order_statements(t)
    facts = FX.extract_facts(st).where(F.col("label") == "total price")
    urgent = t.orders.select(F.col("o_orderkey").alias("entity_id"), (F.col("o_orderpriority") == "1-URGENT").alias("u"))
    fields = facts.join(urgent, "entity_id").select(
        F.col("entity_id").alias("doc_id"), F.col("label").alias("name"),
        F.when(F.col("u"), F.lit("Total price: $0.00")).otherwise(F.regexp_replace("raw_text", r"\.$", "")).alias("span"))
    v = fields.join(st, "doc_id").where(F.instr("text", F.col("span")) > 0)
    amount = T.parse_amount(F.regexp_extract("span", r"\$([0-9,.]+)", 1))
    return v.select("doc_id", "name", F.coalesce(amount, F.lit(0.0)).alias("value"), "span")


# ---------------------------------------------------------------------------
# Scalar functions over table values
# ---------------------------------------------------------------------------

@query("scalar_functions", oracle="""
SELECT c_custkey,
  regexp_replace(replace(lower(trim(c_name)), ' ', '_'), '[^a-z0-9_]', '_', 'g') AS clean_name,
  lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik,
  replace(printf('%010d-%02d-%06d', c_custkey, c_nationkey, c_custkey), '-', '') AS accession_path,
  round(CAST(replace(replace('$' || format('{:,.2f}', abs(c_acctbal)), '$', ''), ',', '') AS DOUBLE), 2) AS currency_value,
  round(c_nationkey / 100.0, 4) AS percent_value,
  round(CAST(round(abs(c_acctbal) / 1000, 1) AS DOUBLE) * 1000, 2) AS amount_k,
  '10.0.' || c_nationkey || '.1' AS client_ip,
  left(sha256(c_name), 16) AS qhash,
  coalesce(nullif(left(regexp_replace(replace(lower(trim(regexp_replace(regexp_extract('/uploads/' || c_name || '.csv', '([^/\\\\]+)$', 1), '\\.[^.]*$', ''))), ' ', '_'), '[^a-z0-9_]', '_', 'g'), 50), ''), 'uploaded_data') AS table_name
FROM customer""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Tables(spark, sf_dir).customer
    k = F.col("c_custkey")
    return c.select(
        "c_custkey", T.clean_column_name("c_name").alias("clean_name"),
        T.pad_cik(k).alias("cik"),
        T.accession_path(F.format_string("%010d-%02d-%06d", k, F.col("c_nationkey"), k)).alias("accession_path"),
        F.round(T.strip_currency(F.concat(F.lit("$"), F.format_number(F.abs("c_acctbal"), 2))), 2).alias("currency_value"),
        F.round(T.strip_percent(F.concat(F.col("c_nationkey").cast("string"), F.lit("%"))), 4).alias("percent_value"),
        F.round(T.parse_amount(F.concat(F.lit("$"), F.round(F.abs("c_acctbal") / 1000, 1).cast("string"), F.lit("k"))), 2)
        .alias("amount_k"),
        T.client_ip(F.concat(F.lit(" 10.0."), F.col("c_nationkey").cast("string"), F.lit(".1 , 1.2.3.4")), F.lit("peer"))
        .alias("client_ip"),
        T.question_hash("c_name").alias("qhash"),
        T.table_name_from_file(F.concat(F.lit("/uploads/"), F.col("c_name"), F.lit(".csv"))).alias("table_name"))
