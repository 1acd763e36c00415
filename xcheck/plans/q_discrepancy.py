"""Discrepancy queries over the driver tables.

The tables hold no labelled facts in prose, so the document side is text that
Spark derives from ``orders`` (one statement per order, quoting the stated
total); the table side is the line aggregate from ``lineitem``. Both grow with
the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import discrepancy as D
from ..operators import facts as FX
from ..session import Tables
from .registry import query

# ---------------------------------------------------------------------------
# Inputs derived from the tables
# ---------------------------------------------------------------------------


def order_statements(t: Tables) -> DataFrame:
    """One short statement per order: ``doc_id = o_orderkey``."""
    o = t.orders
    text = F.format_string("Order %d for customer %d. Total price: $%,.2f. Priority is %s.",
                           "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    return o.select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))


def line_rollup(t: Tables) -> DataFrame:
    """Per order: computed total, line count and quantity (money rounded to cents)."""
    return (t.lineitem.groupBy("l_orderkey")
            .agg(F.round(F.sum("l_extendedprice"), 2).alias("total_price"),
                 F.count(F.lit(1)).alias("items"),
                 F.round(F.sum("l_quantity"), 2).alias("quantity")))


_SQL_STATEMENTS = """
  SELECT o_orderkey AS doc_id,
         printf('Order %d for customer %d. Total price: $%s. Priority is %s.', o_orderkey, o_custkey,
                format('{:,.2f}', o_totalprice), o_orderpriority) AS text
  FROM orders"""

_SQL_ROLLUP = """
  SELECT l_orderkey, round(sum(l_extendedprice), 2) AS total_price, count(*) AS items,
         round(sum(l_quantity), 2) AS quantity
  FROM lineitem GROUP BY l_orderkey"""

# SQL pieces shared by the oracles (DuckDB dialect).
_SQL_NORM = ("array_to_string(list_transform(list_filter(string_split_regex(trim(regexp_replace(lower({x}), "
             "'[^a-z0-9 ]', ' ', 'g')), ' +'), lambda w: w <> ''), lambda w: CASE w "
             "WHEN 'revenues' THEN 'revenue' WHEN 'sales' THEN 'revenue' WHEN 'turnover' THEN 'revenue' "
             "WHEN 'earnings' THEN 'income' WHEN 'profit' THEN 'income' WHEN 'profits' THEN 'income' "
             "WHEN 'losses' THEN 'loss' WHEN 'expenditure' THEN 'expense' WHEN 'expenditures' THEN 'expenses' "
             "WHEN 'costs' THEN 'cost' WHEN 'headcount' THEN 'employees' WHEN 'workforce' THEN 'employees' "
             "WHEN 'staff' THEN 'employees' ELSE w END), ' ')")
_SQL_STOPS = ("['the','a','an','of','in','for','and','or','to','by','with','at','from','per','as','is',"
              "'are','was','were','total','net','gross']")


def sql_norm(x: str) -> str:
    return _SQL_NORM.format(x=x)


def sql_tokens(x: str) -> str:
    return f"list_distinct(list_filter(string_split({x}, ' '), lambda w: NOT list_contains({_SQL_STOPS}, w) AND w <> ''))"


# ---------------------------------------------------------------------------
# stated_vs_computed — the flagship
# ---------------------------------------------------------------------------

def stated_vs_computed_df(t: Tables) -> DataFrame:
    stated = t.orders.select(F.col("o_orderkey").alias("entity_id"), "o_totalprice")
    computed = line_rollup(t).select(F.col("l_orderkey").alias("entity_id"), "total_price")
    out = D.reconcile(stated, computed, ["entity_id"], "o_totalprice", "total_price", "order total")
    return out.select("entity_id", "label", F.round("doc_value", 2).alias("doc_value"),
                      F.round("db_value", 2).alias("db_value"), F.round("delta", 2).alias("delta"),
                      F.round("pct", 4).alias("pct"))


_SQL_ALIGN = """
  a AS (SELECT *, CASE WHEN doc_value > 0 AND db_value > 0
                       THEN round_even(ln(greatest(doc_value, db_value) / least(doc_value, db_value)) / ln(1000), 0)
                       ELSE 0 END AS kk FROM p),
  s AS (SELECT *, CASE WHEN kk >= 1 AND doc_value < db_value THEN doc_value * pow(1000, kk) ELSE doc_value END AS doc_a,
                  CASE WHEN kk >= 1 AND doc_value >= db_value THEN db_value * pow(1000, kk) ELSE db_value END AS db_a
        FROM a),
  f AS (SELECT *, db_a - doc_a AS delta_raw,
               CASE WHEN doc_a <> 0 THEN (db_a - doc_a) / doc_a * 100 END AS pct_raw,
               CASE WHEN doc_a <> 0 THEN abs((db_a - doc_a) / doc_a) ELSE abs(db_a - doc_a) END AS rel
        FROM s)"""


@query("stated_vs_computed", oracle=f"""
WITH c AS ({_SQL_ROLLUP}),
  p AS (SELECT o_orderkey AS entity_id, o_totalprice AS doc_value, total_price AS db_value
        FROM orders JOIN c ON o_orderkey = l_orderkey),
{_SQL_ALIGN}
SELECT entity_id, 'order total' AS label, round(doc_a, 2) AS doc_value, round(db_a, 2) AS db_value,
       round(delta_raw, 2) AS delta, round(pct_raw, 4) AS pct
FROM f WHERE rel >= 0.01 AND rel <= 0.25
""")
def stated_vs_computed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stated_vs_computed_df(Tables(spark, sf_dir))


# ---------------------------------------------------------------------------
# Facts from text and from tables
# ---------------------------------------------------------------------------

def _fact_texts(t: Tables) -> DataFrame:
    docs = t.documents.select(F.lit("documents").alias("corpus"), "doc_id", "text")
    stm = order_statements(t).select(F.lit("orders").alias("corpus"), "doc_id", "text")
    return docs.unionByName(stm)


def _facts_out(df: DataFrame) -> DataFrame:
    return df.select("entity_id", "ix", "label", F.round("value", 4).alias("value"), "raw_text")


_PAT = [
    r"([A-Za-z][A-Za-z0-9 _/\-]{1,60}?)\s*[:\-=]\s*([-–]?)\s*[\$£€¥]?\s*([0-9][0-9,]*(?:\.[0-9]+)?)\s*([KkMmBbTt](?:illion|n|)?)?",
    r"([A-Za-z][A-Za-z0-9 _/\-]{1,60}?)\s+(?:was|were|is|are|of|totaling?|equaling?|reached?|hit|at)\s+([-–]?)\s*[\$£€¥]?\s*([0-9][0-9,]*(?:\.[0-9]+)?)\s*([KkMmBbTt](?:illion|n|)?)?",
    r"([A-Za-z][A-Za-z0-9 _/\-]{1,40}?)\s*[:\-]?\s+([-–]?)\s*[\$£€¥]\s*([0-9][0-9,]*(?:\.[0-9]+)?)\s*([KkMmBbTt](?:illion|n|)?)?",
]


def _sql_group(g: int) -> str:
    parts = " ".join(f"WHEN {k} THEN regexp_extract(m, '^(?i){p}', {g})" for k, p in enumerate(_PAT))
    return f"(CASE p {parts} END)"


_SQL_FACTS_TEXT = f"""
  ms AS (
    SELECT corpus, doc_id, p, m, pos FROM (
      SELECT corpus, doc_id, 0 AS p, unnest(regexp_extract_all(text, '(?i){_PAT[0]}', 0)) AS m,
             unnest(generate_series(1, len(regexp_extract_all(text, '(?i){_PAT[0]}', 0)))) AS pos
      FROM texts WHERE regexp_matches(text, '[0-9]')
      UNION ALL
      SELECT corpus, doc_id, 1 AS p, unnest(regexp_extract_all(text, '(?i){_PAT[1]}', 0)),
             unnest(generate_series(1, len(regexp_extract_all(text, '(?i){_PAT[1]}', 0))))
      FROM texts WHERE regexp_matches(text, '[0-9]')
      UNION ALL
      SELECT corpus, doc_id, 2 AS p, unnest(regexp_extract_all(text, '(?i){_PAT[2]}', 0)),
             unnest(generate_series(1, len(regexp_extract_all(text, '(?i){_PAT[2]}', 0))))
      FROM texts WHERE regexp_matches(text, '[0-9]'))),
  gs AS (
    SELECT corpus, doc_id, p, pos, m, {sql_norm(_sql_group(1))} AS label, {_sql_group(2)} AS sgn,
           {_sql_group(3)} AS num, {_sql_group(4)} AS suf FROM ms),
  vs AS (
    SELECT corpus, doc_id, p, pos, label, regexp_replace(m, '^\\s+|\\s+$', '', 'g') AS raw_text,
           CAST(replace(num, ',', '') AS DOUBLE)
             * CASE upper(left(suf, 1)) WHEN 'K' THEN 1e3 WHEN 'M' THEN 1e6 WHEN 'B' THEN 1e9
                                        WHEN 'T' THEN 1e12 ELSE 1 END
             * CASE WHEN sgn IN ('-', '–') THEN -1 ELSE 1 END AS value
    FROM gs WHERE length(label) >= 3),
  ranked AS (
    SELECT *, row_number() OVER (PARTITION BY corpus, doc_id, label, round_even(value, 2) ORDER BY p, pos) AS rk
    FROM vs)"""


@query("extract_facts_text", oracle=f"""
WITH texts AS (SELECT 'documents' AS corpus, doc_id, text FROM documents UNION ALL {_SQL_STATEMENTS.replace('SELECT o_orderkey', "SELECT 'orders' AS corpus, o_orderkey")}),
{_SQL_FACTS_TEXT}
SELECT corpus, doc_id AS entity_id, label, round(value, 4) AS value, raw_text FROM ranked WHERE rk = 1
""")
def extract_facts_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    texts = _fact_texts(t).withColumn("_k", F.struct("corpus", "doc_id"))
    f = FX.extract_facts(texts, id_col="_k")
    return f.select(F.col("entity_id.corpus").alias("corpus"), F.col("entity_id.doc_id").alias("entity_id"),
                    "label", F.round("value", 4).alias("value"), "raw_text")


@query("extract_facts_rows", oracle=f"""
WITH r AS ({_SQL_ROLLUP}),
  u AS (SELECT l_orderkey AS entity_id, 0 AS ci, 'total_price' AS col, total_price AS value FROM r
        UNION ALL SELECT l_orderkey, 1, 'items', CAST(items AS DOUBLE) FROM r
        UNION ALL SELECT l_orderkey, 2, 'quantity', quantity FROM r)
SELECT entity_id, {sql_norm('col')} AS label, round(value, 4) AS value FROM u
""")
def extract_facts_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = FX.facts_from_table(line_rollup(Tables(spark, sf_dir)), "l_orderkey",
                            ["total_price", "items", "quantity"])
    return f.select("entity_id", "label", F.round("value", 4).alias("value"))


def _doc_and_db_facts(t: Tables):
    doc = FX.extract_facts(order_statements(t), "doc_id", "text")
    db = FX.facts_from_table(line_rollup(t), "l_orderkey", ["total_price", "items", "quantity"])
    return doc, db


_SQL_DETECT = f"""
WITH texts AS ({_SQL_STATEMENTS.replace('SELECT o_orderkey', "SELECT 'orders' AS corpus, o_orderkey")}),
{_SQL_FACTS_TEXT},
  docf AS (SELECT doc_id AS entity_id, label AS doc_label, value AS doc_value,
                  raw_text AS doc_raw, p * 1000000 + pos AS doc_ix
           FROM ranked WHERE rk = 1),
  r AS ({_SQL_ROLLUP}),
  u AS (SELECT l_orderkey AS entity_id, 0 AS ci, 'total_price' AS col, total_price AS value,
               'total_price: ' || CAST(total_price AS VARCHAR) AS raw FROM r
        UNION ALL SELECT l_orderkey, 1, 'items', CAST(items AS DOUBLE), 'items: ' || CAST(items AS VARCHAR) FROM r
        UNION ALL SELECT l_orderkey, 2, 'quantity', quantity, 'quantity: ' || CAST(quantity AS VARCHAR) FROM r),
  dbf AS (SELECT entity_id, ci AS db_ix, {sql_norm('col')} AS db_label, value AS db_value, raw AS db_raw FROM u),
  pairs AS (
    SELECT d.*, b.db_ix, b.db_label, b.db_value, b.db_raw,
           CASE WHEN len({sql_tokens('d.doc_label')}) = 0 OR len({sql_tokens('b.db_label')}) = 0 THEN 0.0
                ELSE len(list_intersect({sql_tokens('d.doc_label')}, {sql_tokens('b.db_label')}))::DOUBLE
                     / len(list_distinct(list_concat({sql_tokens('d.doc_label')}, {sql_tokens('b.db_label')}))) END AS sim
    FROM docf d JOIN dbf b USING (entity_id)),
  best AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, doc_ix ORDER BY sim DESC, db_ix DESC) AS bk
                   FROM pairs WHERE sim >= 0.55) WHERE bk = 1),
  p AS (SELECT entity_id, doc_ix, doc_label, db_label, doc_raw, db_raw, doc_value, db_value FROM best),
{_SQL_ALIGN}"""


@query("detect_discrepancies", oracle=_SQL_DETECT + """
SELECT entity_id, CASE WHEN length(doc_label) >= length(db_label) THEN doc_label ELSE db_label END AS label,
       round(doc_a, 2) AS doc_value, round(db_a, 2) AS db_value, round(delta_raw, 2) AS delta,
       round(pct_raw, 4) AS pct, left(doc_raw, 80) AS doc_snippet, left(db_raw, 80) AS db_snippet
FROM f WHERE rel >= 0.01 AND rel <= 0.25
""")
def detect_discrepancies(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc, db = _doc_and_db_facts(Tables(spark, sf_dir))
    out = D.detect_discrepancies(doc, db)
    return out.select("entity_id", "label", F.round("doc_value", 2).alias("doc_value"),
                      F.round("db_value", 2).alias("db_value"), F.round("delta", 2).alias("delta"),
                      F.round("pct", 4).alias("pct"), "doc_snippet", "db_snippet")


@query("label_match_join", oracle=_SQL_DETECT + """
SELECT entity_id, doc_label, db_label, round(sim, 6) AS sim FROM best
""")
def label_match_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc, db = _doc_and_db_facts(Tables(spark, sf_dir))
    b = D.best_matches(doc, db)
    return b.select("entity_id", "doc_label", "db_label", F.round("sim", 6).alias("sim"))


@query("checked_pairs", oracle=_SQL_DETECT + """
SELECT entity_id, count(*) AS checked_pairs FROM best GROUP BY entity_id
""")
def checked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc, db = _doc_and_db_facts(Tables(spark, sf_dir))
    return D.checked_pairs(doc, db)


@query("discrepancy_report", oracle=_SQL_DETECT + """
, items AS (
  SELECT entity_id, doc_ix,
         '  [DISCREPANCY] ' || CASE WHEN length(doc_label) >= length(db_label) THEN doc_label ELSE db_label END
         || ': Doc says ' || CASE WHEN doc_a = floor(doc_a) THEN format('{:,.0f}', doc_a) ELSE format('{:,.2f}', doc_a) END
         || ' [Source: ' || left(doc_raw, 80) || ']. DB shows '
         || CASE WHEN db_a = floor(db_a) THEN format('{:,.0f}', db_a) ELSE format('{:,.2f}', db_a) END
         || ' [DB: ' || left(db_raw, 80) || ']. Delta: ' || CASE WHEN delta_raw >= 0 THEN '+' ELSE '' END
         || CASE WHEN delta_raw = floor(delta_raw) THEN format('{:,.0f}', delta_raw) ELSE format('{:,.2f}', delta_raw) END
         || CASE WHEN pct_raw IS NOT NULL THEN ' (' || CASE WHEN delta_raw >= 0 THEN '+' ELSE '' END
                 || printf('%.1f', pct_raw) || '%)' ELSE '' END AS line
  FROM f WHERE rel >= 0.01 AND rel <= 0.25)
SELECT entity_id, 0 AS line_no, '\n\nPRE-COMPUTED DISCREPANCY ANALYSIS (use these exact numbers):' AS line
FROM (SELECT DISTINCT entity_id FROM items)
UNION ALL SELECT entity_id, 1 AS line_no, line FROM items
UNION ALL SELECT DISTINCT entity_id, 2 AS line_no,
  'Flag each of the above with [DISCREPANCY] in your answer. Do NOT invent additional discrepancies beyond those listed.' FROM items
""")
def discrepancy_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc, db = _doc_and_db_facts(Tables(spark, sf_dir))
    lines = D.report_lines(D.detect_discrepancies(doc, db))
    line_no = (F.when(F.col("line_key") == 0, 0).when(F.col("line_key") == 2 ** 62, 2).otherwise(1))
    return lines.select("entity_id", line_no.alias("line_no"), "line")
