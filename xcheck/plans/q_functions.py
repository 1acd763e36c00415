"""Queries that call the library's functions by their SQL names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.registered import register_all
from ..session import register_views
from .q_discrepancy import _SQL_ALIGN, sql_norm, sql_tokens
from .registry import ORACLES, query


def _sql(spark: SparkSession, sf_dir: str, text: str, tables: list[str]) -> DataFrame:
    register_views(spark, sf_dir, tables)
    register_all(spark)
    return spark.sql(text)


def _twin(name: str) -> str | None:
    """The SQL twin of the DataFrame form."""
    from . import q_discrepancy, q_docs, q_pii, q_sources  # noqa: F401
    return ORACLES.get(name)


@query("sql_mask_pii", oracle=_twin("mask_pii"))
def sql_mask_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, "SELECT doc_id, masked FROM (SELECT doc_id, text, mask_pii(text) AS masked FROM documents) WHERE masked <> text", ["documents"])


@query("sql_chunk_text", oracle=_twin("chunk_recursive"))
def sql_chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "SELECT doc_id, CAST(chunk_ix AS BIGINT) AS chunk_ix, CAST(length(chunk) AS BIGINT) AS chunk_len, md5(chunk) AS chunk_md5 FROM documents, LATERAL chunk_text(text)"
    return _sql(spark, sf_dir, text, ["documents"])


@query("sql_extract_facts", oracle=_twin("extract_facts_text"))
def sql_extract_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of the documents and of one statement per order."""
    text = """
SELECT corpus, doc_id AS entity_id, f.label, round(f.value, 4) AS value, f.raw_text FROM (
  SELECT corpus, doc_id, extract_facts(text) AS facts FROM (
    SELECT 'documents' AS corpus, doc_id, text FROM documents UNION ALL
    SELECT 'orders', o_orderkey, format_string('Order %d for customer %d. Total price: $%,.2f. Priority is %s.', o_orderkey, o_custkey, o_totalprice, o_orderpriority) FROM orders))
LATERAL VIEW explode(facts) e AS f"""
    return _sql(spark, sf_dir, text, ["documents", "orders"])


@query("sql_align_scale", oracle=f"""
WITH p AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS doc_value, o_totalprice * 1000 AS db_value
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey), {_SQL_ALIGN}
SELECT l_orderkey, l_linenumber, round(doc_a, 2) AS a, round(db_a, 2) AS b FROM f""")
def sql_align_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line prices against order totals in thousandths."""
    text = ("SELECT l_orderkey, l_linenumber, round(x.a, 2) AS a, round(x.b, 2) AS b FROM (SELECT l_orderkey, l_linenumber, "
            "align_scale(l_extendedprice, o_totalprice * 1000) AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey)")
    return _sql(spark, sf_dir, text, ["lineitem", "orders"])


@query("sql_cosine", oracle="""
SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def sql_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring vectors."""
    text = ("SELECT a.vec_id, round(cosine(CAST(a.embedding AS ARRAY<DOUBLE>), CAST(b.embedding AS ARRAY<DOUBLE>)), 6) AS cosine "
            "FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
    return _sql(spark, sf_dir, text, ["embeddings"])


_TOK_A, _TOK_B = (sql_tokens(sql_norm(x)) for x in ("p_name || ' ' || p_type", "lower(p_type) || ' costs of ' || p_brand"))


@query("sql_jaccard_labels", oracle=f"""
SELECT p_partkey, {sql_norm("p_name || ' ' || p_type")} AS label,
       round(CASE WHEN len({_TOK_A}) = 0 OR len({_TOK_B}) = 0 THEN 0.0
       ELSE len(list_intersect({_TOK_A}, {_TOK_B})) / len(list_distinct(list_concat({_TOK_A}, {_TOK_B}))) END, 6) AS jaccard FROM part""")
def sql_jaccard_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part labels against a label made of their type and brand."""
    text = ("SELECT p_partkey, normalize_label(p_name || ' ' || p_type) AS label, "
            "round(jaccard_labels(p_name || ' ' || p_type, lower(p_type) || ' costs of ' || p_brand), 6) AS jaccard FROM part")
    return _sql(spark, sf_dir, text, ["part"])


@query("sql_scalar_functions", oracle="""
SELECT c_custkey, regexp_replace(replace(lower(trim(c_name)), ' ', '_'), '[^a-z0-9_]', '_', 'g') AS clean_name,
  lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik, replace(printf('%010d-%02d', c_custkey, c_nationkey), '-', '') AS path,
  round(abs(c_acctbal), 2) AS currency_value, round(c_nationkey / 100.0, 4) AS percent_value,
  round(CAST(round(abs(c_acctbal) / 1000, 1) AS DOUBLE) * 1000, 2) AS amount_k, '10.0.' || c_nationkey || '.1' AS ip,
  left(sha256(c_name), 16) AS qhash, c_mktsegment AS segment, [c_acctbal, 1.0] AS vector, true AS number, false AS text_number, 'a b' AS squeezed
FROM customer""")
def sql_scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = """
SELECT c_custkey, clean_column_name(c_name) AS clean_name, pad_cik(CAST(c_custkey AS STRING)) AS cik,
  accession_path(format_string('%010d-%02d', c_custkey, c_nationkey)) AS path, round(strip_currency(concat('$', format_number(abs(c_acctbal), 2))), 2) AS currency_value,
  round(strip_percent(concat(c_nationkey, '%')), 4) AS percent_value, round(parse_amount(concat('$', round(abs(c_acctbal) / 1000, 1), 'k')), 2) AS amount_k,
  client_ip(concat(' 10.0.', c_nationkey, '.1 , 1.2.3.4'), 'peer') AS ip, question_hash(c_name) AS qhash,
  metadata_get(to_json(named_struct('segment', c_mktsegment)), 'type', 'segment') AS segment, vector_from_json(concat('[', c_acctbal, ', 1.0]')) AS vector,
  is_numeric_text(concat('$', c_acctbal)) AS number, is_numeric_text(c_name) AS text_number, squeeze_spaces('a   b') AS squeezed
FROM customer"""
    return _sql(spark, sf_dir, text, ["customer"])
