"""PII queries over ``documents`` (whole texts) and ``conversations``."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pii as P
from ..session import Tables
from .registry import query

_SQL_EMAIL = "[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{2,}"


def _sql_mask_email(sql: str) -> str:
    m = f"regexp_extract_all({sql}, '{_SQL_EMAIL}')[i]"
    masked = f"CASE WHEN strpos({m}, '@') > 2 THEN left({m}, 1) ELSE '' END || '***' || substr({m}, strpos({m}, '@'))"
    return f"array_to_string(list_transform(regexp_split_to_array({sql}, '{_SQL_EMAIL}'), lambda x, i: x || coalesce({masked}, '')), '')"


_SQL_MASK_EMAIL = f"CASE WHEN contains(text, '@') THEN {_sql_mask_email('text')} ELSE text END"


@query("mask_email", oracle=f"""
SELECT doc_id, md5({_SQL_MASK_EMAIL}) AS masked_md5 FROM documents WHERE {_SQL_MASK_EMAIL} <> text""")
def mask_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Tables(spark, sf_dir).documents.select("doc_id", "text", P.mask_email("text").alias("m"))
    return d.where(F.col("m") != F.col("text")).select("doc_id", F.md5("m").alias("masked_md5"))


# The same passes for an engine without look-around: the characters beside a
# match are matched too and put back. Two neighbours may share such a character,
# so every pass runs twice. European numbers are marked first and cut out.
_B, _E, _S = "(^|[^0-9])", "([^0-9]|$)", "[\\s\\-.]?"
_SSN_1 = "(?:00[1-9]|0[1-9][0-9]|[1-578][0-9]{2}|6[0-57-9][0-9]|66[0-57-9])"
_SSN_2, _SSN_3 = "(?:0[1-9]|[1-9][0-9])", "(000[1-9]|00[1-9][0-9]|0[1-9][0-9]{2}|[1-9][0-9]{3})"
_SQL_PASSES = [
    (f"{_B}(?:4[0-9]{{3}}|5[1-5][0-9]{{2}}|3[47][0-9]{{2}}|6011|2131|1800|35[0-9]{{3}})[\\s\\-]?[0-9]{{4}}[\\s\\-]?"
     "(?:[0-9]{4}[\\s\\-]?([0-9]{4})|[0-9]{3}([0-9])[\\s\\-]?([0-9]{3})|[0-9]{2}([0-9]{2})[\\s\\-]?([0-9]{2})|[0-9]([0-9]{3})[\\s\\-]?([0-9]))" + _E,
     "\\1****-****-****-\\2\\3\\4\\5\\6\\7\\8\\9"),
    (f"{_B}{_SSN_1}(?:-{_SSN_2}[-\\s]|\\s{_SSN_2}-){_SSN_3}{_E}", "\\1***-**-\\2\\3"),
    (f"{_B}{_SSN_1}\\s{_SSN_2}\\s{_SSN_3}{_E}", "\\1*** ** \\2\\3"),
    (f"{_B}(?:\\+44{_S}7[0-9]{{3}}{_S}[0-9]{{2}}([0-9]{{4}})|07[0-9]{{3}}{_S}[0-9]{{2}}([0-9]{{4}})){_E}", "\\1***-***-\\2\\3\\4"),
    (f"{_B}\\+91[\\s\\-]?[0-9]{{5}}[\\s\\-]?[0-9]([0-9]{{4}}){_E}", "\\1***-***-\\2\\3"),
]
_SQL_EU = (f"{_B}(\\+(?:3[0-9]|4[0-35-9]){_S}[0-9][0-9\\s\\-.]{{7,11}}){_E}", "\\1\x01\\2\x02\\3")
_SQL_US = (f"{_B}(?:\\+?1{_S})?(?:\\(?[0-9]{{3}}\\)?{_S})[0-9]{{3}}{_S}([0-9]{{4}}){_E}", "\\1***-***-\\2\\3")


def _sql_pass(sql: str, pattern: str, put: str, times: int = 2) -> str:
    for _ in range(times):
        sql = f"regexp_replace({sql}, '{pattern}', '{put}', 'g')"
    return sql


def _sql_mask(col: str) -> str:
    """DuckDB expression of all passes but the last."""
    sql = col
    for pattern, put in _SQL_PASSES:
        sql = _sql_pass(sql, pattern, put)
    parts = f"string_split({_sql_pass(sql, *_SQL_EU)}, '\x01')"
    masked = "'***-***-' || right(regexp_replace(split_part(x, '\x02', 1), '[^0-9]', '', 'g'), 4) || substr(x, strpos(x, '\x02') + 1)"
    sql = f"array_to_string(list_transform({parts}, lambda x, i: CASE WHEN i = 1 THEN x ELSE {masked} END), '')"
    return _sql_pass(sql, *_SQL_US)


# numbers first, then emails in what that gives
SQL_MASKED = (f"(SELECT CASE WHEN contains(n, '@') THEN {_sql_mask_email('n')} ELSE n END "
              f"FROM (SELECT CASE WHEN regexp_matches(text, '[0-9]') THEN {_sql_mask('text')} ELSE text END AS n))")


@query("mask_pii", oracle=f"""WITH m AS (SELECT doc_id, text, {SQL_MASKED} AS masked FROM documents)
SELECT doc_id, masked FROM m WHERE masked <> text""")
def mask_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full ordered mask of whole document texts; rows that changed."""
    d = Tables(spark, sf_dir).documents.select("doc_id", "text")
    m = P.mask_pii(d.withColumn("masked", F.col("text")), ["masked"])
    return m.where(F.col("masked") != F.col("text")).select("doc_id", "masked")


def _sql_hits(kind: str) -> str:
    """DuckDB expression of a kind's number of matches in ``a``: each is replaced by a mark."""
    ends = {"phone": [_SQL_US], "ssn": _SQL_PASSES[1:3], "credit_card": _SQL_PASSES[:1]}
    if kind == "email":
        return f"len(regexp_extract_all(a, '{_SQL_EMAIL}'))"
    sql = "a"
    for pattern, _ in ends[kind]:
        last = re.compile(pattern).groups
        sql = _sql_pass(sql, pattern, f"\\1\x01\\{last}")
    return f"(length({sql}) - length(replace({sql}, '\x01', '')))"


@query("pii_summary", oracle="WITH t AS (SELECT text AS a FROM documents UNION ALL SELECT text FROM conversations) SELECT "
       + ", ".join(f"CAST(sum({_sql_hits(k)}) AS BIGINT) AS {k}" for k in ("email", "phone", "ssn", "credit_card")) + " FROM t")
def pii_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits per kind (email, US phone, SSN, card) before masking, over document
    texts and conversation turns."""
    t = Tables(spark, sf_dir)
    d = t.documents.select(F.col("text").alias("a"))
    c = t.conversations.select(F.col("text").alias("a"))
    return P.pii_summary(d.unionByName(c), ["a"])




@query("detect_pii", oracle=f"""
SELECT doc_id, len(regexp_extract_all(text, '{_SQL_EMAIL}')) AS email_hits FROM documents
WHERE len(regexp_extract_all(text, '{_SQL_EMAIL}')) > 0""")
def detect_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents holding email addresses, with their hit counts."""
    d = Tables(spark, sf_dir).documents
    n = P.pii_counts("text")["email"]
    return d.select("doc_id", n.alias("email_hits")).where(F.col("email_hits") > 0)
