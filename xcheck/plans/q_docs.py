"""Document queries over ``documents``, ``pages`` and ``conversations``."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from ..operators import chunking
from ..operators import docs as DO
from ..session import Tables
from .registry import query


def _sql_hits(x: str, kws: list[str]) -> str:
    arr = "[" + ", ".join("'" + k.replace("'", "''") + "'" for k in kws) + "]"
    return f"len(list_filter({arr}, lambda k: contains({x}, k)))"


_SQL_STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _sql_strip(x: str) -> str:
    return _SQL_STRIP.format(x=x)


# ---------------------------------------------------------------------------
# HTML and pages
# ---------------------------------------------------------------------------

def _sql_html(x: str) -> str:
    h = x
    for tag in rules.HTML_DROP_TAGS:
        h = f"regexp_replace({h}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', chr(1), 'g')"
    h = f"regexp_replace({h}, '(?s)<!--.*?-->', chr(1), 'g')"
    tag = rules.HTML_TAG.replace("++", "+").replace("*+", "*").replace("'", "''")   # RE2 never backtracks
    h = f"regexp_replace({h}, '{tag}', chr(1), 'g')"
    refs = {n: c for n, c in name2codepoint.items() if n != "amp"} | {"apos": 39, "#39": 39}
    for name, code in [*refs.items(), ("amp", 38)]:       # HTML 4 names; &amp; last
        h = f"replace({h}, '&{name};', chr({code}))"
    parts = f"list_filter(list_transform(string_split({h}, chr(1)), lambda p: {_sql_strip('p')}), lambda p: p <> '')"
    return f"regexp_replace(array_to_string({parts}, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g')"


@query("read_html_pages", oracle=f"SELECT page_id, {_sql_html('html')} AS text FROM pages")
def read_html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).pages.select("page_id", DO.html_to_text("html").alias("text"))


@query("read_pages_text", oracle=f"""
SELECT doc_id, page, page_text FROM (
  SELECT doc_id, generate_subscripts(string_split(text, chr(12)), 1) AS page,
         {_sql_strip('unnest(string_split(text, chr(12)))')} AS page_text FROM documents)
WHERE length(page_text) > 50""")
def read_pages_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DO.page_rows(Tables(spark, sf_dir).documents)


# ---------------------------------------------------------------------------
# Typing and routing
# ---------------------------------------------------------------------------

_SQL_CHUNK_TYPE = (f"CASE WHEN {_sql_hits('lower(left(text, 500))', rules.CHUNK_FINANCIAL_KEYWORDS)} > 0 THEN 'financial' "
                   f"WHEN {_sql_hits('lower(left(text, 500))', rules.CHUNK_LEGAL_KEYWORDS)} > 0 THEN 'legal' "
                   "ELSE 'general' END")


@query("doc_type_chunking", oracle=f"SELECT doc_id, {_SQL_CHUNK_TYPE} AS chunk_type FROM documents")
def doc_type_chunking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).documents.select("doc_id", DO.chunk_doc_type("text").alias("chunk_type"))


def _sql_doc_type() -> str:
    scores = ", ".join(f"{_sql_hits('lower(text)', kws)} AS s_{n}" for n, kws in rules.DOC_TYPE_KEYWORDS)
    names = [n for n, _ in rules.DOC_TYPE_KEYWORDS]
    best = "greatest(" + ", ".join(f"s_{n}" for n in names) + ")"
    pick = "CASE " + " ".join(f"WHEN s_{n} = {best} THEN '{n}'" for n in names) + " END"
    ntok = f"CASE WHEN {_sql_strip('text')} = '' THEN 0 ELSE len(regexp_split_to_array({_sql_strip('text')}, '\\s+')) END"
    ndig = (f"len(list_filter(regexp_split_to_array({_sql_strip('lower(text)')}, '\\s+'), "
            "lambda t: regexp_matches(t, '[0-9]')))")
    return f"""
WITH s AS (SELECT doc_id, text, {scores}, {ntok} AS ntok, {ndig} AS ndig FROM documents),
  t AS (SELECT doc_id, ntok, ndig, CASE WHEN ntok < 50 THEN 'general' WHEN {best} >= 3 THEN {pick} ELSE 'general' END AS doc_type FROM s)"""


@query("doc_type", oracle=_sql_doc_type() + " SELECT doc_id, doc_type FROM t")
def doc_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DO.with_doc_type(Tables(spark, sf_dir).documents.select("doc_id", "text")).select("doc_id", "doc_type")


@query("is_extractable", oracle=_sql_doc_type() + """
SELECT doc_id, (ntok >= 50 AND (doc_type <> 'general' OR ndig / ntok >= 0.015)) AS extractable FROM t""")
def is_extractable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DO.with_extractable(Tables(spark, sf_dir).documents.select("doc_id", "text")).select("doc_id", "extractable")


def _sql_route() -> str:
    cands = []
    for i, (name, prim, sec) in enumerate(rules.ROUTING_KEYWORDS):
        p = _sql_hits("lower(text)", [k.lower() for k in prim])
        s = _sql_hits("lower(text)", [k.lower() for k in sec])
        cands.append(f"SELECT conv_id, turn, '{name}' AS persona, {i} AS o, {p} AS ph, {s} AS sh, "
                     f"{p} * 2 + {s} AS score FROM conversations WHERE role = 'user'")
    u = " UNION ALL ".join(cands)
    return f"""
WITH c AS ({u}),
  b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, ph DESC, o) AS rk FROM c) WHERE rk = 1)
SELECT conv_id, turn, CASE WHEN score >= 2 THEN persona ELSE 'Generalist' END AS persona,
       CASE WHEN score >= 2 THEN score ELSE 0 END AS score,
       CASE WHEN score >= 2 THEN ph ELSE 0 END AS primary_hits FROM b"""


@query("route_question", oracle=_sql_route())
def route_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Tables(spark, sf_dir).conversations.where(F.col("role") == "user")
    r = DO.route_question("text")
    return c.select("conv_id", "turn", r["persona"].alias("persona"), r["score"].alias("score"),
                    r["primary_hits"].alias("primary_hits"))



def _sql_persona() -> str:
    parts = []
    for j, (p, ks) in enumerate(rules.UPLOAD_PERSONA_KEYWORDS):
        hits = " + ".join(f"CAST(bool_or(contains(x, '{k}')) AS INT)" for k in ks)
        parts.append(f"SELECT source, {j} AS o, '{p}' AS persona, {hits} AS c FROM u GROUP BY source")
    union = " UNION ALL ".join(parts)
    return f"""
WITH r AS (SELECT source, doc_id, lang, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rk FROM documents),
  smp AS (SELECT source, lower(left(string_agg(text, ' ' ORDER BY rk), 5000)) AS x FROM r WHERE rk <= 6 GROUP BY source),
  u AS (SELECT source, lower('doc_' || doc_id || '_' || lang || '.txt') AS x FROM documents UNION ALL SELECT source, x FROM smp),
  sc AS ({union}),
  b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN c >= 2 THEN c ELSE 0 END DESC, o) AS k FROM sc)
SELECT source, CASE WHEN c >= 2 THEN persona ELSE 'Generalist' END AS persona, CASE WHEN c >= 2 THEN c ELSE 0 END AS hits
FROM b WHERE k = 1"""


@query("suggest_persona", oracle=_sql_persona())
def suggest_persona(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upload session = ``source``; file name ``doc_<id>_<lang>.txt``; pages in
    ``doc_id`` order."""
    d = Tables(spark, sf_dir).documents.withColumn(
        "file_name", F.concat(F.lit("doc_"), F.col("doc_id"), F.lit("_"), F.col("lang"), F.lit(".txt")))
    return DO.suggest_persona(d, "source", "file_name", "text", "doc_id")


# ---------------------------------------------------------------------------
# Chunks and page metadata
# ---------------------------------------------------------------------------

_SQL_WINDOWS = """
SELECT doc_id, chunk_ix, md5(substr(text, chunk_ix * 800 + 1, 1000)) AS chunk_md5,
       length(substr(text, chunk_ix * 800 + 1, 1000)) AS chunk_len
FROM (SELECT doc_id, text, unnest(range(0, greatest(1, ceil((length(text) - 200) / 800))::BIGINT)) AS chunk_ix FROM {src})"""


@query("chunk_windows", oracle=_SQL_WINDOWS.format(src="documents"))
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed windows of 1000 characters, 200 of them shared, over whole documents."""
    c = DO.chunk_windows(Tables(spark, sf_dir).documents)
    return c.select("doc_id", "chunk_ix", F.md5("chunk").alias("chunk_md5"), F.length("chunk").alias("chunk_len"))


def _line_pages(t: Tables) -> DataFrame:
    """Pages of a document = its lines (kept when longer than 50 characters)."""
    return DO.page_rows(t.documents, sep="\n")


_SQL_LINE_PAGES = f"""
  lp AS (SELECT doc_id, page, page_text FROM (
           SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS page,
                  {_sql_strip('unnest(string_split(text, chr(10)))')} AS page_text FROM documents)
         WHERE length(page_text) > 50),
  jt AS (SELECT doc_id, string_agg(page_text, ' ' ORDER BY page) AS text FROM lp GROUP BY doc_id)"""


@query("attach_page_meta", oracle=f"""
WITH {_SQL_LINE_PAGES},
  ch AS (SELECT doc_id, chunk_ix, substr(text, chunk_ix * 800 + 1, 1000) AS chunk
         FROM (SELECT doc_id, text, unnest(range(0, greatest(1, ceil((length(text) - 200) / 800))::BIGINT)) AS chunk_ix FROM jt)),
  ex AS (SELECT doc_id, left(page_text, 80) AS k, max(page) AS p_exact FROM lp GROUP BY ALL),
  pat AS (SELECT ch.doc_id, ch.chunk_ix, min(lp.page) AS p_at FROM ch JOIN lp ON ch.doc_id = lp.doc_id
         WHERE contains(lp.page_text, left(ch.chunk, 40)) GROUP BY ALL),
  fp AS (SELECT doc_id, min(page) AS p_first FROM lp GROUP BY doc_id)
SELECT ch.doc_id, ch.chunk_ix, coalesce(ex.p_exact, pat.p_at, fp.p_first) AS page
FROM ch LEFT JOIN ex ON ch.doc_id = ex.doc_id AND left(ch.chunk, 80) = ex.k
LEFT JOIN pat ON ch.doc_id = pat.doc_id AND ch.chunk_ix = pat.chunk_ix
LEFT JOIN fp ON ch.doc_id = fp.doc_id""")
def attach_page_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _line_pages(Tables(spark, sf_dir))
    chunks = DO.chunk_windows(DO.joined_text(pages))
    return DO.attach_page_meta(chunks, pages)


# ---------------------------------------------------------------------------
# Ingest dedup and hashes
# ---------------------------------------------------------------------------

@query("ingest_dedup_cache", oracle=f"""
SELECT d.doc_id, source || '-' || d.doc_id AS accession, sha256(text) AS text_hash FROM documents d
WHERE d.doc_id NOT IN (SELECT doc_id FROM labels) AND length({_sql_strip('text')}) >= 100""")
def ingest_dedup_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed = every document (accession ``source-doc_id``); cache = documents
    already labelled (ingested before)."""
    t = Tables(spark, sf_dir)
    feed = t.documents.withColumn("accession", F.concat("source", F.lit("-"), "doc_id"))
    cache = t.labels.join(feed.select("doc_id", "accession"), "doc_id")
    out = DO.new_filings(feed, cache, "accession")
    return out.select("doc_id", "accession", "text_hash")


@query("text_hash", oracle="""
SELECT sha256(text) AS text_hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents
GROUP BY 1 HAVING count(*) > 1""")
def text_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicate documents by SHA-256 of the whole text."""
    d = Tables(spark, sf_dir).documents.select("doc_id", T.text_hash("text").alias("text_hash"))
    return (d.groupBy("text_hash").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc"))
            .where(F.col("copies") > 1))


@query("question_hash", oracle="SELECT conv_id, turn, left(sha256(text), 16) AS qhash FROM conversations WHERE role = 'user'")
def question_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Tables(spark, sf_dir).conversations.where(F.col("role") == "user")
    return c.select("conv_id", "turn", T.question_hash("text").alias("qhash"))


def _sql_cut(sep: str) -> str:
    n = len(sep)
    at = f"instr(reverse(substr(text, s + 1, 1000)), {' || '.join(f'chr({ord(c)})' for c in reversed(sep))})"
    return f"CASE WHEN {at} > 0 AND 1001 - {at} - {n} >= 500 THEN 1001 - {at} END"


_SQL_END = f"""CASE WHEN length(text) - s <= 1000 THEN length(text)
  ELSE s + coalesce({", ".join(_sql_cut(p) for p in rules.CHUNK_SEPARATORS)}, 1000) END"""


@query("chunk_recursive", oracle=f"""
WITH RECURSIVE c AS (
  SELECT doc_id, text, s, {_SQL_END} AS e FROM (SELECT doc_id, text, CAST(0 AS BIGINT) AS s FROM documents)
  UNION ALL
  SELECT doc_id, text, s, {_SQL_END} AS e FROM (
    SELECT doc_id, text, e - 200 + instr(replace(substr(text, e - 199, 200), chr(10), ' '), ' ') AS s
    FROM c WHERE e < length(text))),
  k AS (SELECT doc_id, s, {_sql_strip('substr(text, s + 1, e - s)')} AS chunk FROM c)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS chunk_ix, length(chunk) AS chunk_len,
       md5(chunk) AS chunk_md5 FROM k WHERE chunk <> ''""")
def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks at the coarsest separator (1000 / 200) of whole documents."""
    c = chunking.chunk_recursive(Tables(spark, sf_dir).documents)
    return c.select("doc_id", "chunk_ix", F.length("chunk").alias("chunk_len"), F.md5("chunk").alias("chunk_md5"))
