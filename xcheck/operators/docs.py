"""Document operators: HTML to text, page rows, typing, persona suggestion and
routing, chunking, page metadata, content dedup.

Keyword rules are literal arrays inside the expressions (a few dozen fixed
words), so typing a document is a pure projection — no join, no shuffle.
"""

from __future__ import annotations

from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from ..functions import rules
from ..functions import text as T


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def keyword_hits(text: Column, keywords: list[str]) -> Column:
    """How many distinct keywords occur as substrings of ``text``."""
    return F.size(F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.instr(text, k) > 0))


@F.pandas_udf(StringType())
def _char_refs(texts: pd.Series) -> pd.Series:
    """Character references decoded; the full table is the standard library's."""
    return texts.map(unescape, na_action="ignore")


def html_to_text(html) -> Column:
    """Visible text of an HTML page: script/style content, comments, doctype,
    meta/link dropped; one stripped text node per line; named and numeric
    character references decoded; runs of 3+ newlines collapsed to 2. A tag
    ends at the first ``>`` outside its quoted attribute values."""
    h = _c(html)
    for tag in rules.HTML_DROP_TAGS:
        h = F.regexp_replace(h, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "\u0001")
    h = F.regexp_replace(h, r"(?s)<!--.*?-->", "\u0001")
    h = F.regexp_replace(h, rules.HTML_TAG, "\u0001")
    h = _char_refs(h)
    parts = F.filter(F.transform(F.split(h, "\u0001"), lambda p: T.strip_ws(p)), lambda p: p != "")
    return F.regexp_replace(F.array_join(parts, "\n"), r"\n{3,}", "\n\n")


def page_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              sep: str = "\f", min_chars: int = rules.PAGE_MIN_CHARS) -> DataFrame:
    """One row per page (1-based); pages whose stripped text is not longer than
    ``min_chars`` are dropped."""
    pages = docs.select(id_col, F.posexplode(F.split(text_col, sep)).alias("pos", "page_text"))
    return (pages.select(id_col, (F.col("pos") + 1).alias("page"), T.strip_ws("page_text").alias("page_text"))
            .where(F.length("page_text") > min_chars))


def chunk_doc_type(text) -> Column:
    """financial / legal / general from the first 500 characters."""
    sample = F.lower(F.substring(_c(text), 1, rules.CHUNK_TYPE_CHARS))
    return (F.when(keyword_hits(sample, rules.CHUNK_FINANCIAL_KEYWORDS) > 0, "financial")
            .when(keyword_hits(sample, rules.CHUNK_LEGAL_KEYWORDS) > 0, "legal")
            .otherwise("general"))


def token_count(text) -> Column:
    t = T.strip_ws(_c(text))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, r"\s+")))


def keyword_counts(low: Column, groups: list[list[str]]) -> Column:
    """Per keyword group, how many of its keywords occur in the (lower-cased)
    text: an unrolled sum of ``contains`` per group, 0 for a null text."""
    return F.array(*[sum((F.coalesce(low.contains(F.lit(k)).cast("int"), F.lit(0)) for k in kws), F.lit(0)) for kws in groups])


def doc_type_scores(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``_ntok``, ``_ndig`` and one keyword-hit column per type.

    The scores come out of a generator (``inline`` of a one-element array):
    each is evaluated once per row, and a later filter on a derived column
    cannot be pushed beneath it (it would otherwise be inlined, duplicated and
    pushed into the scan, ahead of the parallelism guard)."""
    # lower-cased and stripped text as columns first: inside the keyword lambdas
    # an expression would be re-evaluated for every keyword
    base = df.withColumn("_low", F.lower(F.col(text))).withColumn("_st", T.strip_ws(F.col("_low")))
    low = F.col("_low")
    toks = F.split(F.col("_st"), r"\s+")
    base = base.withColumn("_kc", keyword_counts(low, [kws for _, kws in rules.DOC_TYPE_KEYWORDS]))
    scores = F.struct(*[F.col("_kc")[i].alias(f"_s_{n}") for i, (n, _) in enumerate(rules.DOC_TYPE_KEYWORDS)],
                      F.when(F.col("_st") == "", F.lit(0)).otherwise(F.size(toks)).alias("_ntok"),
                      # whitespace-separated tokens holding a digit, from their first digit on:
                      # a match starts at a digit only, so no token is read again
                      F.size(F.regexp_extract_all(F.col("_st"), F.lit(r"[0-9]\S*+"), 0)).alias("_ndig"))
    return base.select("*", F.inline(F.array(scores))).drop("_low", "_st", "_kc")


def _pick_type() -> Column:
    best = F.greatest(*[F.struct(F.col(f"_s_{n}").alias("s"), F.lit(-i).alias("o"), F.lit(n).alias("n"))
                        for i, (n, _) in enumerate(rules.DOC_TYPE_KEYWORDS)])
    return (F.when(F.col("_ntok") < rules.DOC_TYPE_MIN_TOKENS, "general")
            .when(best["s"] >= rules.DOC_TYPE_MIN_HITS, best["n"]).otherwise("general"))


def with_doc_type(df: DataFrame, text: str = "text", out: str = "doc_type") -> DataFrame:
    """financial / legal / medical / research / general by keyword hits over
    the whole text (>= 50 tokens, best >= 3 hits, ties to the earlier type)."""
    s = doc_type_scores(df, text)
    return s.withColumn(out, _pick_type()).drop(*[c for c in s.columns if c.startswith("_s_") or c in ("_ntok", "_ndig")])


def with_extractable(df: DataFrame, text: str = "text", out: str = "extractable") -> DataFrame:
    """>= 50 tokens and (a non-general type, or >= 1.5 % of tokens holding a digit)."""
    s = doc_type_scores(df, text).withColumn("_t", _pick_type())
    ok = (F.col("_ntok") >= rules.DOC_TYPE_MIN_TOKENS) & (
        (F.col("_t") != "general") | (F.col("_ndig") / F.col("_ntok") >= rules.NUMERIC_DENSITY))
    return s.withColumn(out, ok).drop(*[c for c in s.columns if c.startswith("_s_") or c in ("_ntok", "_ndig")], "_t")


def doc_type(text) -> Column:
    """Column form of :func:`with_doc_type` for small inputs."""
    low = F.lower(_c(text))
    scores = [(name, keyword_hits(low, kws)) for name, kws in rules.DOC_TYPE_KEYWORDS]
    best = F.greatest(*[F.struct(s.alias("s"), F.lit(-i).alias("o"), F.lit(n).alias("n"))
                        for i, (n, s) in enumerate(scores)])
    return (F.when(_c(text).isNull() | (token_count(text) < rules.DOC_TYPE_MIN_TOKENS), "general")
            .when(best["s"] >= rules.DOC_TYPE_MIN_HITS, best["n"]).otherwise("general"))


def is_extractable(text) -> Column:
    """Column form of :func:`with_extractable` for small inputs."""
    toks = F.split(T.strip_ws(F.lower(_c(text))), r"\s+")
    n = token_count(text)
    digits = F.size(F.filter(toks, lambda t: t.rlike("[0-9]")))
    return (F.coalesce(n, F.lit(0)) >= rules.DOC_TYPE_MIN_TOKENS) & (
        (doc_type(text) != "general") | (digits / n >= rules.NUMERIC_DENSITY))


def route_question(question) -> DataFrame | Column:
    """Persona for a question: primary hit 2 points, secondary 1; best needs
    >= 2 points; ties -> more primary hits, then rule order."""
    q = F.lower(_c(question))
    cands = []
    for i, (name, prim, sec) in enumerate(rules.ROUTING_KEYWORDS):
        p, s = keyword_hits(q, [k.lower() for k in prim]), keyword_hits(q, [k.lower() for k in sec])
        score = p * rules.ROUTE_PRIMARY_WEIGHT + s * rules.ROUTE_SECONDARY_WEIGHT
        cands.append(F.struct(score.alias("score"), p.alias("primary_hits"), F.lit(-i).alias("o"),
                              s.alias("secondary_hits"), F.lit(name).alias("persona")))
    best = F.greatest(*cands)
    routed = best["score"] >= rules.ROUTE_MIN_SCORE
    return F.struct(F.when(routed, best["persona"]).otherwise(rules.ROUTE_FALLBACK).alias("persona"),
                    F.when(routed, best["score"]).otherwise(0).alias("score"),
                    F.when(routed, best["primary_hits"]).otherwise(0).alias("primary_hits"),
                    F.when(routed, best["secondary_hits"]).otherwise(0).alias("secondary_hits"),
                    routed.alias("was_routed"))


def suggest_persona(files: DataFrame, session_col: str, name_col: str, text_col: str,
                    order_col: str) -> DataFrame:
    """Persona per upload session from file names + the first 5000 characters
    of its first 6 pages. Keyword presence is OR-ed over files with one
    aggregation, so a session's files never gather in one place; only the
    bounded 6-page sample is concatenated."""
    kws = [(p, k) for p, ks in rules.UPLOAD_PERSONA_KEYWORDS for k in ks]
    kw_arr = F.array(*[F.lit(k) for _, k in kws])
    name_hits = files.select(session_col, F.transform(
        kw_arr, lambda k: F.instr(F.lower(F.col(name_col)), k) > 0).alias("h"))
    first = F.row_number().over(Window.partitionBy(session_col).orderBy(order_col))
    sample = (files.withColumn("_rk", first).where(F.col("_rk") <= rules.PERSONA_SAMPLE_PAGES)
              .groupBy(session_col)
              .agg(F.array_sort(F.collect_list(F.struct("_rk", text_col))).alias("_p"))
              .select(session_col, F.lower(F.substring(F.array_join(F.transform("_p", lambda x: x[text_col]), " "),
                                                       1, rules.PERSONA_SAMPLE_CHARS)).alias("_s")))
    sample_hits = sample.select(session_col, F.transform(kw_arr, lambda k: F.instr(F.col("_s"), k) > 0).alias("h"))
    allh = name_hits.unionByName(sample_hits)
    n = len(kws)
    agg = allh.groupBy(session_col).agg(*[F.max(F.col("h")[i]).alias(f"k{i}") for i in range(n)])
    cands, i0 = [], 0
    for j, (persona, ks) in enumerate(rules.UPLOAD_PERSONA_KEYWORDS):
        cnt = sum((F.col(f"k{i}").cast("int") for i in range(i0, i0 + len(ks))), F.lit(0))
        i0 += len(ks)
        cands.append(F.struct(F.when(cnt >= rules.PERSONA_MIN_HITS, cnt).otherwise(0).alias("c"),
                              F.lit(-j).alias("o"), F.lit(persona).alias("p")))
    best = F.greatest(*cands)
    return agg.select(session_col, F.when(best["c"] > 0, best["p"]).otherwise("Generalist").alias("persona"),
                      best["c"].alias("hits"))


def chunk_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  size: int = rules.CHUNK_SIZE, overlap: int = rules.CHUNK_OVERLAP) -> DataFrame:
    """Fixed character windows of ``size`` with ``overlap``: chunk i covers
    [i*(size-overlap), i*(size-overlap)+size). Whole texts, one row per chunk."""
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.length(text_col) - overlap) / step)).cast("int")
    return (docs.select(id_col, text_col, F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_ix"))
            .select(id_col, "chunk_ix",
                    F.substring(F.col(text_col), F.col("chunk_ix") * step + 1, F.lit(size)).alias("chunk")))


def joined_text(pages: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The document text chunking sees: kept pages joined by a space."""
    return (pages.groupBy(id_col)
            .agg(F.array_sort(F.collect_list(F.struct("page", "page_text"))).alias("_p"))
            .select(id_col, F.array_join(F.transform("_p", lambda x: x["page_text"]), " ").alias("text")))


HEAD = 40               # characters of a chunk that are looked for in the pages
GRAM = 8                # characters of a fingerprint


def _marks(text: str, every: bool) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, place) of the last smallest gram hash of each window of
    ``HEAD`` characters (all windows, or the first): a text that holds another's
    first ``HEAD`` characters has that one's mark."""
    c = np.frombuffer((text if every else text[:HEAD]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(c) - GRAM + 1
    h = np.zeros(n, np.uint64)
    for k in range(GRAM):
        h = (h + c[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    windows = HEAD - GRAM + 1
    places = []
    for lo in range(0, n - windows + 1, 1 << 16):       # a long page piece by piece
        view = np.lib.stride_tricks.sliding_window_view(h[lo:lo + (1 << 16) + windows - 1], windows)
        places.append(lo + np.arange(len(view)) + windows - 1 - view[:, ::-1].argmin(axis=1))
    at = np.unique(np.concatenate(places))
    return h[at].view(np.int64), at


def _marked(rows: DataFrame, id_col: str, number: str, text: str, every: bool) -> DataFrame:
    """(id, number, mark, at) of texts with at least ``HEAD`` characters."""
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            found = [_marks(t, every) for t in pdf["t"]]
            size = [len(x) for x, _ in found]
            yield pd.DataFrame({"id": pdf["id"].repeat(size), "n": pdf["n"].repeat(size), "mark": np.concatenate([x for x, _ in found]) if found else [],
                                "at": np.concatenate([x for _, x in found]) if found else []})

    long = rows.where(F.length(text) >= HEAD).select(F.col(id_col).alias("id"), F.col(number).cast("long").alias("n"), F.col(text).alias("t"))
    return long.mapInPandas(run, f"id {kind}, n long, mark long, at long")


def attach_page_meta(chunks: DataFrame, pages: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Page of each chunk: the page whose 80-char prefix equals the chunk's
    (the last such page); else the first page that holds the chunk's first 40
    characters; else the document's first page.

    Heads meet pages on a fingerprint: of every window of 40 characters a page
    keeps the smallest gram hash (some 6 % of its places), a head has one; who
    meets is then compared letter by letter. Chunks under 40 characters (a document's last) are
    looked for in its pages directly. No document is gathered in one row."""
    exact = (pages.select(id_col, F.substring("page_text", 1, 80).alias("_k"), "page")
             .groupBy(id_col, "_k").agg(F.max("page").alias("p_exact")))
    first = pages.groupBy(id_col).agg(F.min("page").alias("p_first"))
    heads = chunks.select(id_col, "chunk_ix", F.substring("chunk", 1, 80).alias("_k")).withColumn("_h", F.substring("_k", 1, HEAD))
    theirs = _marked(pages, id_col, "page", "page_text", True)
    ours = _marked(heads, id_col, "chunk_ix", "_h", False)
    met = (ours.alias("o").join(theirs.alias("t"), (F.col("o.id") == F.col("t.id")) & (F.col("o.mark") == F.col("t.mark")))
           .select(F.col("o.id").alias(id_col), F.col("o.n").alias("chunk_ix"), F.col("t.n").alias("page"), (F.col("t.at") - F.col("o.at")).alias("_from")).distinct())
    held = (met.join(heads.select(id_col, F.col("chunk_ix").cast("long").alias("chunk_ix"), "_h"), [id_col, "chunk_ix"])
            .join(pages.select(id_col, F.col("page").cast("long").alias("page"), "page_text"), [id_col, "page"])
            .where((F.col("_from") >= 0) & (F.substring(F.col("page_text"), F.col("_from").cast("int") + 1, F.lit(HEAD)) == F.col("_h"))))
    short = (heads.where(F.length("_h") < HEAD).join(pages.select(id_col, "page", "page_text"), id_col).where(F.col("page_text").contains(F.col("_h"))))
    inside = (held.select(id_col, "chunk_ix", "page").unionByName(short.select(id_col, F.col("chunk_ix").cast("long").alias("chunk_ix"), F.col("page").cast("long").alias("page")))
              .groupBy(id_col, "chunk_ix").agg(F.min("page").cast("int").alias("p_in")))
    return (heads.join(first, id_col, "left").join(exact, [id_col, "_k"], "left").join(inside, [id_col, "chunk_ix"], "left")
            .select(id_col, "chunk_ix", F.coalesce("p_exact", "p_in", "p_first").alias("page")))


def new_filings(feed: DataFrame, cache: DataFrame, key: str, text_col: str = "text",
                min_chars: int = 100) -> DataFrame:
    """Filings not yet in the cache (anti join on the key) whose stripped text
    has at least ``min_chars`` characters, with their SHA-256."""
    return (feed.join(cache.select(key), key, "left_anti")
            .where(F.length(T.strip_ws(text_col)) >= min_chars)
            .withColumn("text_hash", T.text_hash(text_col)))
