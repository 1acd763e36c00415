"""Question flags and routing ladders (pure column expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# FIXED VALUES — question flag patterns (case-insensitive, word-bounded)
NEEDS_MODEL = (r"(predict|forecast|trend|seasonalit|correlat|regress|cluster|anomal"
               r"|outli|model|classif|time.?series|arima|prophet|xgboost|machine.?learn)")
IS_FORECAST = r"(forecast|predict|projection|project(?:ed|ing)?|extrapolat|next\s+(?:quarter|year|month|period)|future)"
WANTS_PLOT = r"(plot|chart|graph|histogram|visuali[sz]e?|draw|heatmap|scatter|bar\s*chart|pie\s*chart)"

# FIXED VALUES — tool routing keyword lists (substring tests on the lower-cased step)
DATA_FETCH = ["fetch ", "retrieve ", "get ", "select ", "find ", "query ", "calculate ",
              "compute ", "count ", "sum ", "aggregate ", "identify "]
PYTHON_KEYWORDS = ["chart", "plot", "visuali", "correlat", "distribut", "python", "scatter", "heatmap",
                   "regression", "generate a ", "create a ", "draw ", "predict", "forecast", "model",
                   "seasonal", "trend", "time series", "anomal", "cluster"]
DOC_KEYWORDS = ["document", "report", "pdf", "file", "upload", "manual", "policy", "contract", "according to"]
VALID_INTENTS = ["sql", "doc", "hybrid"]


def _word(pattern: str) -> str:
    return rf"(?iU)\b{pattern}\b"


def question_flags(text) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.struct(t.rlike(_word(NEEDS_MODEL)).alias("needs_model"),
                    t.rlike(_word(IS_FORECAST)).alias("is_forecast"),
                    t.rlike(_word(WANTS_PLOT)).alias("wants_plot"))


def _any_contains(s: Column, kws: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(k) for k in kws]), lambda k: F.instr(s, k) > 0)


def route_tool(step, has_db, has_docs, has_csv) -> Column:
    """sql_query / doc_search / python_analysis / unsupported for a plan step."""
    s = F.lower(F.col(step) if isinstance(step, str) else step)
    db, docs, csv = (F.col(x) if isinstance(x, str) else x for x in (has_db, has_docs, has_csv))
    has_chart = _any_contains(s, PYTHON_KEYWORDS)
    has_fetch = F.exists(F.array(*[F.lit(k) for k in DATA_FETCH]),
                         lambda k: s.startswith(k) | (F.instr(s, F.concat(F.lit(" "), k)) > 0))
    has_doc = _any_contains(s, DOC_KEYWORDS)
    fetch_route = (F.when(db & ~csv, "sql_query").when(csv, "python_analysis").when(docs, "doc_search")
                   .otherwise("python_analysis"))
    return (F.when(~db & ~docs & ~csv, "unsupported")
            .when(csv & ~has_doc, "python_analysis")
            .when(has_chart & ~has_fetch, "python_analysis")
            .when(has_doc, "doc_search")
            .when(has_fetch | ~has_chart, fetch_route)
            .when(db & ~csv, "sql_query")
            .when(docs, "doc_search").otherwise("python_analysis"))


def route_source(has_db, has_docs, label) -> Column:
    """No database -> doc; no documents -> sql; both -> the given label when it
    is a valid intent, else hybrid."""
    db, docs = (F.col(x) if isinstance(x, str) else x for x in (has_db, has_docs))
    lab = F.lower(F.trim(F.col(label) if isinstance(label, str) else label))
    return (F.when(~db, "doc").when(~docs, "sql")
            .when(lab.isin(*VALID_INTENTS), lab).otherwise("hybrid"))
