"""Query registry: every public query is a ``(spark, sf_dir) -> DataFrame``
callable, optionally paired with a DuckDB SQL oracle over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


# Output columns whose natural Spark type is int but whose SQL twin (row
# numbers, counts, list positions) is bigint: widened so both schemas agree.
AS_LONG = {
    "attach_page_meta": ["chunk_ix", "page"], "chunk_recursive": ["chunk_ix", "chunk_len"],
    "chunk_windows": ["chunk_ix", "chunk_len"],
    "cite_sources": ["first_rank"], "deep_retrieve": ["rank"], "detect_pii": ["email_hits"],
    "expand_queries": ["ix"], "few_shot": ["rank"], "forecast_linear": ["step", "mi"], "full_series": ["mo", "yr"],
    "period_change": ["yr"], "read_pages_text": ["page"], "rel_window": ["rk"], "retrieve": ["final_rank"],
    "route_question": ["score", "primary_hits"], "select_tables": ["rank"],
    "stream_compression_trigger": ["message_count"], "tag_chunks": ["chunk_ix"], "union_retrieval": ["rank"],
    "vector_topk_join": ["rank"],
}


def _widen(name: str, fn):
    cols = AS_LONG.get(name)
    if not cols:
        return fn

    def run(spark, sf_dir):
        from pyspark.sql import functions as F
        df = fn(spark, sf_dir)
        return df.select(*[F.col(c).cast("long").alias(c) if c in cols else F.col(c) for c in df.columns])
    run.__doc__ = fn.__doc__
    return run


def query(name: str, oracle: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = _widen(name, fn)
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import every plan module so their ``@query`` decorators run."""
    from . import (  # noqa: F401
        q_audit, q_commerce, q_convo, q_csv, q_discrepancy, q_docs, q_functions, q_misc, q_model,
        q_pii, q_profile, q_records, q_relational, q_retrieval, q_sources, q_streaming,
    )
