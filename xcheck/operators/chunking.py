"""Chunks of whole documents, cut at the coarsest separator: the default for
documents without a semantic type.

A chunk is a span of at most ``size`` characters. It ends after the last
paragraph break in the second half of that span; where there is none, after the
last line break there, then after the last space, else at ``size``. The next
chunk starts after the first white space of this one's last ``overlap``
characters, so it repeats whole words (without white space there, at the
overlap's first character). Chunks are stripped; empty ones go. Null and empty
texts have no chunk.

The spans of a text follow from one another, so each document is walked once by
a short Arrow function; Spark deals the documents.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import rules

_WHITE = " \t\n\f\r"


def chunks_of(text: str | None, size: int = rules.CHUNK_SIZE, overlap: int = rules.CHUNK_OVERLAP) -> list[str]:
    if size < 2 * overlap or size < 2:
        raise ValueError("the overlap must not be more than half of the chunk size")
    text, spans, start = text or "", [], 0
    while len(text) - start > size:
        half, full = start + size // 2, start + size
        end = full
        for sep in rules.CHUNK_SEPARATORS:
            at = text.rfind(sep, half, full)
            if at >= 0:
                end = at + len(sep)
                break
        spans.append((start, end))
        tail = end - overlap
        gaps = [g for g in (text.find(" ", tail, end), text.find("\n", tail, end)) if g >= 0]
        start = min(gaps) + 1 if gaps else tail
    spans.append((start, len(text)))
    return [c for c in (text[a:b].strip(_WHITE) for a, b in spans) if c]


def chunk_recursive(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    size: int = rules.CHUNK_SIZE, overlap: int = rules.CHUNK_OVERLAP) -> DataFrame:
    """One row per chunk: (id, chunk_ix, chunk)."""
    @F.pandas_udf(ArrayType(StringType()))
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([chunks_of(t, size, overlap) for t in texts], dtype=object)

    return docs.select(id_col, F.posexplode(cut(F.col(text_col))).alias("chunk_ix", "chunk"))
