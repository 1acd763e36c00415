"""Corpus pipeline: documents in, clean token ids out.

Stages, in order: language identification (unidentified texts go), n-gram
Jaccard join (one document of each group of near copies stays), benchmark
decontamination (documents in which a benchmark window occurs go), secret scans
(secrets are masked in the text), SentencePiece encoding and decoding (ids, and
the text they decode to). Each stage gets the Parquet that the one before it
wrote, works on all of it, and all but the last return the columns of documents.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from xcheck.llm.lang_id import keep_identified
from xcheck.llm.ngram_jaccard import keep_one_per_group
from xcheck.llm.secret_markov import redact
from xcheck.llm.sentencepiece_codec import sentencepiece_round_trip
from xcheck.llm.tables import written
from xcheck.llm.winnowing import drop_contaminated

# neither training models nor masking by a learned model can be said in SQL
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an identified language: letter-less texts go, and those unlike all that was learned."""
    return keep_identified(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each linked group: the one with the smallest doc_id."""
    return keep_one_per_group(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark table occurs."""
    return drop_contaminated(docs, spark.read.parquet(os.path.join(sf_dir, "benchmark.parquet")))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; n_chars follows the text."""
    out = redact(docs)
    if "n_chars" not in docs.columns:
        return out
    kind = docs.schema["n_chars"].dataType
    return out.withColumn("n_chars", F.length("text").cast(kind)).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str, model_file: str | None = None) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, decoded) of every document."""
    if model_file is None:
        import public_tokenizers
        model_file = public_tokenizers.path("piece_bpe_32k.model")
    plain = docs.select(*[F.col(c) for c in ("doc_id", "lang", "source", "text")])
    rows = sentencepiece_round_trip(plain, model_file)
    return rows.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("language_id", language), ("ngram_jaccard_join", near_copies), ("winnowing", decontaminate),
          ("secret_scans", mask_secrets), ("sentencepiece", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder for the next."""
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
