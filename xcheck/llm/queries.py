"""One ``opN_<name>`` query per operator, over its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .factor_machine import classify_quality
from .html_blocks import extract_main_text
from .lang_id import identify
from .lm_score import cross_entropy_difference
from .ngram_jaccard import ngram_jaccard_join
from .packing import pack_documents
from .phrase_tries import KEEP, MIN_COUNT, mine_phrases
from .quality_thresholds import quality_rules
from .secret_markov import LEARNED, secret_spans, span_text
from .sentencepiece_codec import sentencepiece_round_trip
from .token_alignment import align_tokens
from .url_rules import url_verdicts
from .winnowing import winnow_hits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def op(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return deco


@op("op1_ngram_jaccard_join")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@op("op4_quality_rules")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("failed")


@op("op5_winnowing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = winnow_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                       F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated")


@op("op3_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@op("op8_language_id")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


@op("op9_lm_scoring")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").filter("quality = 1")
    return cross_entropy_difference(table(spark, sf_dir, "documents"), good)


@op("op10_sentencepiece")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = sentencepiece_round_trip(docs, model)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@op("op6_url_filters")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


@op("op7_secret_scans")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("__spans", lambda s: s["kind"] != LEARNED)
    kinds = F.transform("__spans", lambda s: s["kind"])
    counts = [(F.size("__spans") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("__spans")).alias("spans"))


@op("op2_html_extraction")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


# phrases counted by list slices; exact sums in HUGEINT
_PHRASES = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \x09]+'), lambda w: w <> '') AS w FROM pieces),
spans AS (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, (VALUES (1), (2), (3), (4)) AS s(size) WHERE len(w) >= size),
counted AS (SELECT lang, w[i:i + size - 1] AS p, size, count(*)::HUGEINT AS a FROM spans GROUP BY ALL),
totals AS (SELECT lang, sum(a)::HUGEINT AS n FROM counted WHERE size = 1 GROUP BY lang),
often AS (SELECT * FROM counted WHERE a >= {MIN_COUNT}),
cuts AS (SELECT o.lang, o.p, o.a, k, l.a AS l, r.a AS r, (2000000 * o.a) // (l.a + r.a) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM often WHERE size > 1) o
  JOIN often l ON l.lang = o.lang AND l.p = o.p[1:k] JOIN often r ON r.lang = o.lang AND r.p = o.p[k + 1:o.size]),
scored AS (SELECT lang, p, a, l, r, score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
parts AS (SELECT lang, p[i:j] AS p, max(a) AS longer FROM
  (SELECT *, unnest(range(i + 1, size + 1)) AS j FROM (SELECT *, unnest(range(1, size)) AS i FROM often WHERE size > 2)) WHERE j - i + 1 < size GROUP BY ALL),
kept AS (SELECT s.*, array_to_string(s.p, ' ') AS phrase FROM scored s LEFT JOIN parts USING (lang, p) WHERE longer IS NULL OR 100 * longer < 80 * s.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= {KEEP}
"""


@op("op13_phrase_collocations", oracle=_PHRASES)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(table(spark, sf_dir, "documents"))


@op("op12_token_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return align_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@op("op11_quality_classifier")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
