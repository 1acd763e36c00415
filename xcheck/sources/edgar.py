"""Filing feeds and registers: filing lists, ticker maps, chunk tagging,
cached filings, company search, connector and history views, text vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

# FIXED VALUES — company search ranks and result size, history page clamp
RANK_EXACT, RANK_PREFIX, RANK_NAME = 0, 1, 2
SEARCH_K = 10
HISTORY_MAX = 100


def filing_list(subs: DataFrame, cik: str, form_type: str, n: int) -> DataFrame:
    """Parallel arrays (form, accession, ...) -> rows; keep the form type
    (case-insensitive) and the first ``n`` in feed order per company."""
    arrays = [c for c in subs.columns if c != cik]
    z = subs.select(cik, F.posexplode(F.arrays_zip(*arrays)).alias("pos", "z"))
    z = z.select(cik, "pos", *[F.col(f"z.{a}").alias(a) for a in arrays]).where(F.upper("form") == form_type.upper())
    w = Window.partitionBy(cik).orderBy("pos")
    return z.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


_TICKER = T.MapType(T.StringType(), T.StructType([T.StructField("cik_str", T.LongType()),
                                                    T.StructField("ticker", T.StringType()),
                                                    T.StructField("title", T.StringType())]))


def ticker_map_flatten(df: DataFrame, json_col: str) -> DataFrame:
    """JSON object of objects -> (cik, upper-case ticker, name) rows."""
    m = df.select(F.explode(F.map_values(F.from_json(json_col, _TICKER))).alias("e"))
    return m.select(F.col("e.cik_str").alias("cik"), F.upper("e.ticker").alias("ticker"), F.col("e.title").alias("name"))


def tag_chunks(chunks: DataFrame, filings: DataFrame, key: str) -> DataFrame:
    """Every chunk carries ``ticker-type-date`` as its source plus the filing fields."""
    f = filings.select(key, "ticker", "filing_type", "filing_date", "accession")
    return chunks.join(f, key).select(
        "*", F.concat_ws("-", "ticker", "filing_type", "filing_date").alias("source"),
        F.create_map(F.lit("filing_type"), F.col("filing_type"), F.lit("ticker"), F.col("ticker"),
                     F.lit("filing_date"), F.col("filing_date"), F.lit("accession"), F.col("accession")).alias("meta"))


def cached_filings(filings: DataFrame, ticker: str | None = None, cik=None) -> DataFrame:
    df = filings
    if ticker:
        df = df.where(F.col("ticker") == ticker.upper())
    if cik is not None:
        df = df.where(F.col("cik") == cik)
    return df.orderBy(F.col("filing_date").desc(), F.col("accession"))


def company_search(companies: DataFrame, queries: DataFrame, k: int = SEARCH_K) -> DataFrame:
    """Rank 0 exact ticker, 1 ticker prefix, 2 name contains (case-insensitive);
    register order inside a rank; best ``k`` per query. Every match is an
    equi-join: tickers are expanded into their prefixes and names into their
    substrings of each query length (a handful of lengths), so no
    query x company pairs are formed."""
    q = queries.select("q", F.upper(F.trim("q")).alias("qu"), F.lower(F.trim("q")).alias("ql"))
    exact = companies.join(q, companies["ticker"] == q["qu"]).select("q", "ticker", "ix", F.lit(RANK_EXACT).alias("rank"))
    pre = companies.select("ticker", "ix", F.explode(F.sequence(F.lit(1), F.length("ticker"))).alias("L")) \
        .withColumn("p", F.expr("substring(ticker, 1, L)"))
    prefix = pre.join(q, pre["p"] == q["qu"]).select("q", "ticker", "ix", F.lit(RANK_PREFIX).alias("rank"))
    lens = sorted({r[0] for r in q.select(F.length("ql")).distinct().collect() if r[0]})   # a few lengths
    grams = None
    for L in lens:
        g = companies.select("ticker", "ix", F.lower("name").alias("nl")).select(
            "ticker", "ix", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("nl") - L + 1))).alias("s"), "nl") \
            .select("ticker", "ix", F.expr(f"substring(nl, s, {L})").alias("g")).where(F.length("g") == L)
        grams = g if grams is None else grams.unionByName(g)
    parts = [exact, prefix]
    if grams is not None:
        parts.append(grams.join(q, grams["g"] == q["ql"]).select("q", "ticker", "ix", F.lit(RANK_NAME).alias("rank")))
    allm = parts[0]
    for p in parts[1:]:
        allm = allm.unionByName(p)
    best = allm.groupBy("q", "ticker", "ix").agg(F.min("rank").alias("rank"))
    w = Window.partitionBy("q").orderBy("rank", "ix")
    return best.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_k")


def active_connectors(connectors: DataFrame, cols: list[str], flag: str = "is_active") -> DataFrame:
    """Active rows only; only the listed columns (credentials never selected)."""
    return connectors.where(F.col(flag)).select(*cols)


def history_page(history: DataFrame, key: str, ts: str, n: int = 20, id_col: str = "id") -> DataFrame:
    """Newest ``n`` (clamped to 1..100) per key; ``row_count`` = the leading
    integer of a ``'<n> rows'`` summary, else null."""
    n = max(1, min(n, HISTORY_MAX))
    w = Window.partitionBy(key).orderBy(F.col(ts).desc(), F.col(id_col).desc())
    lead = F.split(F.trim("summary"), r"\s+").getItem(0)
    return (history.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n)
            .withColumn("row_count", F.when(lead.rlike(r"^[+-]?\d+$"), lead.cast("int"))).drop("_k"))


def embed_text(df: DataFrame, text: str, out: str, dims: int = 1024) -> DataFrame:
    """Stand-in text embedding: hashed term frequencies of ``\\w+`` tokens
    (MLlib ``HashingTF``), L2-normalised into ``array<double>``."""
    from pyspark.ml.feature import HashingTF
    from pyspark.ml.functions import vector_to_array
    from ..operators.retrieval import with_unit
    toks = df.withColumn("_tok", F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"(?U)\w+"), 0))
    tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dims).transform(toks)
    v = tf.withColumn("_v", vector_to_array("_tf")).drop("_tok", "_tf")
    return with_unit(v, vec="_v", out=out).drop("_v")
