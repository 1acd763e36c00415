"""Vector retrieval: exact top-k, recall@k, few-shot, table selection, result
merging (dedup / rerank / citations), query expansion, multi-pass retrieval.

Exact top-k plan: scores are matrix products of blocks of corpus rows and
blocks of queries; a block keeps the k best rows of each query only, and a final
``row_number() <= k`` (a ``WindowGroupLimit``) merges the blocks. No pair rows
and no cross join. A query side of at most ``SENT_BYTES`` (its size is measured
first) is sent to the tasks, and the corpus stays where it is. A larger one is
never gathered: both sides are cut into blocks per tenant, every block of
queries goes to its tenant's blocks of the corpus, and Spark deals the pairs of
blocks. Both ways give the same rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules
from ..functions import text as T

SENT_BYTES = 16 << 20       # query vectors that are sent to the tasks
CORPUS_BLOCK = 20_000       # corpus rows of a block, about
QUERY_BLOCK = 2_000         # queries of a block, about
_STEP = 2048                # rows and queries of one product


def with_unit(df: DataFrame, vec: str = "embedding", out: str = "unit") -> DataFrame:
    """Add the L2-normalised vector as ``array<double>`` (zero vector stays zero)."""
    # the norm is its own column first: referenced inside the lambda it would be
    # recomputed for every element (quadratic in the dimension)
    d = df.withColumn("_norm", T.norm(vec))
    unit = F.when(F.col("_norm") == 0, F.transform(vec, lambda x: F.lit(0.0))).otherwise(
        F.transform(vec, lambda x: x.cast("double") / F.col("_norm")))
    return d.withColumn(out, unit).drop("_norm")


def _best(x, ids, m, k: int, min_score: float | None):
    """(query, id, score) of the k best rows of ``x`` for every query (row of
    ``m``), ties by id, from products of at most ``_STEP`` rows and queries."""
    queries, found, scores = [], [], []
    for lo in range(0, len(x), _STEP):
        own = ids[lo:lo + _STEP]
        for first in range(0, len(m), _STEP):
            s = x[lo:lo + _STEP] @ m[first:first + _STEP].T
            ok = np.isfinite(s) if min_score is None else np.isfinite(s) & (s >= min_score)
            least = np.partition(s, len(s) - k, axis=0)[len(s) - k] if len(s) > k else np.full(s.shape[1], -np.inf)
            row, query = np.nonzero(ok & (s >= least))
            order = np.lexsort((own[row], -s[row, query], query))
            row, query = row[order], query[order]
            rank = np.arange(len(query)) - np.searchsorted(query, query)
            keep = rank < k
            queries.append(first + query[keep]), found.append(own[row[keep]]), scores.append(s[row[keep], query[keep]])
    if not queries:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    query, did, score = (np.concatenate(c) for c in (queries, found, scores))
    order = np.lexsort((did, -score, query))
    query, did, score = query[order], did[order], score[order]
    keep = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[keep], did[keep], score[keep]


def _matrix(vectors) -> np.ndarray:
    return np.vstack(vectors.to_numpy()).astype(np.float64)


def _sent_queries(spark, qrows, corpus, k, qid, did, dvec, keys, min_score, qvec) -> DataFrame:
    tenants: dict[tuple, list[int]] = {}
    for i, r in enumerate(qrows):
        tenants.setdefault(tuple(r[c] for c in keys), []).append(i)
    qids = np.array([r[qid] for r in qrows], np.int64)
    m = np.array([np.asarray(r[qvec], np.float64) for r in qrows])
    sent = spark.sparkContext.broadcast((qids, m, tenants))

    def score(batches):
        ids, vectors, of = sent.value
        for pdf in batches:
            if not len(pdf):
                continue
            groups = pdf.groupby(keys, dropna=False, sort=False).indices.items() if keys else [((), np.arange(len(pdf)))]
            x, dids = _matrix(pdf[dvec]), pdf[did].to_numpy()
            for tenant, rows in groups:
                mine = of.get(tenant if isinstance(tenant, tuple) else (tenant,))
                if mine:
                    query, d, s = _best(x[rows], dids[rows], vectors[mine], k, min_score)
                    yield pd.DataFrame({qid: ids[np.array(mine)[query]], did: d, "score": s})

    return corpus.select(did, dvec, *keys).mapInPandas(score, f"{qid} long, {did} long, score double")


def _blocks(queries: DataFrame, corpus: DataFrame, k, qid, did, dvec, keys, min_score, qvec) -> DataFrame:
    key = F.xxhash64(*keys) if keys else F.lit(0).cast("long")
    q = queries.select(F.col(qid).alias("_id"), F.col(qvec).alias("_v"), key.alias("_key"))
    c = corpus.select(F.col(did).alias("_id"), F.col(dvec).alias("_v"), key.alias("_key"))
    size = lambda df, rows, name: df.groupBy("_key").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(name))
    shape = size(q, QUERY_BLOCK, "_nq").join(size(c, CORPUS_BLOCK, "_nc"), "_key")
    own = lambda n: F.pmod(F.xxhash64("_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = q.join(shape, "_key").select("_key", "_id", "_v", own("_nq").alias("_qb"), every("_nc").alias("_cb"))
    c = c.join(shape, "_key").select("_key", "_id", "_v", own("_nc").alias("_cb"), every("_nq").alias("_qb"))
    block = ["_key", "_qb", "_cb"]

    def score(ours: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if not len(ours) or not len(theirs):
            return pd.DataFrame({qid: [], did: [], "score": []}).astype({qid: "int64", did: "int64"})
        query, d, s = _best(_matrix(theirs["_v"]), theirs["_id"].to_numpy(), _matrix(ours["_v"]), k, min_score)
        return pd.DataFrame({qid: ours["_id"].to_numpy()[query], did: d, "score": s})

    return q.groupBy(*block).cogroup(c.groupBy(*block)).applyInPandas(score, f"{qid} long, {did} long, score double")


def topk(queries: DataFrame, corpus: DataFrame, k: int, qid: str = "qid", did: str = "vec_id",
         qvec: str = "qunit", dvec: str = "unit", partition_cols: list[str] | None = None,
         min_score: float | None = None, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """k best corpus rows per query by dot product of unit vectors (cosine).
    ``partition_cols`` restrict candidates to the query's own partition
    (tenant / collection). Output: qid, did, score, rank (1-based, ties by did).
    Memory is bounded by the blocks, whatever the number of queries or rows."""
    keys = partition_cols or []
    q = queries.select(qid, qvec, *keys).where(F.col(qvec).isNotNull())
    c = corpus.where(F.col(dvec).isNotNull())
    size = q.agg(F.coalesce(F.sum(F.size(qvec) * 8 + 64), F.lit(0))).first()[0]
    if size <= sent_bytes:
        scored = _sent_queries(corpus.sparkSession, q.collect(), c, k, qid, did, dvec, keys, min_score, qvec)
    else:
        scored = _blocks(q, c, k, qid, did, dvec, keys, min_score, qvec)
    w = Window.partitionBy(qid).orderBy(F.col("score").desc(), F.col(did))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def recall_at_k(ranked: DataFrame, gold: DataFrame, ks=(1, 3, 5), qid: str = "qid",
                did: str = "vec_id") -> DataFrame:
    """Share of questions with a gold item in their top k, for each k.
    ``gold`` is (qid, did); questions without any retrieved gold count as 0."""
    hit = (ranked.join(gold, [qid, did], "left_semi").groupBy(qid).agg(F.min("rank").alias("best")))
    qs = gold.select(qid).distinct().join(hit, qid, "left")
    return qs.agg(*[F.avg(F.when(F.col("best") <= k, 1.0).otherwise(0.0)).alias(f"recall_at_{k}") for k in ks])


def dedup_ranked(lists: DataFrame, key_cols: list[str], qid: str = "qid") -> DataFrame:
    """Merge ranked lists (``list_ix``, ``rank``): first occurrence per key wins,
    earlier lists first. Aggregation (min_by) rather than a window sort."""
    order = F.struct("list_ix", "rank")
    other = [c for c in lists.columns if c not in key_cols + [qid]]
    best = lists.groupBy(qid, *key_cols).agg(F.min_by(F.struct(*other), order).alias("_r"))
    return best.select(qid, *key_cols, *[F.col("_r." + c).alias(c) for c in other])


def rerank_topk(cands: DataFrame, k: int = 5, score: str = "rerank_score", qid: str = "qid") -> DataFrame:
    """Rescore candidates and keep k; unscored candidates keep merge order."""
    w = Window.partitionBy(qid).orderBy(F.col(score).desc_nulls_last(), F.col("list_ix"), F.col("rank"))
    return cands.withColumn("final_rank", F.row_number().over(w)).where(F.col("final_rank") <= k)


def citations(ranked: DataFrame, source: str, page: str, order: str = "final_rank",
              qid: str = "qid") -> DataFrame:
    """Distinct (source, page) per question with the position of first mention."""
    return ranked.groupBy(qid, source, page).agg(F.min(order).alias("first_rank"))


def expand_queries(questions: DataFrame, qid, text: str) -> DataFrame:
    """Original question first, then the expansions of every rule whose trigger
    words meet the question's ``\\w+`` tokens; case-insensitive dedup keeps the
    first. One row per (qid, ix, query); all work is inside the row."""
    toks = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"(?U)\b\w+\b"), 0))
    parts = [F.array(F.col(text))]
    for trig, exps in rules.EXPANSION_RULES:
        hit = F.arrays_overlap(toks, F.array(*[F.lit(w) for w in trig]))
        parts.append(F.when(hit, F.array(*[F.lit(e) for e in exps])).otherwise(F.array().cast("array<string>")))
    allq = F.concat(*parts)
    keyed = F.transform(allq, lambda x, i: F.struct(F.lower(T.strip_ws(x)).alias("k"), i.alias("i"), x.alias("q")))
    ids = [qid] if isinstance(qid, str) else list(qid)
    rows = questions.select(*ids, keyed.alias("_a"))
    first = F.filter("_a", lambda x: ~F.exists(F.slice(F.col("_a"), 1, x["i"]), lambda y: y["k"] == x["k"]))
    return (rows.select(*ids, F.posexplode(first).alias("ix", "_e")).select(*ids, "ix", F.col("_e.q").alias("query")))


def lsh_neighbors(vectors: DataFrame, threshold: float, id_col: str = "vec_id", vec: str = "unit",
                  bucket_length: float = 1.0, num_tables: int = 3, seed: int = 7) -> DataFrame:
    """Approximate near-duplicate pairs (Euclidean distance on unit vectors,
    i.e. cosine >= 1 - d^2/2) with MLlib's bucketed random projection LSH:
    candidates share a hash bucket in one table at least.

    Buckets may hold a large part of all vectors, so candidates are never rows.
    Vectors are dealt into blocks, each pair of blocks meets once, and a matrix
    product finds its close pairs; those in a common bucket stay, with the distance
    that MLlib computes. Memory is bounded by a block and a product of ``_STEP``
    rows; the products are quadratic in the number of vectors."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array
    v = vectors.select(id_col, F.col(vec).alias("_v")).distinct().select(id_col, "_v", array_to_vector("_v").alias("features"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket_length,
                                        numHashTables=num_tables, seed=seed).fit(v)
    hashed = model.transform(v).select(F.col(id_col).alias("id"), F.col("_v").alias("v"), F.array(
        *[vector_to_array(F.col("hashes")[i])[0] for i in range(num_tables)]).alias("h"))
    blocks = max(_LSH_BLOCKS, -(-hashed.count() // _LSH_BLOCK))
    own = hashed.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda x: F.struct(F.least(x, "block").alias("p"), F.greatest(x, "block").alias("q")))
    kind = hashed.schema["id"].dataType.simpleString()
    dealt = own.select("*", F.inline(meets)).repartition(blocks * (blocks + 1) // 2, "p", "q")
    return dealt.groupBy("p", "q").applyInPandas(_close_pairs(threshold), f"a {kind}, b {kind}, dist double")


_LSH_BLOCKS = 8             # at least so many blocks, for 36 tasks
_LSH_BLOCK = 40_000         # vectors of a block, about


def _close_pairs(threshold: float):
    """Pairs of the vectors of two blocks (or inside one) in a common bucket and nearer than ``threshold``."""
    limit = threshold * threshold + 1e-6        # the product's rounding is far below; the distance itself decides

    def pairs(frame: pd.DataFrame) -> pd.DataFrame:
        p, q = int(frame["p"].iloc[0]), int(frame["q"].iloc[0])
        sides = []
        for block in (p, q):
            part = frame[frame["block"] == block]
            sides.append((part["id"].to_numpy(), np.array(part["v"].tolist(), dtype="f8"), np.array(part["h"].tolist(), dtype="f8")))
        (ids_a, va, ha), (ids_b, vb, hb) = sides
        found = [(ids_a[:0], ids_a[:0], np.empty(0))]
        if len(ids_a) and len(ids_b):
            na, nb = (va * va).sum(1), (vb * vb).sum(1)
            for i in range(0, len(ids_a), _STEP):
                for j in range(0, len(ids_b), _STEP):
                    near = na[i:i + _STEP, None] + nb[None, j:j + _STEP] - 2.0 * (va[i:i + _STEP] @ vb[j:j + _STEP].T)
                    x, y = np.nonzero(near < limit)
                    x, y = x + i, y + j
                    keep = (ha[x] == hb[y]).any(1) & (ids_a[x] != ids_b[y])
                    if p == q:
                        keep &= ids_a[x] < ids_b[y]
                    x, y = x[keep], y[keep]
                    square = np.zeros(len(x))
                    for k in range(va.shape[1]):        # in MLlib's order of summing
                        square += (va[x, k] - vb[y, k]) ** 2
                    dist = np.sqrt(square)
                    keep = dist < threshold
                    a, b = ids_a[x[keep]], ids_b[y[keep]]
                    found.append((np.where(a < b, a, b), np.where(a < b, b, a), dist[keep]))
        a, b, dist = (np.concatenate(c) for c in zip(*found))
        return pd.DataFrame({"a": a, "b": b, "dist": dist})
    return pairs
