"""Audit-log metrics, search, latency percentiles and trailing-window counts.

All metrics are one-pass aggregations with conditional counts; JSON metadata is
read with ``get_json_object`` (no Python). Percentiles are exact without
gathering a group's rows (``operators.selection``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .selection import at_rank, ranked_values

# FIXED VALUES — query-type buckets (anything else, missing or bad JSON -> unknown)
QUERY_TYPES = ["doc", "db", "hybrid", "csv", "unknown"]


def query_type(meta: Column) -> Column:
    """``query_type`` key, else ``type``; outside the buckets or bad JSON -> unknown."""
    t = F.coalesce(F.get_json_object(meta, "$.query_type"), F.get_json_object(meta, "$.type"))
    return F.when(t.isin(*QUERY_TYPES[:-1]), t).otherwise(F.lit("unknown"))


def response_ms(meta: Column) -> Column:
    """``response_time_ms``, falling back to ``elapsed_ms`` when missing or 0."""
    rt = F.get_json_object(meta, "$.response_time_ms").try_cast("double")
    el = F.get_json_object(meta, "$.elapsed_ms").try_cast("double")
    return F.coalesce(F.nullif(rt, F.lit(0.0)), el)


def queries_by_type(audit: DataFrame, type_col: str = "event_type", meta: str = "metadata_json") -> DataFrame:
    """Counts of query events per bucket; every bucket present (zeros kept)."""
    q = audit.where(F.col(type_col) == "query").groupBy(query_type(F.col(meta)).alias("query_type")).count()
    dim = audit.sparkSession.createDataFrame([(t,) for t in QUERY_TYPES], "query_type string")
    return (F.broadcast(dim).join(q, "query_type", "left")
            .select("query_type", F.coalesce("count", F.lit(0)).cast("long").alias("queries")))


def avg_response_time(audit: DataFrame, type_col: str = "event_type", meta: str = "metadata_json") -> DataFrame:
    """Mean response time of query events, 1 decimal (half-even); null if none."""
    v = response_ms(F.col(meta))
    return audit.where(F.col(type_col) == "query").agg(F.bround(F.avg(v), 1).alias("avg_response_time_ms"))


def platform_metrics(audit: DataFrame, type_col: str = "event_type", meta: str = "metadata_json",
                     session_col: str = "session_id") -> DataFrame:
    """sessions, query events, upload events, non-CSV connections, mean response
    time — one scan, conditional aggregates."""
    et = F.col(type_col)
    return audit.agg(
        F.count_distinct(F.when(et == "session_create", F.col(session_col))).alias("total_sessions"),
        F.count_if(et == "query").alias("total_queries"),
        F.count_if(et == "upload").alias("total_documents_uploaded"),
        F.count_if((et == "connection_create") &
                   (F.coalesce(F.get_json_object(F.col(meta), "$.dialect"), F.lit("")) != "csv")
                   ).alias("active_db_connections"),
        F.bround(F.avg(F.when(et == "query", response_ms(F.col(meta)))), 1).alias("avg_response_time_ms"))


def latency_percentiles(df: DataFrame, by: list[str], value: str, approx: bool = False,
                        accuracy: int = 100_000) -> DataFrame:
    """p50 = interpolated median, p95 = nearest rank ``sorted[max(0, round(.95 n) - 1)]``
    (round half-even), per group.

    Exact by distributed selection (``operators.selection``), however many rows
    one group has; ``approx=True`` switches to ``percentile_approx`` (bounded
    sketch per group, rank error ~ 1/accuracy)."""
    if approx:
        v = F.col(value).cast("double")
        return df.where(v.isNotNull()).groupBy(*by).agg(
            F.count(v).alias("n"), F.percentile_approx(v, 0.5, accuracy).alias("p50"),
            F.percentile_approx(v, 0.95, accuracy).alias("p95"))
    ranked = ranked_values(df.select(*by, value), by, value)
    pos = (F.col("total") - 1) * 0.5
    r95 = F.greatest(F.lit(0), F.bround(F.col("total") * 0.95, 0).cast("long") - 1)
    agg = ranked.groupBy(*by).agg(F.max("total").alias("n"), at_rank(value, F.floor(pos)).alias("lo"), at_rank(value, F.ceil(pos)).alias("hi"),
                                  at_rank(value, r95).alias("p95"), F.max(pos - F.floor(pos)).alias("frac"))
    return agg.select(*by, "n", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("frac")).alias("p50"), "p95")


def trailing_count(df: DataFrame, key: str, ts: str, seconds: int = 60, bucket_seconds: int = 3600) -> DataFrame:
    """Events of the same key in the trailing ``seconds`` (inclusive), per event
    — the plain count, without denial feedback.

    Skew-proof: the window runs per (key, time bucket) instead of per key, so
    one key holding a third of all events is spread over its buckets. Each row
    is also copied into the next bucket when it lies within ``seconds`` of that
    bucket's start (a context row: counted, never emitted), which makes the
    per-bucket count exact."""
    if bucket_seconds < seconds:
        raise ValueError("bucket_seconds must be at least the window length")
    us = F.unix_micros(F.col(ts))
    b_us = bucket_seconds * 1_000_000
    bucket = F.floor(us / b_us).cast("long")
    base = df.withColumn("_us", us).withColumn("_b", bucket).withColumn("_ctx", F.lit(False))
    nxt_start = (F.col("_b") + 1) * b_us
    ctx = (base.where(F.col("_us") >= nxt_start - seconds * 1_000_000)
           .withColumn("_b", F.col("_b") + 1).withColumn("_ctx", F.lit(True)))
    w = Window.partitionBy(key, "_b").orderBy("_us").rangeBetween(-seconds * 1_000_000, 0)
    return (base.unionByName(ctx).withColumn("trailing", F.count(F.lit(1)).over(w))
            .where(~F.col("_ctx")).drop("_us", "_b", "_ctx"))


def audit_search(audit: DataFrame, event_type: str | None = None, session_id=None, user_id=None,
                 limit: int = 500, max_limit: int = 5000, ts: str = "occurred_at", id_col: str = "id") -> DataFrame:
    """Optional equality filters, newest first, ``limit`` clamped to ``max_limit``."""
    df = audit
    for c, v in (("event_type", event_type), ("session_id", session_id), ("user_id", user_id)):
        if v is not None:
            df = df.where(F.col(c) == F.lit(v))
    n = max(1, min(limit, max_limit))
    return df.orderBy(F.col(ts).desc(), F.col(id_col).desc()).limit(n)


def sync_status(events: DataFrame, key: str, ts: str, kind: str, retry_after: str) -> DataFrame:
    """Latest status per connector: rate-limited -> idle with a retry at
    1.5 x retry_after; auth error -> auth_failed with schedules disabled; other
    error -> error; success -> idle."""
    last = events.groupBy(key).agg(F.max_by(F.struct(kind, retry_after, ts), F.col(ts)).alias("l"))
    k = F.col(f"l.{kind}")
    status = (F.when(k == "rate_limited", "idle").when(k == "auth_error", "auth_failed")
              .when(k == "error", "error").otherwise("idle"))
    retry = F.when(k == "rate_limited", F.col(f"l.{ts}") + F.make_dt_interval(
        secs=F.col(f"l.{retry_after}").cast("double") * 1.5))
    return last.select(key, status.alias("sync_status"), (k != "auth_error").alias("scheduled"),
                       retry.alias("retry_at"))
