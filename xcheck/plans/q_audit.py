"""Audit / metrics queries. The audit log is derived from ``events``: clicks are
query events, views uploads, signups session starts, purchases connection
creations; ``props.k`` is the response time in ms, and the query metadata JSON
varies (query_type / type keys, zero response time with an elapsed fallback,
no timing, an unknown type, malformed JSON)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit as A
from ..session import Tables
from .registry import query


def audit_log(t: Tables) -> DataFrame:
    e = t.events
    k = F.get_json_object("props", "$.k")
    v = F.col("value")
    et = (F.when(F.col("event_type") == "click", "query").when(F.col("event_type") == "view", "upload")
          .when(F.col("event_type") == "signup", "session_create")
          .when(F.col("event_type") == "purchase", "connection_create").otherwise("error"))
    qmeta = (F.when(v < 10, F.concat(F.lit('{"query_type":"doc","response_time_ms":'), k, F.lit("}")))
             .when(v < 20, F.concat(F.lit('{"query_type":"db","response_time_ms":0,"elapsed_ms":'), k, F.lit("}")))
             .when(v < 30, F.concat(F.lit('{"type":"hybrid","response_time_ms":'), k, F.lit("}")))
             .when(v < 40, F.lit('{"query_type":"csv"}'))
             .when(v < 45, F.concat(F.lit('{"query_type":"sql","response_time_ms":'), k, F.lit("}")))
             .otherwise(F.lit("not json{")))
    cmeta = F.when(v < 25, F.lit('{"dialect":"csv"}')).otherwise(F.lit('{"dialect":"postgresql"}'))
    meta = F.when(et == "query", qmeta).when(et == "connection_create", cmeta)
    return e.select(F.col("event_id").alias("id"), et.alias("event_type"),
                    F.concat(F.lit("s"), F.col("user_id")).alias("session_id"), "user_id",
                    meta.alias("metadata_json"), F.col("ts").alias("occurred_at"), "value", "props")


_SQL_AUDIT = """
  a AS (SELECT event_id AS id,
               CASE event_type WHEN 'click' THEN 'query' WHEN 'view' THEN 'upload' WHEN 'signup' THEN 'session_create'
                               WHEN 'purchase' THEN 'connection_create' ELSE 'error' END AS et,
               's' || user_id AS session_id, user_id, ts AS occurred_at, value, props,
               json_extract_string(props, '$.k') AS k FROM events),
  m AS (SELECT *, CASE WHEN et = 'query' THEN
                    CASE WHEN value < 10 THEN '{"query_type":"doc","response_time_ms":' || k || '}'
                         WHEN value < 20 THEN '{"query_type":"db","response_time_ms":0,"elapsed_ms":' || k || '}'
                         WHEN value < 30 THEN '{"type":"hybrid","response_time_ms":' || k || '}'
                         WHEN value < 40 THEN '{"query_type":"csv"}'
                         WHEN value < 45 THEN '{"query_type":"sql","response_time_ms":' || k || '}'
                         ELSE 'not json{' END
                  WHEN et = 'connection_create' THEN CASE WHEN value < 25 THEN '{"dialect":"csv"}' ELSE '{"dialect":"postgresql"}' END
                  END AS meta FROM a),
  j AS (SELECT *, CASE WHEN json_valid(meta) THEN coalesce(json_extract_string(meta, '$.query_type'), json_extract_string(meta, '$.type')) END AS qt,
               CASE WHEN json_valid(meta) THEN coalesce(nullif(TRY_CAST(json_extract_string(meta, '$.response_time_ms') AS DOUBLE), 0),
                                                       TRY_CAST(json_extract_string(meta, '$.elapsed_ms') AS DOUBLE)) END AS rt
        FROM m)"""


@query("queries_by_type", oracle=f"""WITH {_SQL_AUDIT},
  b AS (SELECT unnest(['doc','db','hybrid','csv','unknown']) AS query_type),
  c AS (SELECT CASE WHEN qt IN ('doc','db','hybrid','csv') THEN qt ELSE 'unknown' END AS query_type, count(*) AS n
        FROM j WHERE et = 'query' GROUP BY 1)
SELECT b.query_type, coalesce(n, 0) AS queries FROM b LEFT JOIN c USING (query_type)""")
def queries_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.queries_by_type(audit_log(Tables(spark, sf_dir)))


@query("avg_response_time", oracle=f"""WITH {_SQL_AUDIT}
SELECT round_even(avg(rt), 1) AS avg_response_time_ms FROM j WHERE et = 'query'""")
def avg_response_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.avg_response_time(audit_log(Tables(spark, sf_dir)))


@query("platform_metrics", oracle=f"""WITH {_SQL_AUDIT}
SELECT count(DISTINCT CASE WHEN et = 'session_create' THEN session_id END) AS total_sessions,
       count(*) FILTER (WHERE et = 'query') AS total_queries,
       count(*) FILTER (WHERE et = 'upload') AS total_documents_uploaded,
       count(*) FILTER (WHERE et = 'connection_create' AND coalesce(CASE WHEN json_valid(meta) THEN json_extract_string(meta, '$.dialect') END, '') <> 'csv') AS active_db_connections,
       round_even(avg(CASE WHEN et = 'query' THEN rt END), 1) AS avg_response_time_ms FROM j""")
def platform_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.platform_metrics(audit_log(Tables(spark, sf_dir)))


@query("latency_percentiles", oracle="""
SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50,
       list_sort(list(value))[greatest(1, CAST(round_even(0.95 * count(*), 0) AS BIGINT))] AS p95
FROM events WHERE value IS NOT NULL GROUP BY event_type""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p50 / p95 of ``value`` per event type (value = latency sample)."""
    r = A.latency_percentiles(Tables(spark, sf_dir).events, ["event_type"], "value")
    return r.select("event_type", "n", F.round("p50", 6).alias("p50"), "p95")


@query("rate_limit_count", oracle="""
SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS trailing
FROM events""")
def rate_limit_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests per user in the trailing 60 s (no denial feedback)."""
    e = Tables(spark, sf_dir).events
    return A.trailing_count(e, "user_id", "ts", 60).select("event_id", "trailing")


@query("audit_search", oracle=f"""WITH {_SQL_AUDIT}
SELECT id, strftime(occurred_at, '%Y-%m-%d %H:%M:%S.%f') AS occurred_at FROM j WHERE et = 'query'
ORDER BY j.occurred_at DESC, id DESC LIMIT 500""")
def audit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = A.audit_search(audit_log(Tables(spark, sf_dir)), event_type="query", limit=500)
    return r.select("id", F.date_format("occurred_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("occurred_at"))


@query("sync_status_fold", oracle="""
WITH s AS (SELECT user_id, ts, json_extract_string(props, '$.k') AS ra,
                  CASE WHEN event_type = 'purchase' THEN 'success' WHEN value < 10 THEN 'rate_limited'
                       WHEN value < 20 THEN 'auth_error' ELSE 'error' END AS kind
           FROM events WHERE event_type IN ('error', 'purchase')),
  l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM s) WHERE r = 1)
SELECT user_id, CASE kind WHEN 'rate_limited' THEN 'idle' WHEN 'auth_error' THEN 'auth_failed' WHEN 'error' THEN 'error' ELSE 'idle' END AS sync_status,
       kind <> 'auth_error' AS scheduled,
       CASE WHEN kind = 'rate_limited' THEN strftime(ts + to_microseconds(CAST(CAST(ra AS DOUBLE) * 1.5 * 1000000 AS BIGINT)), '%Y-%m-%d %H:%M:%S.%f') END AS retry_at
FROM l""")
def sync_status_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connector = user; error events are sync failures (rate limit / auth /
    other by value), purchases successful syncs; ``k`` = retry-after seconds."""
    e = Tables(spark, sf_dir).events.where(F.col("event_type").isin("error", "purchase"))
    kind = (F.when(F.col("event_type") == "purchase", "success").when(F.col("value") < 10, "rate_limited")
            .when(F.col("value") < 20, "auth_error").otherwise("error"))
    e = e.select("user_id", "ts", kind.alias("kind"), F.get_json_object("props", "$.k").alias("ra"))
    r = A.sync_status(e, "user_id", "ts", "kind", "ra")
    return r.select("user_id", "sync_status", "scheduled",
                    F.date_format("retry_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("retry_at"))
