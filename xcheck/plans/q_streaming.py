"""Streaming queries: each runs a Structured Streaming job over the table's
files with ``availableNow`` (checkpointed under the session's checkpoint
folder) and returns what it wrote. Batch twins with SQL oracles are given
where the result is a pure function of the input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pii as P
from ..streaming import core as S
from .q_pii import SQL_MASKED
from .registry import query

# event_type -> endpoint of the quota rules
_ENDPOINT = {"click": "chat", "view": "hybrid", "purchase": "sandbox", "signup": "autopilot", "error": "chat"}


def _endpoint(c):
    m = F.create_map(*[F.lit(x) for kv in _ENDPOINT.items() for x in kv])
    return F.try_element_at(m, c)


@query("usage_by_window", oracle="""
WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS ws, event_type FROM events)
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM w
WHERE ws + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES
GROUP BY ALL""")
def usage_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly event counts per type from the event stream (10 minute
    watermark, append mode: only closed windows are emitted)."""
    ev = S.file_stream(spark, sf_dir, "events")
    out = S.run_available_now(S.usage_by_window(ev), "usage")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type",
                      F.col("n").cast("long").alias("n"))


@query("stream_financials", oracle="""
WITH d AS (SELECT time_bucket(INTERVAL 1 DAY, o_orderdate) AS day, o_orderstatus, o_totalprice FROM orders)
SELECT strftime(day, '%Y-%m-%d') AS day, o_orderstatus, round(sum(o_totalprice), 2) AS revenue, count(*) AS orders
FROM d WHERE day + INTERVAL 1 DAY <= (SELECT max(o_orderdate) FROM orders) - INTERVAL 1 DAY GROUP BY ALL""")
def stream_financials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily revenue per order status from the order stream (1 day watermark)."""
    o = S.file_stream(spark, sf_dir, "orders")
    out = S.run_available_now(S.financials_by_day(o, "o_orderdate", "o_totalprice", "o_orderstatus"), "fin")
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "o_orderstatus",
                      F.round("revenue", 2).alias("revenue"), F.col("orders").cast("long").alias("orders"))


_WHEN = "strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts"


def _told(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("sliding_rate_limit", oracle=f"""
WITH RECURSIVE e AS (SELECT user_id, event_id, ts, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
  r AS (SELECT user_id, rn, event_id, ts, true AS allowed, CAST(0 AS BIGINT) AS retry_after, [t] AS hits FROM e WHERE rn = 1
        UNION ALL
        SELECT user_id, rn, event_id, ts, len(live) < 3, CASE WHEN len(live) < 3 THEN 0 ELSE (live[1] + 3600000000 - t) // 1000000 + 1 END,
               CASE WHEN len(live) < 3 THEN list_append(live, t) ELSE live END
        FROM (SELECT e.*, list_filter(r.hits, lambda h: h >= e.t - 3600000000) AS live FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1))
SELECT CAST(user_id AS VARCHAR) AS key, event_id, {_WHEN}, allowed, retry_after, CAST(len(hits) AS DOUBLE) AS used FROM r""")
def sliding_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: at most 3 requests per trailing hour (the 60 s window is
    nearly empty on this data); denied requests are not counted."""
    ev = S.file_stream(spark, sf_dir, "events")
    d = S.sliding_rate_limit(ev, "user_id", "ts", "event_id", limit=3, seconds=3600)
    return _told(S.run_available_now(d, "ratelimit"))


_WEIGHT = "CASE event_type WHEN 'view' THEN 2 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 5 ELSE 1 END"


@query("session_budget", oracle=f"""
WITH RECURSIVE e AS (SELECT user_id, event_id, ts, {_WEIGHT} AS w, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
  r AS (SELECT user_id, rn, event_id, ts, w <= 50 AS allowed, CASE WHEN w <= 50 THEN w ELSE 0 END AS spent FROM e WHERE rn = 1
        UNION ALL
        SELECT user_id, rn, event_id, ts, had + w <= 50, CASE WHEN had + w <= 50 THEN had + w ELSE had END
        FROM (SELECT e.*, CASE WHEN e.ts - r.ts > INTERVAL 24 HOURS THEN 0 ELSE r.spent END AS had FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1))
SELECT CAST(user_id AS VARCHAR) AS key, event_id, {_WHEN}, allowed, CAST(0 AS BIGINT) AS retry_after, CAST(spent AS DOUBLE) AS used FROM r""")
def session_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per session (user, until a day without a request): weighted budget of 50
    (chat 1, hybrid 2, sandbox 2, autopilot 5)."""
    ev = S.file_stream(spark, sf_dir, "events")
    d = S.budget(ev, F.col("user_id"), "ts", "event_id", S.endpoint_weight(_endpoint(F.col("event_type"))), 50.0)
    return _told(S.run_available_now(d, "budget"))


@query("daily_user_budget", oracle=f"""
WITH RECURSIVE e AS (SELECT user_id, event_id, ts, strftime(ts, '%Y-%m-%d') AS day, {_WEIGHT} AS w,
                            row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS rn FROM events),
  r AS (SELECT user_id, day, rn, event_id, ts, w <= 10 AS allowed, CASE WHEN w <= 10 THEN w ELSE 0 END AS spent FROM e WHERE rn = 1
        UNION ALL
        SELECT e.user_id, e.day, e.rn, e.event_id, e.ts, spent + w <= 10, CASE WHEN spent + w <= 10 THEN spent + w ELSE spent END
        FROM r JOIN e ON e.user_id = r.user_id AND e.day = r.day AND e.rn = r.rn + 1)
SELECT user_id || '|' || day AS key, event_id, {_WHEN}, allowed, CAST(0 AS BIGINT) AS retry_after, CAST(spent AS DOUBLE) AS used FROM r""")
def daily_user_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per (user, UTC day): weighted budget of 10."""
    ev = S.file_stream(spark, sf_dir, "events")
    d = S.daily_budget(ev, "user_id", "ts", "event_id", S.endpoint_weight(_endpoint(F.col("event_type"))), 10.0)
    return _told(S.run_available_now(d, "daily"))


@query("stream_mask", oracle=f"SELECT conv_id, turn, role, {SQL_MASKED} AS text FROM conversations")
def stream_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns masked as whole rows before they leave the stream
    (a PII value split across tokens cannot escape)."""
    c = S.file_stream(spark, sf_dir, "conversations")
    m = P.mask_pii(c.select("conv_id", "turn", "role", "text"), ["text"])
    return S.run_available_now(m, "mask")


@query("stream_upsert_orders", oracle="""
WITH so AS (SELECT o.*, 'shop-' || c_nationkey AS connection_id FROM orders o JOIN customer ON o_custkey = c_custkey)
SELECT connection_id, CAST(o_orderkey AS VARCHAR) AS marketplace_order_id,
       CASE WHEN o_orderdate >= TIMESTAMP '1995-07-01' THEN upper(CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'P' THEN 'shipped' ELSE 'pending' END)
            ELSE CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'P' THEN 'shipped' ELSE 'pending' END END AS status,
       round(o_totalprice, 2) AS total_amount,
       CASE WHEN o_orderdate >= TIMESTAMP '1995-07-01' THEN 1 ELSE 0 END AS updated_at
FROM so""")
def stream_upsert_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order feed arriving in two pulls (the earlier one, then an overlapping one
    with refreshed statuses); each pull is one run of the same stream, which
    resumes at its checkpoint and upserts by (connection_id, marketplace_order_id)."""
    from ..operators import commerce as C
    from ..session import Tables, materialize
    from .q_commerce import shopify_raw
    n = C.normalize_orders(shopify_raw(Tables(spark, sf_dir)), "shopify", keep=("connection_id", "ix"))
    feed_dir = S.scratch(spark, "feed")
    ts = F.col("order_date")
    n = materialize(n.select("connection_id", "marketplace_order_id", "status", "total_amount", "ix", "order_date"), "orders")
    first = n.where(ts < F.lit("1996-01-01").cast("timestamp"))
    second = n.where(ts >= F.lit("1995-07-01").cast("timestamp")).withColumn("status", F.upper("status"))
    cols = ["connection_id", "marketplace_order_id", "status", "total_amount", "ix"]
    table = S.scratch(spark, "orders_table")
    for pull in (first, second):
        pull.select(*cols).write.mode("append").parquet(feed_dir)
        stream = spark.readStream.schema(spark.read.parquet(feed_dir).schema).parquet(feed_dir)
        out = S.stream_upsert(stream, table, ["connection_id", "marketplace_order_id"], "ix")
    return out.select("connection_id", "marketplace_order_id", "status", F.round("total_amount", 2).alias("total_amount"),
                      F.col("updated_at").cast("int").alias("updated_at"))
