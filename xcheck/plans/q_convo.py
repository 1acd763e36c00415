"""Conversation queries over ``conversations``: user/assistant turns are the
messages; a ``system`` turn is the stored summary of an earlier compression.
Conversations hold at most 8 turns, so thresholds are parameters (4 new
messages, keep 2) instead of 20 / 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import convo as C
from ..session import Tables
from .registry import query

THRESHOLD, KEEP = 4, 2


def _msgs(t: Tables) -> DataFrame:
    return t.conversations.where(F.col("role") != "system")


def _summaries(t: Tables) -> DataFrame:
    return t.conversations.where(F.col("role") == "system").groupBy("conv_id").agg(
        F.max_by("text", "turn").alias("summary"))


_MSGS = "(SELECT * FROM conversations WHERE role <> 'system')"


@query("recent_window", oracle=f"""
SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM {_MSGS})
WHERE r <= 10""")
def recent_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.recent_window(_msgs(Tables(spark, sf_dir)), 10).select("conv_id", "turn", "role")


@query("needs_compression", oracle=f"""
SELECT m.conv_id, count(*) AS total,
       count(*) - coalesce(max(s.count_at_compression), 0) >= {THRESHOLD} AS needs_compression
FROM {_MSGS} m LEFT JOIN (SELECT conv_id, 0 AS count_at_compression FROM conversations WHERE role = 'system' GROUP BY conv_id) s
USING (conv_id) GROUP BY m.conv_id""")
def needs_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions: conversations with a stored summary; it was written at turn 0,
    so the count at compression is 0 messages."""
    t = Tables(spark, sf_dir)
    sessions = _summaries(t).select("conv_id", F.lit(0).alias("count_at_compression"))
    return C.needs_compression(_msgs(t), sessions, THRESHOLD)


@query("compression_input", oracle=f"""
WITH m AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM {_MSGS})
SELECT conv_id, left(string_agg(upper(role) || ': ' || left(text, 500), chr(10) ORDER BY i), 8000) AS history_text
FROM m WHERE i <= n - {KEEP} GROUP BY conv_id""")
def compression_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.compression_input(_msgs(Tables(spark, sf_dir)), KEEP)


@query("compressed_context", oracle=f"""
WITH s AS (SELECT conv_id, arg_max(text, turn) AS summary FROM conversations WHERE role = 'system' GROUP BY conv_id),
  m AS (SELECT m.*, s.conv_id IS NOT NULL AS has, row_number() OVER (PARTITION BY m.conv_id ORDER BY turn DESC) AS r
        FROM {_MSGS} m LEFT JOIN s USING (conv_id))
SELECT conv_id, -1 AS position, 'system' AS role, 'Earlier conversation summary:' || chr(10) || summary AS text FROM s
UNION ALL SELECT conv_id, turn AS position, role, text FROM m WHERE NOT has OR r <= {KEEP}""")
def compressed_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return C.compressed_context(_msgs(t), _summaries(t), KEEP)


@query("history_window", oracle=f"""
WITH r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM {_MSGS}) WHERE k <= 4),
  c AS (SELECT conv_id, string_agg(role || ': ' || left(text, 200), chr(10) ORDER BY turn) AS context FROM r GROUP BY conv_id),
  a AS (SELECT conv_id, left(arg_max(text, turn), 300) AS last_answer FROM {_MSGS} WHERE role = 'assistant' GROUP BY conv_id)
SELECT conv_id, context, last_answer FROM c LEFT JOIN a USING (conv_id)""")
def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV-chat flavour: last 4 turns at 200 characters + last answer (300)."""
    return C.history_window(_msgs(Tables(spark, sf_dir)), 4, 200)


@query("conversation_export", oracle=f"""
SELECT conv_id, turn AS position, chr(10) || '--- ' || CASE WHEN role = 'user' THEN 'You' ELSE 'Assistant' END || ' ---' || chr(10) || text || chr(10) AS block
FROM {_MSGS}""")
def conversation_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.export_blocks(_msgs(Tables(spark, sf_dir)))


@query("stream_compression_trigger", oracle=f"""
SELECT conv_id, turn, i AS message_count FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM {_MSGS})
WHERE i % {THRESHOLD} = 0""")
def stream_compression_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch twin: the message at which each compression fires (every 4th)."""
    return C.compression_triggers(_msgs(Tables(spark, sf_dir)), THRESHOLD)


@query("turn_count", oracle=f"SELECT conv_id, count(*) AS turns FROM {_MSGS} GROUP BY conv_id")
def turn_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.turn_count(_msgs(Tables(spark, sf_dir)), "conv_id")
