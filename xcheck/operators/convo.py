"""Conversation windows, compression triggers and inputs, exports.

Ordering is explicit (``turn``). Anything that would turn a whole conversation
into one value is bounded first: the compression input is capped at 8000
characters, so only the first ``8000 // 3 + 1`` lines can reach it and the
rest are filtered out before the ordered ``collect_list``; exports are kept as
ordered rows (one block per message).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# FIXED VALUES — compression thresholds and text caps; speaker labels of the
# plain-text export (the assistant label is a neutral name of our own)
EXPORT_USER = "You"
EXPORT_ASSISTANT = "Assistant"
COMPRESSION_THRESHOLD = 20
RECENT_WINDOW = 10
LINE_CHARS = 500
INPUT_CHARS = 8000


def recent_window(msgs: DataFrame, n: int = RECENT_WINDOW, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Last ``n`` messages per conversation (chronological by ``order``)."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return msgs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def needs_compression(msgs: DataFrame, sessions: DataFrame, threshold: int = COMPRESSION_THRESHOLD,
                      key: str = "conv_id") -> DataFrame:
    """Conversations whose messages since the last compression reach ``threshold``."""
    tot = msgs.groupBy(key).agg(F.count(F.lit(1)).alias("total"))
    j = tot.join(sessions.select(key, "count_at_compression"), key, "left")
    since = F.col("total") - F.coalesce("count_at_compression", F.lit(0))
    return j.select(key, "total", (since >= threshold).alias("needs_compression"))


def compression_input(msgs: DataFrame, keep: int = RECENT_WINDOW, key: str = "conv_id", order: str = "turn",
                      role: str = "role", text: str = "text") -> DataFrame:
    """All but the last ``keep`` messages as ``ROLE: first 500 chars`` lines,
    newline-joined, cut at 8000 characters; nothing when total <= keep.

    Only the first ``8000 // 3 + 1`` messages of a conversation can reach the
    cut, so the row numbering is a top-k (limited map-side) and the message
    count is a plain aggregation: a very long conversation is never sorted
    whole."""
    cap = INPUT_CHARS // 3 + 1
    n = msgs.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    pos = Window.partitionBy(key).orderBy(order)
    head = msgs.withColumn("_i", F.row_number().over(pos)).where(F.col("_i") <= cap)
    m = head.join(n, key).where(F.col("_i") <= F.col("_n") - keep)
    line = F.concat(F.upper(role), F.lit(": "), F.substring(text, 1, LINE_CHARS))
    agg = m.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_i", line.alias("l")))).alias("_ls"))
    return agg.select(key, F.substring(F.array_join(F.transform("_ls", lambda x: x["l"]), "\n"), 1, INPUT_CHARS)
                      .alias("history_text"))


def compressed_context(msgs: DataFrame, summaries: DataFrame, keep: int = RECENT_WINDOW, key: str = "conv_id",
                       order: str = "turn") -> DataFrame:
    """With a summary: one system row (position 0) plus the last ``keep``
    messages; without: every message. Rows: key, position, role, text.
    Conversations without a summary pass through without any sort; the
    others take a top-``keep`` (limited map-side)."""
    has = summaries.select(key, "summary")
    plain = msgs.join(has.select(key), key, "left_anti")
    summed = msgs.join(has.select(key), key, "left_semi")
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    last = summed.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep).drop("_r")
    cols = [key, F.col(order).cast("long").alias("position"), "role", "text"]
    intro = has.select(key, F.lit(-1).cast("long").alias("position"), F.lit("system").alias("role"),
                       F.concat(F.lit("Earlier conversation summary:\n"), F.col("summary")).alias("text"))
    return intro.unionByName(plain.select(*cols)).unionByName(last.select(*cols))


def history_window(msgs: DataFrame, n: int, width: int | None = None, last_chars: int = 300,
                   key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Last ``n`` turns as context (optionally cut to ``width`` chars each) and
    the latest assistant text (first ``last_chars`` characters)."""
    ctx = recent_window(msgs, n, key, order)
    txt = F.substring("text", 1, width) if width else F.col("text")
    lines = (ctx.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, F.concat(F.col("role"), F.lit(": "), txt)
                                                                        .alias("l")))).alias("_c"))
             .select(key, F.array_join(F.transform("_c", lambda x: x["l"]), "\n").alias("context")))
    last = (msgs.where(F.col("role") == "assistant").groupBy(key)
            .agg(F.substring(F.max_by("text", order), 1, last_chars).alias("last_answer")))
    return lines.join(last, key, "left")


def export_blocks(msgs: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Plain-text export as ordered blocks: ``--- You ---`` / ``--- Assistant ---``."""
    who = F.when(F.col("role") == "user", EXPORT_USER).otherwise(EXPORT_ASSISTANT)
    return msgs.select(key, F.col(order).alias("position"),
                       F.concat(F.lit("\n--- "), who, F.lit(" ---\n"), F.col("text"), F.lit("\n")).alias("block"))


def compression_triggers(msgs: DataFrame, every: int = COMPRESSION_THRESHOLD, key: str = "conv_id",
                         order: str = "turn") -> DataFrame:
    """Messages at which a compression fires: every ``every``-th message."""
    w = Window.partitionBy(key).orderBy(order)
    return (msgs.withColumn("_i", F.row_number().over(w)).where(F.col("_i") % every == 0)
            .select(key, order, F.col("_i").alias("message_count")))


def turn_count(history: DataFrame, key: str) -> DataFrame:
    return history.groupBy(key).agg(F.count(F.lit(1)).alias("turns"))
