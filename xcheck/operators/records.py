"""Records around a conversation: exports with sources, appended history, stored
result rows, files of a session, workspace, semantic chunks, error classes and
explanations of a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules
from ..session import materialize, settings
from . import chunking
from .housekeeping import breaks_at, neighbour_distances

# FIXED VALUES — ordered rules (any of the phrases, in lower case -> message); the first that holds wins
ERROR_RULES = [
    (["password authentication failed", "access denied", "login failed"], "Authentication failed. Please check your username and password."),
    (["permission denied", "insufficient privilege"], "Permission denied. Your database user does not have read access to the requested tables."),
    (["could not connect", "connection refused", "no route to host", "name or service not known", "getaddrinfo failed"],
     "Cannot reach the database server. Please verify the host, port, and that the server accepts connections from this IP."),
    (["connection timed out", "connect_timeout"], "Connection timed out. The database server did not respond within 10 seconds."),
    (["ssl&required", "ssl&unsupported"], "SSL configuration mismatch. Check whether the server requires or rejects SSL connections."),
    (["relation", "does not exist", "unknown table", "no such table"], "Table not found. The schema may have changed — try refreshing the schema."),
    (["column", "unknown column", "no such column"], "Column not found. The table structure may have changed — try refreshing the schema."),
    (["syntax error"], "SQL syntax error. The generated query has a syntax problem — try rephrasing your question."),
    (["canceling statement due to statement timeout"], "Query exceeded the 15-second time limit. Try a simpler question or add filters."),
    (["deadlock"], "Query hit a deadlock. Please try again in a moment."),
]
AZURE_RULE = ("snapshot isolation", "Azure SQL snapshot isolation is not enabled on this database.")
ERROR_CHARS = 200
# (phrases in upper case, what is said of a query that has one)
EXPLAIN_RULES = [(["GROUP BY"], "groups results"), (["ORDER BY"], "orders by a column"), (["JOIN"], "joins multiple tables"), (["WHERE"], "filters rows by a condition"),
                 (["COUNT(", "SUM(", "AVG(", "MAX(", "MIN("], "computes aggregates")]
SEMANTIC_TYPES = ["financial", "legal"]
SENTENCE_END = r"(?<=[.?!])\s+"
VECTOR_PARTS = 4        # parts of the documents whose vectors are on disk one after the other
# a table's rows of one document meet in one task, for the join by (document, place) as for the window
# over a document; a part's shuffle files go when it is written
_BY_DOCUMENT = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def classify_error(message, dialect) -> Column:
    """User-facing message of a database error; ``a&b`` in a rule asks for both."""
    m, d = (F.col(c) if isinstance(c, str) else c for c in (message, dialect))
    low, out = F.lower(m), None
    for phrases, text in ERROR_RULES:
        hit = F.lit(False)
        for p in phrases:
            both = F.lit(True)
            for part in p.split("&"):
                both = both & low.contains(part)
            hit = hit | both
        out = F.when(hit, text) if out is None else out.when(hit, text)
    out = out.when((d == "azure_sql") & low.contains(AZURE_RULE[0]), AZURE_RULE[1])
    return out.otherwise(F.concat(F.lit("Database error: "), F.left(m, F.lit(ERROR_CHARS))))


def explain_select(sql, tables) -> Column:
    """One sentence on what a query does; ``tables`` is an array of names."""
    s, t = (F.col(c) if isinstance(c, str) else c for c in (sql, tables))
    parts = []
    for phrases, text in EXPLAIN_RULES:
        hit = F.lit(False)
        for p in phrases:
            hit = hit | F.upper(s).contains(p)
        parts.append(F.when(hit, F.lit(text)))
    said = F.array_join(F.array_compact(F.array(*parts)), ", ")
    names = F.when(F.size(t) > 0, F.array_join(t, ", ")).otherwise(F.lit("the database"))
    return F.concat(F.lit("This query "), F.when(said != "", F.concat(said, F.lit(" from"))).otherwise(F.lit("queries")), F.lit(" "), names, F.lit("."))


def _cited(messages: DataFrame, sources: DataFrame, key: str, order: str) -> DataFrame:
    """Messages with their sources, (source, page) in order of first mention: one message's at a time."""
    per = (sources.groupBy(key, order).agg(F.array_sort(F.collect_list(F.struct("ix", "source", "page"))).alias("_s"))
           .select(key, order, F.transform("_s", lambda s: F.struct(s["source"].alias("source"), s["page"].alias("page"))).alias("sources")))
    none = F.array().cast("array<struct<source: string, page: bigint>>")
    return messages.join(per, [key, order], "left").withColumn("sources", F.coalesce("sources", none))


def export_json(messages: DataFrame, sources: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """(key, position, message): each message as JSON with its sources; rows stay rows, in order of position."""
    m = _cited(messages, sources, key, order)
    body = F.to_json(F.struct("role", F.col("text").alias("content"), "sources"), {"ignoreNullFields": "false"})
    return m.select(key, F.col(order).alias("position"), body.alias("message"))


def export_markdown(messages: DataFrame, sources: DataFrame, sessions: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """(key, position, block): a head per session (``sessions``: key, persona,
    files) at position -1, then a block per message with its sources."""
    head = F.concat(F.lit("# Conversation Export\n\n**Session ID:** "), F.col(key).cast("string"), F.lit("\n**Persona:** "), "persona",
                    F.lit("\n**Files:** "), F.array_join("files", ", "), F.lit("\n\n---\n"))
    who = F.when(F.col("role") == "user", "**You**").otherwise("**Assistant**")
    lines = F.array_join(F.transform("sources", lambda s: F.concat(F.lit("- "), s["source"], F.lit(", Page "), s["page"].cast("string"), F.lit("\n"))), "")
    cited = F.when(F.size("sources") > 0, F.concat(F.lit("\n**Sources:**\n"), lines)).otherwise("")
    body = F.concat(F.lit("\n### "), who, F.lit("\n\n"), "text", F.lit("\n"), cited, F.lit("\n---\n"))
    blocks = _cited(messages, sources, key, order).select(key, F.col(order).cast("long").alias("position"), body.alias("block"))
    return sessions.select(key, F.lit(-1).cast("long").alias("position"), head.alias("block")).unionByName(blocks)


def history_append(history: DataFrame, folder: str, vector: str = "embedding") -> DataFrame:
    """Append answered questions (``id`` and any columns, with the question's
    vector) to ``<folder>/history`` and ``<folder>/vectors`` and read all of both
    back, joined by id. An id that is appended again (a retry) is read once."""
    spark = history.sparkSession
    history.drop(vector).write.mode("append").parquet(f"{folder}/history")
    history.select("id", vector).write.mode("append").parquet(f"{folder}/vectors")
    rows, vectors = (spark.read.parquet(f"{folder}/{part}").dropDuplicates(["id"]) for part in ("history", "vectors"))
    return rows.join(vectors, "id")


def snapshot_rows(df: DataFrame, name: str, folder: str, order: list[str], cap: int = 500) -> DataFrame:
    """Store the first ``cap`` rows by ``order`` as JSON, beside the row count of
    all: (name, ix, row, row_count) as read back."""
    w = Window.orderBy("_place")
    first = df.orderBy(*order).limit(cap).withColumn("_place", F.monotonically_increasing_id())
    stored = first.select(F.lit(name).alias("name"), (F.row_number().over(w) - 1).cast("long").alias("ix"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("row"))
    stored.withColumn("row_count", F.lit(df.count())).write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.parquet(f"{folder}/{name}")


def files_summary(files: DataFrame, session: str, name: str = "filename", pages: str = "pages", size: str = "size") -> DataFrame:
    """(session, file_count, pages, size, unread): files without text could not be read and count apart."""
    ok = F.col(pages).isNotNull()
    return files.groupBy(session).agg(F.count_if(ok).alias("file_count"), F.coalesce(F.sum(F.when(ok, F.col(pages))), F.lit(0)).cast("long").alias("pages"),
                                      F.coalesce(F.sum(F.when(ok, F.col(size))), F.lit(0)).cast("long").alias("size"), F.count_if(~ok).alias("unread"))


def workspace(sessions: DataFrame, connections: DataFrame, user: str, limit: int = 20) -> DataFrame:
    """Each user's newest sessions and newest connections: (user, kind, id, created_at, ix)."""
    both = (sessions.select(user, F.lit("session").alias("kind"), "id", "created_at")
            .unionByName(connections.select(user, F.lit("connection").alias("kind"), "id", "created_at")))
    w = Window.partitionBy(user, "kind").orderBy(F.desc("created_at"), F.desc("id"))
    return both.withColumn("ix", F.row_number().over(w)).where(F.col("ix") <= limit)


def ingest_results(feed: DataFrame, cache: DataFrame, key: str, text_col: str = "text", min_chars: int = 100) -> DataFrame:
    """Every filing with its outcome: (columns of ``feed`` but the text, status, message)."""
    known = cache.select(F.col(key).alias("_k")).distinct()
    size = F.length(F.trim(F.regexp_replace(F.coalesce(text_col, F.lit("")), r"\s+", " ")))
    j = feed.join(known, feed[key] == F.col("_k"), "left")
    status = F.when(F.col("_k").isNotNull(), "cached").when(size < min_chars, "failed").otherwise("ingested")
    message = F.when(status == "failed", F.concat(F.lit("only "), size.cast("string"), F.lit(" characters of text")))
    return j.select(*[c for c in feed.columns if c != text_col], status.alias("status"), message.alias("message"))


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ix, sentence): cut after full stop, question or exclamation mark before white space."""
    return docs.select(id_col, F.posexplode(F.split(text_col, SENTENCE_END)).alias("ix", "sentence"))


def chunk_semantic(docs: DataFrame, vectors: DataFrame, id_col: str = "doc_id", text_col: str = "text", type_col: str = "doc_type",
                   pct: float = 0.85, size: int = rules.CHUNK_SIZE, overlap: int = rules.CHUNK_OVERLAP) -> DataFrame:
    """(id, chunk_ix, chunk, method). Documents of a semantic type are cut where
    the distance between neighbouring sentences is above the document's ``pct``
    percentile; ``vectors`` is (id, ix, unit) per sentence. The others, and those
    with a sentence that has no vector, are cut by length."""
    semantic = docs.where(F.col(type_col).isin(SEMANTIC_TYPES))
    # vectors move up to here only, once and a part at a time: what follows reads the written numbers and sentences
    parts = None
    with settings(docs.sparkSession, _BY_DOCUMENT):
        for k in range(VECTOR_PARTS):
            own = F.pmod(F.xxhash64(id_col), F.lit(VECTOR_PARTS)) == k
            said, known = sentences(semantic.where(own), id_col, text_col).repartition(id_col), vectors.where(own).repartition(id_col)
            part = neighbour_distances(said.join(known, [id_col, "ix"], "left"), id_col, "ix", "unit")
            part = materialize(part.select(id_col, "ix", "sentence", "dist", F.col("unit").isNull().alias("lacks")), "distances")
            parts = part if parts is None else parts.unionByName(part)
    lacking = parts.where("lacks").select(id_col).distinct()
    able = parts.drop("lacks").join(lacking, id_col, "left_anti")
    cut = breaks_at(able, id_col, "ix", pct)
    joined = (cut.groupBy(id_col, F.col("chunk_id").cast("int").alias("chunk_ix")).agg(F.array_sort(F.collect_list(F.struct("ix", "sentence"))).alias("_s"))
              .select(id_col, "chunk_ix", F.array_join(F.transform("_s", lambda s: s["sentence"]), " ").alias("chunk"), F.lit("semantic").alias("method")))
    rest = docs.join(able.select(id_col).distinct(), id_col, "left_anti")
    by_length = chunking.chunk_recursive(rest, id_col, text_col, size, overlap).withColumn("method", F.lit("length"))
    return joined.unionByName(by_length)
