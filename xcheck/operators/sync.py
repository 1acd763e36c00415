"""Incremental pulls with a stored cursor per (connection, feed).

A run takes, of every connection, the rows from its cursor minus an overlap on:
rows that arrive late, within the overlap, are not lost, and rows pulled again are
the same rows (readers take the newest run per key). Pulled rows and cursor
states are appended to two folders, so a run writes what it pulled and never
rewrites what is there. States: ``syncing`` from the start, then ``idle`` with
the new cursor, or ``error`` with the old one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fs_is_dir

_STATES = "connection_id string, feed string, cursor timestamp, state string, message string, run long, step int"


def cursors(spark: SparkSession, folder: str) -> DataFrame:
    """The newest state of every (connection, feed)."""
    path = f"{folder}/cursors"
    log = spark.read.schema(_STATES).parquet(path) if fs_is_dir(spark, path) else spark.createDataFrame([], _STATES)
    return log.groupBy("connection_id", "feed").agg(F.max_by(F.struct("cursor", "state", "message", "run"), F.struct("run", "step")).alias("s")).select("connection_id", "feed", "s.*")


def stored_rows(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """Every key's row of the newest run."""
    rows = spark.read.parquet(f"{folder}/rows")
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "run").alias("r")).select(*keys, "r.*")


def due_rows(source: DataFrame, states: DataFrame, ts: str, overlap_hours: int) -> DataFrame:
    """Rows of ``source`` (with connection_id and feed) not older than their cursor minus the overlap."""
    have = states.select("connection_id", "feed", "cursor")
    return (source.join(have, ["connection_id", "feed"], "left")
            .where(F.col("cursor").isNull() | (F.col(ts) >= F.col("cursor") - F.make_dt_interval(hours=F.lit(overlap_hours)))).drop("cursor"))


def sync_run(source: DataFrame, folder: str, run: int, ts: str, overlap_hours: int = 24, failures: DataFrame | None = None) -> DataFrame:
    """One run: (connection_id, feed, pulled, cursor, state, message).

    ``source`` is what the connections offer now, with connection_id and feed;
    ``failures`` is (connection_id, feed, message) of those that cannot be read:
    they keep their cursor. A cursor never goes back. A run that broke off may be
    repeated under its number: its rows replace each other by key."""
    spark = source.sparkSession
    before = cursors(spark, folder)
    failed = failures if failures is not None else spark.createDataFrame([], "connection_id string, feed string, message string")
    who = source.select("connection_id", "feed").unionByName(failed.select("connection_id", "feed")).distinct()
    old = who.join(before.select("connection_id", "feed", "cursor"), ["connection_id", "feed"], "left")

    def store(states: DataFrame, step: int) -> None:
        states.withColumn("run", F.lit(run).cast("long")).withColumn("step", F.lit(step)).select(*[c.split()[0] for c in _STATES.split(", ")]).write.mode("append").parquet(f"{folder}/cursors")

    store(old.select("connection_id", "feed", "cursor", F.lit("syncing").alias("state"), F.lit(None).cast("string").alias("message")), 0)
    due = due_rows(source.join(failed, ["connection_id", "feed"], "left_anti"), before, ts, overlap_hours)
    due.withColumn("run", F.lit(run).cast("long")).write.mode("append").parquet(f"{folder}/rows")
    pulled = (spark.read.parquet(f"{folder}/rows").where(F.col("run") == run)
              .groupBy("connection_id", "feed").agg(F.count(F.lit(1)).alias("pulled"), F.max(ts).alias("newest")))
    done = old.join(pulled, ["connection_id", "feed"], "left").join(failed, ["connection_id", "feed"], "left")
    done = done.select("connection_id", "feed", F.coalesce("pulled", F.lit(0)).alias("pulled"), F.greatest("cursor", "newest").alias("cursor"),
                       F.when(F.col("message").isNull(), "idle").otherwise("error").alias("state"), "message")
    store(done, 1)
    now = cursors(spark, folder).where(F.col("run") == run).select("connection_id", "feed", "cursor", "state", "message")
    return now.join(pulled.drop("newest"), ["connection_id", "feed"], "left").withColumn("pulled", F.coalesce("pulled", F.lit(0)))
