"""Structured Streaming operators.

Streams read files incrementally (``readStream`` with an explicit schema),
carry event time as ``timestamp``, and run with ``availableNow`` so a backlog
is processed in bounded micro-batches and the query stops when caught up.
Every query writes through a checkpoint in the session's checkpoint folder; the
streaming upsert keeps its checkpoint with its table and resumes there, the other
registered queries are one-off runs with a fresh checkpoint.

Stateful quota folds (sliding rate limit, session / daily budgets) are
sequential per key by definition. The sliding limit and the session budget are
``transformWithStateInPandas`` processors: between micro-batches a key has the
times of its accepted requests inside the window (list state), or the amount
spent and the time of the last request (value state), and an event-time timer
that clears them once the watermark says that they cannot matter any more. One
key's rows of one micro-batch are sorted together, so bound the batches
(``max_files``) where a key may be hot.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import checkpoint_dir, fs_is_dir

# FIXED VALUES — endpoint weights for budgets (default 1)
ENDPOINT_WEIGHTS = {"chat": 1, "hybrid": 2, "sandbox": 2, "autopilot": 5}


def scratch(spark: SparkSession, what: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/xcheck-stream/{what}-{uuid.uuid4().hex}"


def file_stream(spark: SparkSession, folder: str, name: str, max_files: int | None = None) -> DataFrame:
    """Stream the Parquet files of one table (``name.parquet`` inside ``folder``)."""
    target = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(target).schema
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    if fs_is_dir(spark, target):       # a table folder of part files
        df = r.parquet(target)
    else:                              # a single file next to other tables
        df = r.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return df.select(*[F.col(f.name).cast(T.TimestampType()).alias(f.name)
                       if isinstance(f.dataType, T.TimestampNTZType) else F.col(f.name) for f in schema.fields])


def run_available_now(stream: DataFrame, what: str, mode: str = "append",
                      partition_by: list[str] | None = None) -> DataFrame:
    """Run a streaming query until it has consumed everything available,
    writing Parquet under the checkpoint folder; return the written table."""
    spark = stream.sparkSession
    base = scratch(spark, what)
    w = (stream.writeStream.format("parquet").outputMode(mode)
         .option("checkpointLocation", f"{base}/_checkpoint").option("path", f"{base}/out")
         .trigger(availableNow=True))
    if partition_by:
        w = w.partitionBy(*partition_by)
    q = w.start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def usage_by_window(events: DataFrame, ts: str = "ts", by: str = "event_type", window: str = "1 hour",
                    watermark: str = "10 minutes") -> DataFrame:
    """Event counts per closed time window and type; rows later than the
    watermark are dropped, windows are emitted once closed (append mode)."""
    return (events.withWatermark(ts, watermark)
            .groupBy(F.window(ts, window).alias("w"), by)
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), by, "n"))


def financials_by_day(orders: DataFrame, ts: str, amount: str, by: str, watermark: str = "1 day") -> DataFrame:
    return (orders.withWatermark(ts, watermark)
            .groupBy(F.window(ts, "1 day").alias("w"), by)
            .agg(F.sum(amount).alias("revenue"), F.count(F.lit(1)).alias("orders"))
            .select(F.col("w.start").alias("day"), by, "revenue", "orders"))


# ---------------------------------------------------------------------------
# Stateful quota folds
# ---------------------------------------------------------------------------

_DAY_MS = 86_400_000
_DECISION = "key string, event_id long, ts timestamp, allowed boolean, retry_after long, used double"


_MICRO = 1_000_000
_COLUMNS = ["key", "event_id", "ts", "allowed", "retry_after", "used"]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Fold(StatefulProcessor):
    """One decision per request, in order of time and id; a timer clears the
    key's state ``keep_ms`` after its last request."""

    keep_ms: int

    def _ordered(self, rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(list(rows)).sort_values(["ts", "event_id"])

    def _keep_until(self, last_us: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        self.handle.registerTimer(last_us // 1000 + self.keep_ms + 1)

    def _decided(self, key, frame: pd.DataFrame, out: list) -> pd.DataFrame:
        allowed, retry, used = zip(*out)
        return pd.DataFrame({"key": key[0], "event_id": frame["event_id"].to_numpy(), "ts": frame["ts"].to_numpy(),
                             "allowed": list(allowed), "retry_after": list(retry), "used": [float(u) for u in used]})[_COLUMNS]

    def close(self) -> None:
        pass


def _micros(ts: pd.Series) -> list[int]:
    return ts.astype("datetime64[us]").astype("int64").tolist()


class SlidingLimit(_Fold):
    """At most ``limit`` accepted requests in the trailing ``seconds``."""

    def __init__(self, limit: int, seconds: int):
        self.limit, self.window, self.keep_ms = limit, seconds * _MICRO, seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hits = handle.getListState("hits", "t long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame, hits, out = self._ordered(rows), [t[0] for t in self.hits.get()] if self.hits.exists() else [], []
        times = _micros(frame["ts"])
        for now in times:
            hits = [h for h in hits if h >= now - self.window]
            if len(hits) >= self.limit:
                out.append((False, (hits[0] + self.window - now) // _MICRO + 1, len(hits)))
            else:
                hits.append(now)
                out.append((True, 0, len(hits)))
        self.hits.put([(h,) for h in hits])
        self._keep_until(times[-1])
        yield self._decided(key, frame, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.hits.clear()
        return iter([])


class SessionBudget(_Fold):
    """Weights are charged while the session's total stays within ``cap``; a
    session ends ``idle`` seconds after its last request."""

    def __init__(self, cap: float, idle: int):
        self.cap, self.idle, self.keep_ms = cap, idle * _MICRO, idle * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spent = handle.getValueState("spent", "spent double, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame, out = self._ordered(rows), []
        spent, last = self.spent.get() if self.spent.exists() else (0.0, None)
        for now, weight in zip(_micros(frame["ts"]), frame["weight"].tolist()):
            if last is not None and now - last > self.idle:
                spent = 0.0
            last = now
            ok = spent + weight <= self.cap
            spent += weight if ok else 0.0
            out.append((ok, 0, spent))
        self.spent.update((float(spent), int(last)))
        self._keep_until(last)
        yield self._decided(key, frame, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.spent.clear()
        return iter([])


def _folded(rows: DataFrame, fold: _Fold, late: str) -> DataFrame:
    """Decisions of a fold over (key, event_id, ts, ...). Such folds need the
    RocksDB state store, which is set for the session if none is named."""
    conf = rows.sparkSession.conf
    if "RocksDB" not in conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return rows.withWatermark("ts", late).groupBy("key").transformWithStateInPandas(fold, _DECISION, "append", "EventTime")


USER_CELLS = 64         # groups of a day's users by hash


def _daily_budget_fn(cap: float, lateness_ms: int):
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        day = key[0]
        if state.hasTimedOut:
            state.remove()
            return
        spent = dict(zip(*state.get)) if state.exists else {}
        frames = [p for p in pdfs]
        if not frames:
            return
        pdf = pd.concat(frames).sort_values(["ts", "event_id"])
        names, allowed, used = [], [], []
        for user, w in zip(pdf["key"].tolist(), pdf["weight"].tolist()):
            had = spent.get(user, 0.0)
            ok = had + w <= cap
            spent[user] = had = had + w if ok else had
            names.append(f"{user}|{day}")
            allowed.append(ok)
            used.append(had)
        state.update((list(spent), [float(s) for s in spent.values()]))
        closes = int(pd.Timestamp(day, tz="UTC").timestamp() * 1000) + _DAY_MS + lateness_ms
        state.setTimeoutTimestamp(max(closes, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": names, "event_id": pdf["event_id"].to_numpy(), "ts": pdf["ts"].to_numpy(),
                            "allowed": allowed, "retry_after": 0, "used": used})[_COLUMNS]
    return fn


def daily_budget(events: DataFrame, user: str, ts: str, event_id: str, weight: Column, cap: float,
                 late_days: int = 2) -> DataFrame:
    """Per (user, UTC day) budget: an event is charged to its own day, whatever
    order days arrive in. The state of a day (the amount spent) goes once the
    watermark, ``late_days`` behind the newest event, has passed it by as much
    again; events behind the watermark are left out, as in any windowed stream.

    A day's users are dealt by hash: one call of the fold takes all users of a
    cell, with what each has spent, since a call per (user, day) with its handful
    of events costs far more than the events."""
    ev = (events.withWatermark(ts, f"{late_days} days")
          .select(F.col(user).cast("string").alias("key"), F.date_format(ts, "yyyy-MM-dd").alias("day"),
                  F.col(event_id).alias("event_id"), F.col(ts).alias("ts"), weight.cast("double").alias("weight")))
    ev = ev.withColumn("cell", F.pmod(F.xxhash64("key"), F.lit(USER_CELLS)))
    return ev.groupBy("day", "cell").applyInPandasWithState(
        _daily_budget_fn(cap, late_days * _DAY_MS), _DECISION, "users array<string>, spent array<double>", "append",
        GroupStateTimeout.EventTimeTimeout)


def sliding_rate_limit(events: DataFrame, key: str, ts: str, event_id: str, limit: int,
                       seconds: int = 60, late: str = "1 day") -> DataFrame:
    """Per key: allow up to ``limit`` requests per trailing ``seconds``; denied
    requests are not counted; a denial carries retry-after = oldest + window -
    now, + 1 second. Requests more than ``late`` behind the newest are left out;
    a key's state goes once the watermark has passed its last request's window."""
    ev = events.select(F.col(key).cast("string").alias("key"), F.col(event_id).alias("event_id"), F.col(ts).alias("ts"))
    return _folded(ev, SlidingLimit(limit, seconds), late)


def budget(events: DataFrame, key: Column, ts: str, event_id: str, weight: Column, cap: float,
           idle_hours: int = 24, late: str = "1 day") -> DataFrame:
    """Per key: charge each request's weight while the running total stays
    within ``cap``; a request that does not fit is refused and not charged, so
    a cheaper later one may still fit. ``idle_hours`` without a request end the
    session: the next one starts at nothing, and the state goes."""
    ev = events.select(key.cast("string").alias("key"), F.col(event_id).alias("event_id"), F.col(ts).alias("ts"),
                       weight.cast("double").alias("weight"))
    return _folded(ev, SessionBudget(cap, idle_hours * 3600), late)


def endpoint_weight(endpoint) -> Column:
    m = F.create_map(*[F.lit(x) for kv in ENDPOINT_WEIGHTS.items() for x in kv])
    return F.coalesce(F.try_element_at(m, endpoint), F.lit(1))


# --- Python references used by tests (brute force, one key at a time) -------

def rate_limit_reference(times: list[float], limit: int, seconds: int) -> list[bool]:
    hits, out = [], []
    for t in times:
        hits = [h for h in hits if h >= t - seconds]
        if len(hits) >= limit:
            out.append(False)
        else:
            hits.append(t)
            out.append(True)
    return out


def budget_reference(weights: list[float], cap: float) -> list[bool]:
    spent, out = 0.0, []
    for w in weights:
        if spent + w > cap:
            out.append(False)
        else:
            spent += w
            out.append(True)
    return out



# ---------------------------------------------------------------------------
# Streaming upsert: appended batches, newest row per key on read
# ---------------------------------------------------------------------------

BUCKETS = 16            # folders of a table by key hash


def upserted(spark: SparkSession, table: str, keys: list[str]) -> DataFrame:
    """The newest row of every key, by batch number (``updated_at``)."""
    rows = spark.read.parquet(f"{table}/rows").drop("bucket", "batch")
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "updated_at").alias("_r")).select(*keys, "_r.*")


def stream_upsert(feed: DataFrame, table: str, keys: list[str], order_col: str, what: str = "upsert") -> DataFrame:
    """Each micro-batch is appended to ``table`` as its newest row per key (latest
    ``order_col``), in folders by key hash; ``updated_at`` is the number of the
    batch. Readers take the newest row per key (``upserted``): a batch writes what
    it brings, never the whole table.

    The checkpoint lies beside the rows (``_checkpoint/<what>``), so a later call
    goes on where the last one ended. A batch that was cut off is written again
    into the same folder, so it counts once."""
    spark = feed.sparkSession

    def apply(batch: DataFrame, epoch: int) -> None:
        others = [c for c in batch.columns if c not in (*keys, order_col)]
        newest = batch.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(order_col)).alias("_r")).select(*keys, "_r.*")
        (newest.withColumn("updated_at", F.lit(epoch).cast("long")).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)))
         .write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/rows/batch={what}-{epoch}"))

    q = (feed.writeStream.foreachBatch(apply).option("checkpointLocation", f"{table}/_checkpoint/{what}")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return upserted(spark, table, keys)
