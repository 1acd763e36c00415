"""Shared-folder tables: how the operators cut lineage.

Intermediate tables are written as Parquet under the cluster's
``spark.checkpoint.dir`` so that they survive lost executors. Only where the
session names no folder (tests) a fresh temporary one is used.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, its SparkContext's checkpoint
    folder, or (neither is set: a local test) one temporary folder a process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="llm-")
    return _OWN["dir"]


# a writer else looks at its size every 100 rows only, however large they are
_LARGE_ROWS = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1}


def written(df: DataFrame, what: str, large_rows: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: each row is
    computed once and a lost executor costs a re-read, not a re-computation.
    ``large_rows``: rows may hold megabytes, so a writer keeps few of them."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").options(**_LARGE_ROWS if large_rows else {}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int):
    """What is run inside reads Parquet and feeds its Python workers ``rows``
    rows at a time: for rows that are large. As ``shuffles_freed``, for ``written``."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = [spark.conf.get(name) for name in names]
    for name, now in zip(names, before):
        spark.conf.set(name, str(min(rows, int(now)) if int(now) > 0 else rows))
    try:
        yield
    finally:
        for name, was in zip(names, before):
            spark.conf.set(name, was)


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession):
    """What runs inside gives its shuffle files back when it ends, not when the
    driver collects garbage. For frames that are run once, such as ``written``."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def give_back() -> None:
    """Return a worker's freed memory to the system: workers outlive their task
    and would sit on the most they ever used."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):       # not glibc
        pass


def with_results(docs: DataFrame, column: str, compute, fields: list[tuple[str, str]], at_end=None) -> DataFrame:
    """All columns of ``docs`` plus ``fields`` (name, type), which ``compute``
    makes from one Arrow array of ``column``: it yields (first row, last row,
    arrays) piece by piece. No shuffle. Columns travel by position, so any
    names, also clashing ones, are safe; the new names must be free. ``at_end``
    is called when a task has read its last row."""
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    at = docs.columns.index(column)
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields]
                       + [f"r{k} {kind}" for k, (_, kind) in enumerate(fields)])
    labels = [*plain.columns, *[f"r{k}" for k in range(len(fields))]]

    def run(batches):
        for b in batches:
            for lo, hi, arrays in compute(b.column(at)):
                kept = [b.column(k).slice(lo, hi - lo) for k in range(b.num_columns)]
                yield pa.RecordBatch.from_arrays([*kept, *arrays], names=labels)
        if at_end is not None:
            at_end()

    return plain.mapInArrow(run, schema).toDF(*docs.columns, *[n for n, _ in fields])
