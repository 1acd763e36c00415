"""Session construction and table loading.

Every operator in this package is ``DataFrame -> DataFrame``; this module is the
only place that knows where tables live and how the session is tuned.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Settings every session of ours wants. AQE re-plans joins from runtime sizes,
# coalesces small shuffle partitions and splits skewed ones; the broadcast
# threshold stays at Spark's default so only small, measured sides broadcast.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.ansi.enabled": "false",
    # rank filters up to this bound become map-side WindowGroupLimits (top-k
    # per key before the shuffle); the compression input needs 2667
    "spark.sql.optimizer.windowGroupLimitThreshold": "5000",
    # that rule puts size(x) > 0 and x is not null under every explode(x), and the
    # filter is then pushed to where x is computed, which it computes twice more
    "spark.sql.optimizer.excludedRules": "org.apache.spark.sql.catalyst.optimizer.InferFiltersFromGenerate",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "xcheck") -> SparkSession:
    """Create (or reuse) a session with our defaults. Tests pass ``local[*]``."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = b.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    for k, v in SESSION_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    configure(spark)
    return spark


_SHIPPED: set[int] = set()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime-settable part of our defaults to an existing session
    (and ship the package to executors once per session on a cluster)."""
    for k, v in SESSION_CONF.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # static conf on a shared session: leave it
            pass
    if id(spark) not in _SHIPPED:
        _SHIPPED.add(id(spark))
        try:
            ship_package(spark)
        except Exception:  # a remote client without a SparkContext
            pass
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make this package importable by the Python workers (Arrow UDF helpers,
    ``mapInPandas`` and stateful functions live in it): the zipped package is
    added to the session once. Needed on a cluster, and locally whenever the
    driver was not started from the repository folder."""
    import shutil
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "xcheck"), "zip",
                              os.path.dirname(pkg), os.path.basename(pkg))
    spark.sparkContext.addPyFile(out)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    Only when the session has none (a local test) do we pick one ourselves.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = tempfile.mkdtemp(prefix="xcheck-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write a table that several later steps read to the shared checkpoint
    folder and read it back: it is computed once, and a lost executor costs a
    re-read of its files."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/xcheck-tables/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def settings(spark: SparkSession, conf: dict[str, str]):
    """``conf`` holds for what is run inside."""
    before = {name: spark.conf.get(name, None) for name in conf}
    for name, value in conf.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, was in before.items():
            spark.conf.unset(name) if was is None else spark.conf.set(name, was)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows over ``xcheck.spread.partitions`` partitions if the session
    sets that, else leave them as they are. Off by default: a cluster splits its
    scans by ``spark.sql.files.maxPartitionBytes``. A single-file table of one row
    group cannot be split, which is what the bench sets it for."""
    n = df.sparkSession.conf.get("xcheck.spread.partitions", None)
    return df.repartition(int(n)) if n else df


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def fs_is_dir(spark: SparkSession, path: str) -> bool:
    """Directory test on any Hadoop-compatible store (local, HDFS, object stores)."""
    fs, p = _fs(spark, path)
    return bool(fs.exists(p) and fs.getFileStatus(p).isDirectory())


def fs_list(spark: SparkSession, path: str) -> list[str]:
    """Child names of a folder on any Hadoop-compatible store ([] if missing)."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return [st.getPath().getName() for st in fs.listStatus(p)]


# Dimension tables always stay as read (see ``spread``).
SMALL_DIMENSIONS = {"region", "nation", "supplier"}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table. ``timestamp_ntz`` columns become ``timestamp``
    (UTC session) so watermarks and time windows accept them."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    casts = [
        F.col(f.name).cast(T.TimestampType()).alias(f.name)
        if isinstance(f.dataType, T.TimestampNTZType) else F.col(f.name)
        for f in df.schema.fields
    ]
    out = df.select(*casts)
    return out if name in SMALL_DIMENSIONS else spread(out)


class Tables:
    """Lazy attribute access to the driver tables of one scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return load(self.spark, self.sf_dir, name)
        raise AttributeError(name)


def register_views(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Expose the driver tables as temp views (for Spark SQL queries)."""
    for n in names:
        load(spark, sf_dir, n).createOrReplaceTempView(n)
