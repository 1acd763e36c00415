"""Exact order statistics without gathering a group.

Values are counted per (group, value), the counts are range-partitioned in
(group, value) order, each partition is summed up per group, and the few sums
are chained: a value's rank is what lies in earlier partitions plus what lies
before it in its own. A group with most of all rows is spread over as many
partitions as its distinct values fill; no buffer or sort holds a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize


def same_keys(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, null with null; the keys come once."""
    right = b.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)], *[c for c in b.columns if c not in keys])
    on = reduce(lambda x, y: x & y, [a[k].eqNullSafe(F.col(f"_r{i}")) for i, k in enumerate(keys)])
    return a.join(right, on, how).drop(*[f"_r{i}" for i in range(len(keys))])


def ranked_values(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., value, times, below, total): every distinct value of a group, how
    often it occurs, how many smaller ones there are and how many in all. Null
    values are left out; a null group is a group."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("times"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(counts.repartitionByRange(parts, *by, value).withColumn("_part", F.spark_partition_id()), "ranks")
    sums = placed.groupBy(*by, "_part").agg(F.sum("times").alias("_sum"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = F.sum("_sum").over(group.orderBy("_part")) - F.col("_sum")
    starts = sums.select(*by, "_part", before.alias("_start"), F.sum("_sum").over(group).alias("total"))
    inside = Window.partitionBy(*by, "_part").orderBy(value)
    own = placed.withColumn("_before", F.sum("times").over(inside) - F.col("times"))
    return same_keys(own, starts, [*by, "_part"]).select(*by, value, "times", (F.col("_start") + F.col("_before")).alias("below"), "total")


def at_rank(value: str, rank) -> Column:
    """Aggregate over ``ranked_values``: the value at a 0-based rank."""
    return F.max(F.when((F.col("below") <= rank) & (rank < F.col("below") + F.col("times")), F.col(value)))


def quantiles(df: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """(by..., n, q): exact quantiles with linear interpolation, in the order of ``shares``."""
    ranked = ranked_values(df.select(*by, F.col(value).cast("double").alias("_value")), by, "_value")
    aggs = [F.max("total").alias("n")]
    for i, p in enumerate(shares):
        place = (F.col("total") - 1) * F.lit(float(p))
        aggs += [at_rank("_value", F.floor(place)).alias(f"_lo{i}"), at_rank("_value", F.ceil(place)).alias(f"_hi{i}"), F.max(place - F.floor(place)).alias(f"_f{i}")]
    found = ranked.groupBy(*by).agg(*aggs)
    q = F.array(*[F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}") for i in range(len(shares))])
    return found.select(*by, "n", q.alias("q"))
