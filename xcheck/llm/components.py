"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``links``; the component is named by
    its smallest node. Large-star then small-star per round, each a grouped
    minimum and an equi-join on the node (a hub is pre-aggregated, and AQE may
    split its join partition); rounds grow with the logarithm of the longest
    path. Every round is written to the shared folder. Null ends and self links
    are ignored; an empty table gives an empty result."""
    spark = links.sparkSession
    edges = (links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
             .filter("u <> v").distinct())
    edges = written(edges, "links")
    state = None
    while True:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionAll(down.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = written(small, "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == now:
            break
        state = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return spark.createDataFrame([], roots.schema) if now[0] == 0 else \
        edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots).distinct()
