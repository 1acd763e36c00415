"""Distributed selection against numpy, with a hot group, ties and nulls."""

import numpy as np
from pyspark.sql import functions as F

from xcheck.operators import audit, profile
from xcheck.operators.selection import quantiles, ranked_values


def _rows():
    rng = np.random.default_rng(3)
    rows = [("hot", float(x)) for x in rng.normal(size=3000).round(2)] + [("one", 5.0), (None, 1.0), (None, 2.0), ("none", None)]
    return rows + [(f"g{k}", float(x)) for k in range(20) for x in rng.integers(0, 5, rng.integers(1, 9))]


def test_quantiles_equal_numpy(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = {r.g: (r.n, r.q) for r in quantiles(df, ["g"], "v", [0.0, 0.25, 0.5, 0.95, 1.0]).collect()}
    groups = {g for g, v in rows if v is not None}
    assert set(got) == groups
    for g in groups:
        v = np.array([x for k, x in rows if k == g and x is not None])
        assert got[g][0] == len(v) and np.allclose(got[g][1], np.quantile(v, [0, 0.25, 0.5, 0.95, 1]))
    whole = quantiles(df, [], "v", [0.5]).first()
    assert np.isclose(whole.q[0], np.median([v for _, v in rows if v is not None]))


def test_ranks_are_spread(spark):
    df = spark.createDataFrame(_rows(), "g string, v double")
    r = ranked_values(df, ["g"], "v")
    hot = r.where("g = 'hot'").orderBy("v").collect()
    assert [x.below for x in hot] == np.concatenate([[0], np.cumsum([x.times for x in hot])[:-1]]).tolist()
    assert {x.total for x in hot} == {3000}
    plan = r._jdf.queryExecution().toString()
    assert "Percentile" not in plan and "collect_list" not in plan


def test_describe_and_latency(spark):
    df = spark.createDataFrame(_rows(), "g string, v double").withColumn("w", F.col("v") * 2)
    got = {r["column"]: r for r in profile.describe_numeric(df, ["v", "w"]).collect()}
    v = np.array([x for _, x in _rows() if x is not None])
    assert np.allclose([got["w"].p25, got["v"].p50, got["v"].p75, got["v"]["max"]], [2 * np.quantile(v, 0.25), np.median(v), np.quantile(v, 0.75), v.max()])
    p = {r.g: r for r in audit.latency_percentiles(df, ["g"], "v").collect()}
    hot = sorted(x for g, x in _rows() if g == "hot")
    assert p["hot"].p95 == hot[max(0, round(0.95 * 3000) - 1)] and np.isclose(p["hot"].p50, np.median(hot)) and p[None].n == 2
    assert profile.describe_numeric(df.limit(0), ["v"]).collect()[0]["p50"] is None
