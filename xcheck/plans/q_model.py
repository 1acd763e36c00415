"""Trend / forecast queries: monthly and yearly revenue per nation from
``orders`` + ``customer`` (month index = months since 1990-01)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import model as M
from ..session import Tables
from .registry import query


def monthly(t: Tables) -> DataFrame:
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    mi = ((F.year("o_orderdate") - 1990) * 12 + F.month("o_orderdate") - 1).cast("int")
    return (o.groupBy("c_nationkey", mi.alias("mi"))
            .agg(F.round(F.sum("o_totalprice"), 2).alias("revenue")))


_SQL_MONTHLY = """
  mo AS (SELECT c_nationkey, CAST((year(o_orderdate) - 1990) * 12 + month(o_orderdate) - 1 AS INT) AS mi,
                round(sum(o_totalprice), 2) AS revenue
         FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""


@query("trend_fit", oracle=f"""WITH {_SQL_MONTHLY},
  p AS (SELECT c_nationkey, mi, revenue, CAST(mi AS HUGEINT) AS x, CAST(round(revenue * 100) AS HUGEINT) AS y FROM mo),
  s AS (SELECT c_nationkey, count(*) AS n, regr_slope(revenue, mi) AS slope, regr_intercept(revenue, mi) AS intercept, regr_r2(revenue, mi) AS r2,
               sum(x) AS s1, sum(x * x) AS s2, sum(x * x * x) AS s3, sum(x * x * x * x) AS s4, sum(y) AS t0, sum(x * y) AS t1, sum(x * x * y) AS t2
        FROM p GROUP BY c_nationkey),
  m AS (SELECT *, CAST(n * s2 - s1 * s1 AS DOUBLE) AS a, CAST(n * s3 - s1 * s2 AS DOUBLE) AS b, CAST(n * s4 - s2 * s2 AS DOUBLE) AS c,
               CAST(n * t1 - s1 * t0 AS DOUBLE) AS d, CAST(n * t2 - s2 * t0 AS DOUBLE) AS e FROM s),
  q AS (SELECT *, CASE WHEN a * c - b * b > 0 THEN (e * a - d * b) / (a * c - b * b) END AS q2 FROM m),
  r AS (SELECT *, (d - b * q2) / a AS q1 FROM q)
SELECT c_nationkey, n, round(slope, 4) AS slope, round(intercept, 2) AS intercept, round(r2, 6) AS r2,
       round((CAST(t0 AS DOUBLE) - CAST(s1 AS DOUBLE) * q1 - CAST(s2 AS DOUBLE) * q2) / n / 100, 2) AS quad_c0,
       round(q1 / 100, 3) AS quad_c1, round(q2 / 100, 4) AS quad_c2 FROM r""")
def trend_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = M.trend_fit(monthly(Tables(spark, sf_dir)), ["c_nationkey"], "mi", "revenue")
    return f.select("c_nationkey", "n", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"), F.round("r2", 6).alias("r2"),
                    F.round("quad_c0", 2).alias("quad_c0"), F.round("quad_c1", 3).alias("quad_c1"), F.round("quad_c2", 4).alias("quad_c2"))


@query("forecast_linear", oracle=f"""WITH {_SQL_MONTHLY},
  f AS (SELECT c_nationkey, regr_slope(revenue, mi) AS b, regr_intercept(revenue, mi) AS a, max(mi) AS last FROM mo GROUP BY ALL)
SELECT c_nationkey, s AS step, last + s AS mi, round(a + b * (last + s), 2) AS yhat FROM f, range(1, 13) r(s)""")
def forecast_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = M.forecast_linear(monthly(Tables(spark, sf_dir)), ["c_nationkey"], "mi", "revenue", 12)
    return f.select("c_nationkey", "step", F.col("mi").cast("int").alias("mi"), F.round("yhat", 2).alias("yhat"))


@query("forecast")
def forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """12 months ahead per nation: lag + trend regression for long series,
    a straight line for short ones."""
    return M.forecast(monthly(Tables(spark, sf_dir)), ["c_nationkey"], "mi", "revenue", 12)


@query("period_change", oracle="""
WITH y AS (SELECT c_nationkey, year(o_orderdate) AS yr, sum(o_totalprice) AS revenue
           FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
  l AS (SELECT *, lag(revenue) OVER (PARTITION BY c_nationkey ORDER BY yr) AS prev FROM y)
SELECT c_nationkey, yr, round(revenue, 2) AS revenue, round(CASE WHEN prev <> 0 THEN (revenue - prev) / prev * 100 END, 4) AS pct_change FROM l""")
def period_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year-over-year revenue change per nation."""
    t = Tables(spark, sf_dir)
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    y = o.groupBy("c_nationkey", F.year("o_orderdate").alias("yr")).agg(F.sum("o_totalprice").alias("revenue"))
    p = M.period_change(y, ["c_nationkey"], "yr", "revenue", 1)
    return p.select("c_nationkey", "yr", F.round("revenue", 2).alias("revenue"), F.round("pct_change", 4).alias("pct_change"))
