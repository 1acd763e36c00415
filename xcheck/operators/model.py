"""Trend fits and forecasts per group.

Series are aggregated to one row per (group, period) first (partial
aggregation), so a group handed to Python holds one value per period — its
size is bounded by the time span, not by the raw row count.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# FIXED VALUES — series-length split and default horizon
LONG_SERIES = 24
HORIZON = 12


def trend_fit(df: DataFrame, by: list[str], x: str, y: str, scale: int = 2) -> DataFrame:
    """Least-squares line per group (slope, intercept, r2) and the quadratic
    y = c0 + c1 x + c2 x^2, in one aggregation and no per-group Python.

    ``x`` is an integer (a period), ``y`` has ``scale`` decimals. The quadratic
    comes from the normal equations: sums of powers as exact decimals, so that
    their differences lose nothing, then solved in doubles. Null coefficients where
    a group has fewer than three different ``x``."""
    X, Y = F.col(x).cast("double"), F.col(y).cast("double")
    used = F.col(x).isNotNull() & F.col(y).isNotNull()
    xi = F.when(used, F.col(x)).cast("decimal(9,0)")
    yi = F.when(used, F.round(Y * 10 ** scale)).cast("decimal(18,0)")
    exact = lambda c: F.sum(c.cast("decimal(28,0)"))
    s = df.groupBy(*by).agg(
        F.regr_slope(Y, X).alias("slope"), F.regr_intercept(Y, X).alias("intercept"), F.regr_r2(Y, X).alias("r2"), F.count_if(used).alias("n"),
        exact(xi).alias("s1"), exact(xi * xi).alias("s2"), exact(xi * xi * xi).alias("s3"), exact(xi * xi * xi * xi).alias("s4"),
        exact(yi).alias("t0"), exact(xi * yi).alias("t1"), exact(xi * xi * yi).alias("t2"))
    n, s1, s2, s3, s4, t0, t1, t2 = (F.col(k).cast("decimal(38,0)") for k in ["n", "s1", "s2", "s3", "s4", "t0", "t1", "t2"])
    # sums about the mean, times n: differences of exact products
    moments = {"a": n * s2 - s1 * s1, "b": n * s3 - s1 * s2, "c": n * s4 - s2 * s2, "d": n * t1 - s1 * t0, "e": n * t2 - s2 * t0}
    s = s.select("*", *[v.cast("double").alias(f"_{k}") for k, v in moments.items()])
    a, b, c, d, e = (F.col(f"_{k}") for k in "abcde")
    unit = float(10 ** scale)
    ok = (a * c - b * b) > 0
    s = s.withColumn("_q2", F.when(ok, (e * a - d * b) / (a * c - b * b)))
    s = s.withColumn("_q1", (d - b * F.col("_q2")) / a)
    q0 = (t0.cast("double") - s1.cast("double") * F.col("_q1") - s2.cast("double") * F.col("_q2")) / F.col("n")
    return s.select(*by, "n", "slope", "intercept", "r2", (q0 / unit).alias("quad_c0"), (F.col("_q1") / unit).alias("quad_c1"), (F.col("_q2") / unit).alias("quad_c2"))


def forecast_linear(df: DataFrame, by: list[str], x: str, y: str, horizon: int = HORIZON) -> DataFrame:
    """Straight-line extrapolation of the next ``horizon`` periods."""
    fit = df.groupBy(*by).agg(F.regr_slope(F.col(y), F.col(x)).alias("b"),
                              F.regr_intercept(F.col(y), F.col(x)).alias("a"), F.max(x).alias("last"))
    steps = fit.select(*by, "a", "b", "last", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    return steps.select(*by, "step", (F.col("last") + F.col("step")).alias(x),
                        (F.col("a") + F.col("b") * (F.col("last") + F.col("step"))).alias("yhat"))


def _forecast_group(horizon: int, x: str, y: str, by: list[str]):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(x)
        t = pdf[x].to_numpy(dtype=float)
        v = pdf[y].to_numpy(dtype=float)
        keys = {k: pdf[k].iloc[0] for k in by}
        out = []
        if len(v) < 2:
            return pd.DataFrame(columns=[*by, "step", x, "yhat", "method"])
        if len(v) < LONG_SERIES:
            b, a = np.polyfit(t, v, 1)
            for s in range(1, horizon + 1):
                out.append((s, t[-1] + s, a + b * (t[-1] + s), "linear"))
        else:
            A = np.column_stack([np.ones(len(v) - 1), t[1:], v[:-1]])
            coef, *_ = np.linalg.lstsq(A, v[1:], rcond=None)
            prev = v[-1]
            for s in range(1, horizon + 1):
                tt = t[-1] + s
                prev = coef[0] + coef[1] * tt + coef[2] * prev
                out.append((s, tt, prev, "lag_trend"))
        res = pd.DataFrame(out, columns=["step", x, "yhat", "method"])
        for k, val in keys.items():
            res.insert(0, k, val)
        return res
    return fn


def forecast(df: DataFrame, by: list[str], x: str, y: str, horizon: int = HORIZON) -> DataFrame:
    """Series shorter than 24 points: linear fit; longer: lag + trend
    regression ``y_t ~ 1 + t + y_{t-1}`` rolled forward. One pandas call per
    series (a series = one value per period)."""
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in df.select(*by).schema.fields]
                       + [f"step int, {x} double, yhat double, method string"])
    return df.select(*by, x, y).groupBy(*by).applyInPandas(_forecast_group(horizon, x, y, by), schema)


def period_change(df: DataFrame, by: list[str], t: str, y: str, lag: int = 1) -> DataFrame:
    """Percent change against ``lag`` periods earlier (e.g. YoY)."""
    w = Window.partitionBy(*by).orderBy(t)
    prev = F.lag(y, lag).over(w)
    return df.withColumn("prev", prev).withColumn(
        "pct_change", F.when(F.col("prev") != 0, (F.col(y) - F.col("prev")) / F.col("prev") * 100.0))
