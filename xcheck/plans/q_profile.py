"""Profiling queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import profile as P
from ..session import Tables
from .registry import query

_LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _r6(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("describe_numeric", oracle=" UNION ALL ".join(
    f"SELECT '{c}' AS column, count({c}) AS count, round(sum(CAST(round({c} * 100) AS BIGINT)) / count({c}) / 100, 6) AS mean, "
    f"round(stddev_samp({c}), 6) AS std, "
    f"round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, "
    f"round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max FROM lineitem" for c in _LI_NUM))
def describe_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = P.describe_numeric(Tables(spark, sf_dir).lineitem, _LI_NUM, exact_scale=2)   # money / rates: 2 decimals
    return _r6(d, ["mean", "std", "min", "p25", "p50", "p75", "max"])


def _docs_labels(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id", "left")


_DL_COLS = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]


@query("null_percentages", oracle="WITH d AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id)) SELECT * FROM ("
       + " UNION ALL ".join(f"SELECT '{c}' AS column, round_even(count(*) FILTER (WHERE {c} IS NULL) / greatest(count(*), 1)"
                            f" * 100.0, 1) AS null_pct FROM d" for c in _DL_COLS) + ") WHERE null_pct > 0")
def null_percentages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their (partial) labels: label columns are null where a
    document has no label."""
    return P.null_percentages(_docs_labels(Tables(spark, sf_dir)).select(*_DL_COLS))


_LC_COLS = ["l_returnflag", "l_linestatus", "l_discount", "l_tax", "l_quantity", "l_linenumber"]


@query("low_cardinality", oracle="SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column, count(DISTINCT {c}) AS n_unique, list_sort(list(DISTINCT CAST({c} AS VARCHAR))) AS values FROM lineitem"
    for c in _LC_COLS) + ") WHERE n_unique BETWEEN 1 AND 15")
def low_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.low_cardinality(Tables(spark, sf_dir).lineitem.select(*_LC_COLS))


@query("correlation_matrix", oracle=" UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS corr FROM lineitem"
    for a in _LI_NUM for b in _LI_NUM))
def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r6(P.correlation_matrix(Tables(spark, sf_dir).lineitem, _LI_NUM), ["corr"])


@query("histogram", oracle="""
WITH mm AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
  b AS (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((l_extendedprice - lo) / ((hi - lo) / 30)), 29) END AS INT) AS bin, lo, hi
        FROM lineitem, mm WHERE l_extendedprice IS NOT NULL)
SELECT bin, round(lo + bin * (hi - lo) / 30, 4) AS bin_lo, round(lo + (bin + 1) * (hi - lo) / 30, 4) AS bin_hi, count(*) AS n
FROM b GROUP BY bin, lo, hi""")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = P.histogram(Tables(spark, sf_dir).lineitem, "l_extendedprice", 30)
    return h.select("bin", F.round("bin_lo", 4).alias("bin_lo"), F.round("bin_hi", 4).alias("bin_hi"), "n")


@query("infer_frequency", oracle="""
WITH m AS (SELECT DISTINCT c_nationkey, date_trunc('month', o_orderdate) AS t FROM orders JOIN customer ON o_custkey = c_custkey),
  s AS (SELECT *, datediff('month', lag(t) OVER (PARTITION BY c_nationkey ORDER BY t), t) AS dm FROM m),
  a AS (SELECT c_nationkey, count(*) AS n, min(dm) AS mn, max(dm) AS mx FROM s GROUP BY c_nationkey)
SELECT c_nationkey, n, CASE WHEN n >= 3 AND mn = 1 AND mx = 1 THEN 'MS' END AS freq FROM a""")
def infer_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per nation: the months in which it placed orders (month starts)."""
    t = Tables(spark, sf_dir)
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "c_nationkey", F.date_trunc("month", "o_orderdate").alias("t"))
    return P.infer_frequency(o, ["c_nationkey"], "t")


def _orders_text(t: Tables) -> DataFrame:
    """Orders as an all-text export (the shape of an uploaded CSV)."""
    return t.orders.select(F.col("o_orderkey").cast("string").alias("order_id"),
                           F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("placed"),
                           F.format_string("$%,.2f", "o_totalprice").alias("amount"),
                           F.col("o_orderpriority").alias("priority"),
                           F.col("o_orderstatus").alias("status"))



_TXT_SQL = ("(SELECT CAST(o_orderkey AS VARCHAR) AS order_id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS placed, "
            "'$' || format('{:,.2f}', o_totalprice) AS amount, o_orderpriority AS priority, o_orderstatus AS status "
            "FROM orders)")
_TXT_COLS = ["order_id", "placed", "amount", "priority", "status"]
_STRIP = "regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def _sql_is_dt(c: str) -> str:
    by_name = "true" if any(k in c for k in P.DATETIME_NAME_KEYS) else "false"
    st = _STRIP.format(c=c)
    return (f"SELECT '{c}' AS \"column\", ({by_name} OR count(try_strptime({st}, ['%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%d', '%m/%d/%Y'])) / greatest(count({c}), 1)"
            f" > 0.7) AS is_datetime FROM t")


def _sql_num(c: str) -> str:
    st = _STRIP.format(c=c)
    return (f"SELECT '{c}' AS \"column\", CASE WHEN count(TRY_CAST(regexp_replace({st}, '[,$%]', '', 'g') AS DOUBLE))"
            f" / greatest(count({c}), 1) > 0.5 THEN 'double' ELSE 'string' END AS dtype FROM t")


@query("is_datetime_column", oracle=f"WITH t AS {_TXT_SQL} " + " UNION ALL ".join(_sql_is_dt(c) for c in _TXT_COLS))
def is_datetime_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.is_datetime_column(_orders_text(Tables(spark, sf_dir)))


@query("numeric_if_majority", oracle=f"WITH t AS {_TXT_SQL} " + " UNION ALL ".join(_sql_num(c) for c in _TXT_COLS))
def numeric_if_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which text columns flip to numbers (> 50 % parse after removing , $ %)."""
    d = P.numeric_if_majority(_orders_text(Tables(spark, sf_dir)))
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in d.schema.fields],
                                 "column string, dtype string")


_CUST = [("c_custkey", "bigint", True), ("c_name", "string", False), ("c_nationkey", "int", True),
         ("c_acctbal", "double", True), ("c_mktsegment", "string", False)]


@query("profile_table", oracle=" UNION ALL ".join(
    f"SELECT '{c}' AS column, '{ty}' AS dtype, round_even(count(*) FILTER (WHERE {c} IS NULL) / count(*) * 100, 1) AS null_pct, "
    + (f"round(min({c}), 6) AS min, round(sum(CAST(round({c} * 100) AS BIGINT)) / count({c}) / 100, 6) AS mean, "
       f"round(max({c}), 6) AS max, " if num else
       "CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS max, ")
    + "count(*) AS row_count, 5 AS column_count FROM customer" for c, ty, num in _CUST))
def profile_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.profile_table(Tables(spark, sf_dir).customer, exact_scale=2)
    return _r6(p.drop("distinct"), ["min", "mean", "max"])
