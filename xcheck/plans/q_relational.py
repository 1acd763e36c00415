"""The SELECT surface (2.2 / 2.3 / 2.7): relational queries run through Spark
SQL on the driver tables. Each SQL text is also its own DuckDB oracle, so the
two engines run the very same statement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sqlgate
from ..session import Tables, register_views
from .registry import query

SQL = {
    "rel_filter_project": """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'""",
    "rel_aggregate": """
SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty,
       round(sum(l_extendedprice), 2) AS sum_price,
       round(sum(CAST(round(l_discount * 100) AS BIGINT)) / count(l_discount) / 100, 6) AS avg_disc,
       min(l_extendedprice) AS min_price, max(l_extendedprice) AS max_price
FROM lineitem GROUP BY l_returnflag, l_linestatus""",
    "rel_join": """
SELECT n_name, r_name, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue
FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY n_name, r_name""",
    "rel_order_limit": """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20""",
    "rel_distinct": """
SELECT DISTINCT c_mktsegment, c_nationkey FROM customer""",
    "rel_having": """
SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS spent FROM orders
GROUP BY o_custkey HAVING count(*) >= 20""",
    "rel_cte": """
WITH spend AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey),
     seg AS (SELECT c_mktsegment, count(*) AS customers, round(sum(s), 2) AS spend
             FROM customer JOIN spend ON c_custkey = o_custkey GROUP BY c_mktsegment)
SELECT c_mktsegment, customers, spend FROM seg""",
    "rel_subquery": """
SELECT o_orderkey, o_totalprice FROM orders
WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.8 FROM orders)
  AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
    "rel_window": """
SELECT o_custkey, o_orderkey, o_totalprice,
       rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rk,
       round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running
FROM orders""",
    "rel_setop_in_cte": """
WITH big AS (SELECT o_custkey AS k FROM orders WHERE o_totalprice > 300000
             INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0),
     quiet AS (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders),
     u AS (SELECT k, 'big' AS kind FROM big UNION ALL SELECT k, 'quiet' FROM quiet)
SELECT kind, count(*) AS n FROM u GROUP BY kind""",
    "rel_rollup_cube": """
SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""",
    "rel_grouping_sets": """
SELECT l_returnflag, l_linestatus, count(*) AS n
FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""",
    "rel_semi": """
SELECT c_custkey, c_name FROM customer
WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""",
    "rel_anti": """
SELECT c_custkey, c_name FROM customer
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""",
    "rel_outer": """
SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer
LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""",
    "rel_full_outer": """
SELECT coalesce(s.k, c.k) AS nationkey, coalesce(s.suppliers, 0) AS suppliers, coalesce(c.customers, 0) AS customers
FROM (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY s_nationkey) s
FULL OUTER JOIN (SELECT c_nationkey AS k, count(*) AS customers FROM customer GROUP BY c_nationkey) c
ON s.k = c.k""",
    # Non-equi join against a dimension bounded by the size domain of parts
    # (one band per distinct p_size), the nested-loop side stays small.
    "rel_range_join": """
WITH bands AS (SELECT p_size AS band, min(p_retailprice) AS lo, max(p_retailprice) AS hi
               FROM part GROUP BY p_size)
SELECT band, count(*) AS parts_in_band FROM part JOIN bands
ON p_retailprice >= lo AND p_retailprice <= hi GROUP BY band""",
    "rel_nested_loop": """
SELECT l_orderkey, l_linenumber, o_orderdate IS NOT NULL AS has_order FROM lineitem
JOIN orders ON l_orderkey = o_orderkey AND l_shipdate < o_orderdate""",
}


def _mk(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register_views(spark, sf_dir)
        return spark.sql(SQL[name])
    run.__name__ = name
    return run


for _n in SQL:
    query(_n, oracle=SQL[_n])(_mk(_n))


# ---------------------------------------------------------------------------
# The gate itself
# ---------------------------------------------------------------------------

_GATED = """
SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders GROUP BY o_orderpriority"""


@query("safe_select", oracle=_GATED + " LIMIT 500")
def safe_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_views(spark, sf_dir)
    return sqlgate.safe_select(spark, _GATED, cap=500)


_SERIES = """
SELECT year(o_orderdate) AS yr, month(o_orderdate) AS mo, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders GROUP BY year(o_orderdate), month(o_orderdate) ORDER BY yr, mo LIMIT 10"""


@query("full_series", oracle=_SERIES.replace("LIMIT 10", "LIMIT 100000"))
def full_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A validated SELECT rerun with its LIMIT replaced by 100 000."""
    register_views(spark, sf_dir)
    return sqlgate.safe_select(spark, _SERIES, cap=100000, replace=True)


@query("tenant_filter", oracle="""
SELECT o_orderkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey
WHERE c_nationkey = 7""")
def tenant_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenant = customer nation; the tenant predicate is mandatory and is pushed
    to the scan (a tenant-partitioned layout prunes whole directories)."""
    t = Tables(spark, sf_dir)
    from ..operators.commerce import tenant_view
    cust = tenant_view(t.customer, "c_nationkey", 7).select("c_custkey")
    return t.orders.join(cust, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select(
        "o_orderkey", "o_totalprice")
