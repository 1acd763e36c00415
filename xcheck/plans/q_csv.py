"""CSV queries. The uploaded files are multi-section exports that Spark writes
from the tables first: one file per region and slice of ``SLICE`` customer keys,
one section per nation (title row ``TABLE i: NATION``, a header row, one row per
customer); titles are unpadded, so rows differ in width. The files go to a fresh
folder under the session's checkpoint directory; more customers make more files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import Tables, checkpoint_dir, materialize
from ..sources import csvio as CV
from .registry import query

SLICE = 50_000
HEADER = ["Customer", "Segment", "Account Balance", "Nation Key"]


def _q(c):
    return F.concat(F.lit('"'), F.regexp_replace(c, '"', '""'), F.lit('"'))


LATER_HEADER = ["Customer", "Segment", "Account Balance", "Loyalty Tier"]


def write_region_csvs(spark: SparkSession, sf_dir: str, later: bool = False) -> str:
    """``later``: the export of a later date, without nation keys, with a loyalty
    tier, and with balances in words of money."""
    t = Tables(spark, sf_dir)
    header = LATER_HEADER if later else HEADER
    balance = F.format_string("EUR %.2f", "c_acctbal") if later else F.format_string("%.2f", "c_acctbal")
    last_cell = F.concat(F.lit("tier "), F.col("c_nationkey")) if later else F.col("c_nationkey").cast("string")
    nat = t.nation.select("n_nationkey", "n_name", "n_regionkey")
    nat = nat.withColumn("sec", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")))
    last = (t.customer.agg(F.max("c_custkey")).first()[0] or 0) // SLICE
    sections = nat.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(last))))
    place = [F.col("n_regionkey").alias("region"), F.col("slice").cast("int").alias("slice"), "sec"]
    title = sections.select(*place, F.lit(0).alias("kind"), F.lit(0).cast("long").alias("k"),
                            F.concat(F.lit("TABLE "), F.col("sec").cast("string"), F.lit(": "), F.col("n_name")).alias("value"))
    head = sections.select(*place, F.lit(1).alias("kind"), F.lit(0).cast("long").alias("k"), F.lit(",".join(header)).alias("value"))
    data = (t.customer.join(nat, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("slice", F.floor(F.col("c_custkey") / SLICE))
            .select(*place, F.lit(2).alias("kind"), F.col("c_custkey").cast("long").alias("k"),
                    F.concat_ws(",", _q(F.col("c_name")), _q(F.col("c_mktsegment")),
                                balance, last_cell).alias("value")))
    lines = title.unionByName(head).unionByName(data)
    path = f"{checkpoint_dir(spark).rstrip('/')}/xcheck-csv/{uuid.uuid4().hex}"
    (lines.repartition("region", "slice").sortWithinPartitions("region", "slice", "sec", "kind", "k")
     .select("region", "slice", "value").write.partitionBy("region", "slice").text(path))
    return path


def _placed(df: DataFrame) -> DataFrame:
    """Region and slice of a file, from its path."""
    return df.withColumns({c: F.regexp_extract("file", rf"{c}=(\d+)", 1).cast("int") for c in ("region", "slice")})


def _raw(spark: SparkSession, sf_dir: str, later: bool = False) -> DataFrame:
    path = write_region_csvs(spark, sf_dir, later)
    return _placed(CV.read_csv_loose(spark, path + "/region=*/slice=*/*.txt"))


_SQL_SECTIONS = f"""
  nat AS (SELECT n_nationkey, n_name, n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS sec FROM nation),
  sl AS (SELECT CAST(unnest(range(0, (SELECT coalesce(max(c_custkey), 0) // {SLICE} FROM customer) + 1)) AS INT) AS slice),
  cnt AS (SELECT nat.*, slice, count(c_custkey) AS c FROM nat CROSS JOIN sl
          LEFT JOIN customer ON c_nationkey = n_nationkey AND c_custkey // {SLICE} = slice GROUP BY ALL),
  pos AS (SELECT *, coalesce(sum(c + 2) OVER (PARTITION BY n_regionkey, slice ORDER BY sec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS title_row_idx FROM cnt)"""


@query("read_csv_loose", oracle=f"""WITH {_SQL_SECTIONS}
SELECT n_regionkey AS region, slice, CAST(sum(c + 2) AS BIGINT) AS n_rows, 4 AS width FROM pos GROUP BY ALL""")
def read_csv_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _raw(spark, sf_dir)
    return r.groupBy("region", "slice").agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.size("cells")).alias("width"))


@query("csv_sections", oracle=f"""WITH {_SQL_SECTIONS}
SELECT n_regionkey AS region, slice, CAST(sec - 1 AS INT) AS index, 'TABLE ' || sec || ': ' || n_name AS name,
       title_row_idx, title_row_idx + 1 AS header_row_idx, title_row_idx + 2 AS data_start_idx,
       title_row_idx + 2 + c AS data_end_idx, ['customer', 'segment', 'account_balance', 'nation_key'] AS columns,
       c AS row_count FROM pos""")
def csv_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(CV.csv_sections(_raw(spark, sf_dir))).drop("file")


@query("load_section", oracle="""
SELECT c_name AS customer, c_mktsegment AS segment, round(c_acctbal, 2) AS account_balance,
       CAST(c_nationkey AS DOUBLE) AS nation_key
FROM customer JOIN nation ON c_nationkey = n_nationkey
WHERE n_nationkey = (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = 0) AND c_custkey // """ + str(SLICE) + " = 0")
def load_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section 0 of region 0's first file as a typed table."""
    raw = _raw(spark, sf_dir)
    secs = CV.csv_sections(raw)
    f = raw.where("region = 0 and slice = 0").select("file").first()["file"]
    return CV.load_section(raw, secs, f, 0)


@query("looks_multi_table", oracle=f"""WITH {_SQL_SECTIONS}
SELECT n_regionkey AS region, slice, true AS is_multi_table, count(*) - 1 AS section_markers FROM pos GROUP BY ALL""")
def looks_multi_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(CV.looks_multi_table(_raw(spark, sf_dir))).drop("file")


@query("section_manifest", oracle=f"""WITH {_SQL_SECTIONS},
  l AS (SELECT n_regionkey, slice, sec, printf('Section %d (row %d): "%s"', sec - 1, title_row_idx, 'TABLE ' || sec || ': ' || n_name)
                 || chr(10) || '  Columns: customer, segment, account_balance, nation_key' || chr(10)
                 || printf('  Data rows: %d-%d (%d rows)', title_row_idx + 2, title_row_idx + 1 + c, c) AS line FROM pos)
SELECT n_regionkey AS region, slice, left(string_agg(line, chr(10) || chr(10) ORDER BY sec), 2500) AS manifest FROM l GROUP BY ALL""")
def section_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir)
    m = CV.section_manifest(CV.csv_sections(raw))
    return _placed(m).select("region", "slice", "manifest")


@query("schema_drift", oracle=f"""WITH {_SQL_SECTIONS},
  d AS (SELECT unnest([{{'c': 'account_balance', 'change': 'retyped', 'o': 'double', 'n': 'text'}}, {{'c': 'loyalty_tier', 'change': 'added', 'o': NULL, 'n': 'text'}},
                       {{'c': 'nation_key', 'change': 'removed', 'o': 'double', 'n': NULL}}]) AS x)
SELECT n_regionkey AS region, slice, 'TABLE ' || sec || ': ' || n_name AS table_name, x.c AS column_name,
       CASE WHEN c = 0 AND x.o IS NOT NULL THEN 'text' ELSE x.o END AS old_type, x.n AS new_type, x.change AS change
FROM pos, d WHERE NOT (c = 0 AND x.change = 'retyped')""")
def schema_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns added, removed and retyped between the sections of two dates' exports."""
    from ..operators import sqlgate as G

    def inventory(later: bool) -> DataFrame:
        raw = materialize(_raw(spark, sf_dir, later), "csv-rows")
        cols = _placed(CV.section_inventory(raw, CV.csv_sections(raw)))
        return cols.withColumn("connection_id", F.concat_ws("-", "region", "slice"))

    found = G.schema_drift(inventory(False), inventory(True))
    place = F.split("connection_id", "-")
    return found.select(place[0].cast("int").alias("region"), place[1].cast("int").alias("slice"), "table_name", "column_name", "old_type", "new_type", "change")
