"""Read-only SELECT gate over Spark SQL, plus schema-inventory helpers.

``safe_select`` accepts exactly one SELECT (CTEs and set operations inside them
are fine), refuses writes, DDL, commands, scripts, reflection, ``VALUES``,
``TABLE t`` and path tables anywhere in the tree, and caps the result with a
limit when the statement has none. The check walks Spark's own parsed plan
(from ``EXPLAIN EXTENDED``, which parses without running anything); error
messages never echo the SQL text.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


class QueryRejected(ValueError):
    pass


# FIXED VALUES — plan nodes allowed at the root of a SELECT.
_ROOT_OK = {"Project", "Aggregate", "Sort", "Filter", "GlobalLimit", "Distinct", "Offset",
            "UnresolvedHaving", "WithWindowDefinition", "Join", "Generate", "Window",
            "SubqueryAlias", "Pivot", "Unpivot"}
_SETOPS = {"Union", "Except", "Intersect"}
_WRAPPERS = {"Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct"}
_FILE_FORMATS = {"parquet", "csv", "json", "orc", "text", "avro", "binaryfile", "delta", "jdbc"}
_REFLECT = re.compile(r"\b(reflect|java_method|try_reflect)`?\s*\(", re.I)
_NOT_CODE = re.compile(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|--[^\n]*|/\*.*?\*/""", re.S)


def _parsed_lines(spark: SparkSession, sql: str) -> list[str]:
    try:
        text = spark.sql("EXPLAIN EXTENDED " + sql).collect()[0][0]
    except Exception:  # noqa: BLE001 - the message could echo the SQL
        raise QueryRejected("Generated SQL could not be parsed.") from None
    body = text.split("== Parsed Logical Plan ==", 1)[-1].split("== Analyzed Logical Plan ==", 1)[0]
    return [ln for ln in body.splitlines() if ln.strip()]


def _node(line: str) -> str:
    s = re.sub(r"^[\s:|+\-]*", "", line).lstrip("'")
    return re.split(r"[\s\[(]", s, maxsplit=1)[0]


def _root_chain(lines: list[str]) -> list[str]:
    """Nodes of the final query (below a ``CTE`` wrapper) from its root through
    ordering, limits, offsets and DISTINCT, up to and with the first other node."""
    names = [_node(ln) for ln in lines]
    at = 0
    if names[0] == "CTE":
        at = next((i for i, ln in enumerate(lines) if ln.startswith("+- ")), 0)
    chain = []
    for n in names[at:]:
        chain.append(n)
        if n not in _WRAPPERS:
            break
    return chain


def _code_only(sql: str) -> str:
    """The statement with string literals and comments blanked out, at the same
    length, so that positions carry over."""
    return _NOT_CODE.sub(lambda m: " " * len(m.group()), sql)


def _without_limit(sql: str) -> str:
    """The statement without the LIMIT clause of its outermost query; an OFFSET
    after it stays."""
    code, depth, limit, end = _code_only(sql), 0, None, len(sql)
    for m in re.finditer(r"[()]|;|\b(?:limit|offset)\b", code, flags=re.I):
        t = m.group().lower()
        depth += {"(": 1, ")": -1}.get(t, 0)
        if depth:
            continue
        if t == "limit":
            limit, end = m.start(), len(sql)
        elif t in ("offset", ";") and limit is not None and end == len(sql):
            end = m.start()
    return sql if limit is None else sql[:limit] + sql[end:]


def check_select(spark: SparkSession, sql: str) -> str:
    """Validate; returns the query-root node name. Raises ``QueryRejected``.
    Reflection is looked for in the code outside literals and comments (plan
    strings are cut after some columns)."""
    if _REFLECT.search(_code_only(sql)):
        raise QueryRejected("Only SELECT queries are permitted.")
    lines = _parsed_lines(spark, sql)
    for ln in lines:
        n = _node(ln)
        if (n.endswith("Command") or n.endswith("Statement") or n.startswith("Create")
                or n.startswith("Drop") or n.startswith("Alter") or n in
                {"ScriptTransformation", "LocalRelation", "InsertIntoDir", "SetCatalogAndNamespace"}):
            raise QueryRejected("Only SELECT queries are permitted. Write operations are not allowed.")
        if n == "UnresolvedRelation":
            parts = re.search(r"UnresolvedRelation \[([^\]]*)\]", ln)
            first = parts.group(1).split(",")[0].strip().lower() if parts else ""
            if first in _FILE_FORMATS:
                raise QueryRejected("Only SELECT queries over registered tables are permitted.")
    chain = _root_chain(lines)
    root = chain[0]
    if chain[-1] in _SETOPS:
        raise QueryRejected("Only SELECT queries are permitted. Set operations must be inside a CTE.")
    if root not in _ROOT_OK:
        raise QueryRejected("Only SELECT queries are permitted. Write operations are not allowed.")
    return root


def safe_select(spark: SparkSession, sql: str, cap: int = 500, replace: bool = False) -> DataFrame:
    """Run one validated SELECT. Without a root LIMIT a ``limit(cap)`` is added;
    with ``replace=True`` (the full-series rerun) an existing root LIMIT is
    replaced by ``cap``."""
    root = check_select(spark, sql)
    if root == "GlobalLimit":
        if not replace:
            return spark.sql(sql)
        sql = _without_limit(sql)
    return spark.sql(sql).limit(cap)


def schema_summary(cols: DataFrame, max_cols: int = 20) -> DataFrame:
    """``table: col (type), ...`` per table, first ``max_cols`` columns by
    ordinal, missing type -> ``unknown``; a table without columns -> its name.
    Input: (connection_id, table_name, ordinal, column_name, data_type)."""
    w = W.partitionBy("connection_id", "table_name").orderBy("ordinal")
    part = F.concat(F.col("column_name"), F.lit(" ("), F.coalesce("data_type", F.lit("unknown")), F.lit(")"))
    ranked = (cols.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= max_cols)
              .where(F.col("column_name").isNotNull()))
    agg = (ranked.groupBy("connection_id", "table_name")
           .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rk", part.alias("p")))),
                                         lambda x: x["p"]), ", ").alias("cols")))
    tables = cols.select("connection_id", "table_name").distinct()
    return (tables.join(agg, ["connection_id", "table_name"], "left")
            .select("connection_id", "table_name",
                    F.when(F.col("cols").isNull() | (F.col("cols") == ""), F.col("table_name"))
                    .otherwise(F.concat(F.col("table_name"), F.lit(": "), F.col("cols"))).alias("summary")))


def schema_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """Columns added, removed or retyped between two column inventories."""
    k = ["connection_id", "table_name", "column_name"]
    o = old.select(*k, F.col("data_type").alias("old_type"))
    n = new.select(*k, F.col("data_type").alias("new_type"))
    j = o.join(n, k, "full_outer")
    change = (F.when(F.col("old_type").isNull() & F.col("new_type").isNotNull(), "added")
              .when(F.col("new_type").isNull() & F.col("old_type").isNotNull(), "removed")
              .when(F.col("old_type") != F.col("new_type"), "retyped"))
    return j.withColumn("change", change).where(F.col("change").isNotNull())
