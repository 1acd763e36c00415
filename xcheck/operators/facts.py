"""Numeric-fact extraction: from free text and from table cells.

Output schema of both extractors: ``entity_id, ix, label, value, raw_text`` where
``ix`` keeps the reference's scan order (pattern by pattern, match by match, or
row by row then column by column) and duplicates ``(label, round(value, 2))``
are dropped keeping the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T


def _tag(p: int):
    def f(m: Column) -> Column:
        return F.struct(F.lit(p).alias("p"), m.alias("m"))
    return f


def _group(g: int, s: Column) -> Column:
    """Group ``g`` of the pattern that produced match ``s.m``, re-read on the
    match alone (anchored), which is cheap and yields the same groups."""
    out = None
    for k, pat in enumerate(rules.FACT_PATTERNS):
        e = F.regexp_extract(s["m"], "(?i)^" + pat, g)
        out = F.when(s["p"] == k, e) if out is None else out.when(s["p"] == k, e)
    return out


def dedup_first(df: DataFrame, keys: list[str], order: str = "ix") -> DataFrame:
    """Keep the first row (smallest ``order``) per key. Aggregation form: partial
    aggregation runs map-side, so a hot key never lands whole in one task."""
    other = [c for c in df.columns if c not in keys]
    packed = F.min_by(F.struct(*[F.col(c) for c in other]), F.col(order)).alias("_r")
    return df.groupBy(*keys).agg(packed).select(*keys, *[F.col("_r." + c).alias(c) for c in other])


def _groups(s: Column, ix: Column) -> Column:
    # Stage 1: each group read once per match (lambdas get no CSE, so every
    # later stage only touches fields).
    return F.struct(ix.alias("ix"), s["m"].alias("m"),
                    *[_group(g, s).alias(f"g{g}") for g in (1, 2, 3, 4)])


def _parsed(x: Column) -> Column:
    return F.struct(x["ix"].alias("ix"), T.normalize_label(x["g1"]).alias("label"),
                    T.number_from_match(x["g3"], x["g2"], x["g4"]).alias("value"),
                    T.strip_ws(x["m"]).alias("raw_text"))


def _keyed(x: Column) -> Column:
    # Field order = sort order: dedup key first, then scan order.
    return F.struct(x["label"].alias("label"), F.bround(x["value"], 2).alias("v2"),
                    x["ix"].alias("ix"), x["value"].alias("value"), x["raw_text"].alias("raw_text"))


def extract_facts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  min_label: int = 3) -> DataFrame:
    """(label, value) facts from text with the three ordered patterns.

    Whole texts are scanned; a text without any digit cannot hold a fact, so it
    is skipped by a cheap ``rlike`` before the three full regex passes. All facts
    of a text live in its own row until the end: the first-occurrence dedup is
    a sort of that row's array (keys ``label, round(value, 2)``, then scan
    order) keeping each key's head — no shuffle.
    """
    text = F.col(text_col)
    tagged = [F.transform(F.regexp_extract_all(text, F.lit("(?i)" + p), 0), _tag(k))
              for k, p in enumerate(rules.FACT_PATTERNS)]
    found = F.transform(F.transform(F.concat(*tagged), _groups), _parsed)
    found = F.transform(F.filter(found, lambda f: F.length(f["label"]) >= min_label), _keyed)
    rows = (docs.where(text.rlike("[0-9]"))
            .select(F.col(id_col).alias("entity_id"), F.array_sort(found).alias("srt")))
    heads = F.filter("srt", lambda f, i: (i == 0) | (F.element_at("srt", i)["label"] != f["label"])
                     | (F.element_at("srt", i)["v2"] != f["v2"]))
    return (rows.select("entity_id", F.explode(heads).alias("f"))
            .select("entity_id", "f.ix", "f.label", "f.value", "f.raw_text"))


def facts_from_table(df: DataFrame, id_col: str, cols: list[str] | None = None,
                     order_col: str | None = None, min_label: int = 2) -> DataFrame:
    """Every numeric-like cell becomes a fact labelled by its column name.

    ``id_col`` groups rows into one result set (the entity); ``order_col`` gives
    row order inside it. Numbers and strings that parse after removing ``,`` and
    ``$`` count. Implemented as one unpivot (``stack``) — no per-row Python.
    """
    cols = cols or [c for c in df.columns if c not in (id_col, order_col)]
    order = F.col(order_col) if order_col else F.lit(0)
    ncols = len(cols)
    cells = F.array(*[
        # labels are made here: the filter on their length would make them once more below
        F.struct(F.lit(i).alias("ci"), F.lit(c).alias("col"), T.normalize_label(F.lit(c)).alias("label"),
                 T.numeric_like(F.col(c)).alias("value"),
                 F.col(c).cast("string").alias("sval"))
        for i, c in enumerate(cols)])
    facts = (df.select(F.col(id_col).alias("entity_id"), order.cast("long").alias("_row"),
                       F.explode(cells).alias("c"))
             .where(F.col("c.value").isNotNull())
             .select("entity_id",
                     (F.col("_row") * F.lit(ncols) + F.col("c.ci")).alias("ix"),
                     F.col("c.label").alias("label"),
                     F.col("c.value").alias("value"),
                     F.concat(F.col("c.col"), F.lit(": "), F.col("c.sval")).alias("raw_text"))
             .where(F.length("label") >= min_label)
             .withColumn("_v2", F.bround("value", 2)))
    return dedup_first(facts, ["entity_id", "label", "_v2"]).drop("_v2")
