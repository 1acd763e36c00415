"""Form fields, evaluation, semantic breaks, sinks and housekeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strip_ws
from .pii import mask_pii
from .selection import quantiles

# FIXED VALUES — skipped form values, semantic-break percentile, upload TTL
FORM_SKIP_VALUES = ["", "False", "Off"]
SEMANTIC_PERCENTILE = 0.85
UPLOAD_TTL_HOURS = 2
SNAPSHOT_ROWS = 500


def form_fields_to_text(fields: DataFrame, key: str = "doc_id", order: str = "ix") -> DataFrame:
    """``Label: value`` lines per form: ``_``/``-`` runs -> space, camelCase
    split, empty / ``False`` / ``Off`` values skipped, first label wins
    (case-insensitively). A form's lines are joined in field order."""
    v = strip_ws(F.coalesce(F.col("value").cast("string"), F.lit("")))
    label = F.regexp_replace(strip_ws(F.regexp_replace(strip_ws(F.coalesce("name", F.lit(""))), "[_\\-]+", " ")),
                             "([a-z])([A-Z])", "$1 $2")
    f = (fields.select(key, order, label.alias("label"), v.alias("v"))
         .where(~F.col("v").isin(*FORM_SKIP_VALUES) & (F.col("label") != "")))
    first = f.groupBy(key, F.lower("label").alias("_k")).agg(
        F.min_by(F.struct("label", "v"), F.col(order)).alias("_f"), F.min(order).alias("_o"))
    lines = first.select(key, "_o", F.concat(F.col("_f.label"), F.lit(": "), F.col("_f.v")).alias("line"))
    return lines.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "line"))),
                                                           lambda x: x["line"]), "\n").alias("text"))


def classification_report(pred: DataFrame, gold: DataFrame, key: str, label: str) -> DataFrame:
    """TP / FP / FN over (key, label) sets; precision and recall are 1.0 when
    their denominator is 0; F1 from those."""
    p = pred.select(key, label).distinct().withColumn("_p", F.lit(True))
    g = gold.select(key, label).distinct().withColumn("_g", F.lit(True))
    j = p.join(g, [key, label], "full_outer")
    c = j.agg(F.count_if(F.col("_p") & F.col("_g")).alias("tp"),
              F.count_if(F.col("_p") & F.col("_g").isNull()).alias("fp"),
              F.count_if(F.col("_g") & F.col("_p").isNull()).alias("fn"))
    prec = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(1.0)
    rec = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(1.0)
    out = c.withColumn("precision", prec).withColumn("recall", rec)
    return out.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                       2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
                          .otherwise(0.0))


def missing_labels(pred: DataFrame, gold: DataFrame, cols: list[str]) -> DataFrame:
    """Expected-but-missed (fn) and detected-but-unexpected (fp) rows: EXCEPT ALL
    both ways, as one count per row (both sides are computed once)."""
    both = gold.select(*cols, F.lit(1).alias("_n")).unionByName(pred.select(*cols, F.lit(-1).alias("_n")))
    left = both.groupBy(*cols).agg(F.sum("_n").alias("_n")).where(F.col("_n") != 0)
    kind = F.when(F.col("_n") > 0, "fn").otherwise("fp").alias("kind")
    return left.select(*cols, kind, F.explode(F.sequence(F.lit(1).cast("long"), F.abs("_n"))).alias("_i")).drop("_i")


def semantic_breaks(sentences: DataFrame, doc: str, order: str, vec: str = "unit",
                    pct: float = SEMANTIC_PERCENTILE, approx: bool = False) -> DataFrame:
    """Distance to the next sentence (1 - cosine of unit vectors); a chunk ends
    where that distance is above the document's ``pct`` percentile (linear
    interpolation); chunk id = breaks so far."""
    return breaks_at(neighbour_distances(sentences, doc, order, vec), doc, order, pct, approx)


def neighbour_distances(sentences: DataFrame, doc: str, order: str, vec: str = "unit") -> DataFrame:
    """Adds ``dist``: 1 - cosine of a sentence's unit vector and the next one's."""
    nxt = F.lead(vec).over(Window.partitionBy(doc).orderBy(order))
    return sentences.withColumn("dist", 1 - F.aggregate(F.zip_with(vec, nxt, lambda a, b: a * b), F.lit(0.0),
                                                        lambda s, x: s + x))


def breaks_at(d: DataFrame, doc: str, order: str, pct: float = SEMANTIC_PERCENTILE, approx: bool = False) -> DataFrame:
    """Adds ``thr`` and ``chunk_id`` to sentences with their ``dist`` to the next one."""
    w = Window.partitionBy(doc).orderBy(order)
    if approx:
        thr = d.groupBy(doc).agg(F.percentile_approx("dist", pct, 100_000).alias("thr"))
    else:
        thr = quantiles(d.select(doc, "dist"), [doc], "dist", [pct]).select(doc, F.col("q")[0].alias("thr"))
    j = d.join(thr, doc, "left").withColumn("brk", (F.col("dist") > F.col("thr")).cast("int"))
    prev = F.coalesce(F.sum("brk").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return j.withColumn("chunk_id", prev).drop("brk")


def append_audit(rows: DataFrame, path: str, detail_cols: list[str]) -> DataFrame:
    """Insert-only audit sink: detail columns are PII-masked, rows appended."""
    mask_pii(rows, detail_cols).write.mode("append").parquet(path)
    return rows.sparkSession.read.parquet(path)


def export_csv(rows: DataFrame, path: str) -> str:
    """CSV export with a header; nulls written as empty strings."""
    out = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in rows.columns])
    out.write.mode("overwrite").option("header", True).csv(path)
    return path


def snapshot_manifest(df: DataFrame, name: str, cap: int = SNAPSHOT_ROWS) -> DataFrame:
    """Manifest of a stored result: its name, true row count, stored rows
    (at most ``cap``) and column list."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(name).alias("name"), "row_count", F.least(F.col("row_count"), F.lit(cap)).alias("stored_rows"),
        F.array(*[F.lit(c) for c in df.columns]).alias("columns"))


def purge(tables: dict[str, DataFrame], key: str, ids: DataFrame) -> dict[str, DataFrame]:
    """Drop every row of every dependent table whose key is in ``ids``."""
    return {n: t.join(ids.select(key).distinct(), key, "left_anti") for n, t in tables.items()}


def retention_sweep(uploads: DataFrame, dependents: DataFrame, key: str, ts: str, now,
                    hours: int = UPLOAD_TTL_HOURS):
    """Uploads whose TTL elapsed are removed with their dependent rows; rows
    without an expiry are kept. Returns (kept uploads, kept dependents)."""
    exp = F.col(ts) + F.make_dt_interval(hours=F.lit(hours))
    gone = uploads.where(F.col(ts).isNotNull() & (exp <= now)).select(key).distinct()
    return uploads.join(gone, key, "left_anti"), dependents.join(gone, key, "left_anti")


def fields_report(fields: DataFrame, key: str = "doc_id", order: str = "ix") -> DataFrame:
    """Verified fields as ``  - name: value unit (span: "...")`` lines under a
    header, per document; value shown with two decimals unless the unit is
    ``n/a`` (then the first 80 span characters)."""
    v = fields.where(F.col("verified"))
    val = F.when(F.col("unit") != "n/a", F.format_number("value", 2)).otherwise(F.substring("span_text", 1, 80))
    line = F.concat(F.lit("  - "), F.col("name"), F.lit(": "), val, F.lit(" "), F.col("unit"),
                    F.lit(' (span: "'), F.substring("span_text", 1, 80), F.lit('")'))
    agg = v.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, line.alias("l")))).alias("_l"))
    return agg.select(key, F.concat(F.lit("Structured values extracted from this document (span-verified):\n"),
                                    F.array_join(F.transform("_l", lambda x: x["l"]), "\n")).alias("report"))
