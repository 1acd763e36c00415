"""Column profiling: describe, null %, low cardinality, correlations,
histogram, datetime detection, frequency inference, majority-numeric casts.

Each profile is one aggregation pass over the table (all columns at once)
followed by an unpivot of the single result row into long form
``(column, ...)`` — no per-column jobs, no pandas; exact percentiles come from a
distributed selection over all columns together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import strip_ws
from .selection import quantiles

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)

# FIXED VALUES — thresholds
LOW_CARD_MAX = 15
_QUARTILES = [0.25, 0.5, 0.75]
DATETIME_NAME_KEYS = ["date", "time", "timestamp"]
DATETIME_PARSE_SHARE = 0.7
NUMERIC_MAJORITY = 0.5
DATETIME_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy"]


def parse_datetime(c: Column) -> Column:
    """Timestamp from the common export layouts (ISO date / date-time, US date)."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in DATETIME_FORMATS])


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC)]


def _unpivot(row: DataFrame, cols: list[str], fields: list[str]) -> DataFrame:
    """Single-row frame with columns ``{c}__{f}`` -> one row per column."""
    arr = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{c}__{f}").alias(f) for f in fields])
                    for c in cols])
    return row.select(F.explode(arr).alias("r")).select("r.*")


def describe_numeric(df: DataFrame, cols: list[str] | None = None, approx: bool = False,
                     accuracy: int = 10_000, exact_scale: int | None = None) -> DataFrame:
    """count, mean, std (sample), min, 25/50/75 % (linear interpolation), max.
    The percentiles are exact, by distributed selection (``operators.selection``:
    no column in one buffer); ``approx=True`` swaps them for ``percentile_approx``. ``exact_scale=s`` (columns with
    at most ``s`` decimals, e.g. money) accumulates the mean as a sum of scaled
    integers, so it does not depend on the order partial sums are combined."""
    cols = cols or numeric_columns(df)
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        if exact_scale is None:
            mean = F.avg(x)
        else:
            k = 10 ** exact_scale
            mean = F.sum(F.round(x * k).cast("long")) / F.count(x) / k
        aggs += [F.count(x).alias(f"{c}__count"), mean.alias(f"{c}__mean"),
                 F.stddev_samp(x).alias(f"{c}__std"), F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max")]
        if approx:
            aggs.append(F.percentile_approx(x, _QUARTILES, accuracy).alias(f"{c}__q"))
    fields = ["count", "mean", "std", "min", *(["q"] if approx else []), "max"]
    out = _unpivot(df.agg(*aggs), cols, fields)
    if not approx:
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols])).alias("x")
        long = df.select(cells).select("x.column", "x.value")
        out = out.join(quantiles(long, ["column"], "value", _QUARTILES).drop("n"), "column", "left")
    return out.select("column", "count", "mean", "std", "min", *[F.col("q")[i].alias(f"p{p}") for i, p in enumerate((25, 50, 75))], "max")


def null_percentages(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Null share per column in percent (1 decimal, half-even), only when > 0."""
    cols = cols or df.columns
    n = F.count(F.lit(1))
    row = df.agg(*[F.bround(F.count_if(F.col(c).isNull()) / F.greatest(n, F.lit(1)) * 100.0, 1)
                   .alias(f"{c}__null_pct") for c in cols])
    return _unpivot(row, cols, ["null_pct"]).where(F.col("null_pct") > 0)


def low_cardinality(df: DataFrame, cols: list[str] | None = None, k: int = LOW_CARD_MAX) -> DataFrame:
    """Columns with 1..k distinct non-null values and those values (as strings,
    sorted). A cheap ``approx_count_distinct`` pass gates which columns get the
    exact ``collect_set`` (whose size is then bounded by ~2k)."""
    cols = cols or df.columns
    approx = df.agg(*[F.approx_count_distinct(c, 0.05).alias(c) for c in cols]).first()
    cand = [c for c in cols if approx[c] is not None and 0 < approx[c] <= 2 * k]
    if not cand:
        return df.sparkSession.createDataFrame([], "column string, n_unique long, values array<string>")
    row = df.agg(*[F.collect_set(F.col(c).cast("string")).alias(f"{c}__set") for c in cand])
    for c in cand:
        row = row.withColumn(f"{c}__n_unique", F.size(f"{c}__set").cast("long")).withColumn(
            f"{c}__values", F.array_sort(f"{c}__set"))
    out = _unpivot(row, cand, ["n_unique", "values"])
    return out.where((F.col("n_unique") > 0) & (F.col("n_unique") <= k))


def correlation_matrix(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Pearson correlation for every ordered column pair, one aggregation."""
    cols = cols or numeric_columns(df)
    pairs = [(a, b) for a in cols for b in cols]
    row = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}__corr")
                   for a, b in pairs])
    arr = F.array(*[F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"`{a}|{b}__corr`").alias("corr"))
                    for a, b in pairs])
    return row.select(F.explode(arr).alias("r")).select("r.*")


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Equal-width bins over [min, max]; the last bin is closed on the right."""
    x = F.col(col).cast("double")
    lo, hi = df.agg(F.min(x), F.max(x)).first()    # two numbers: the bin edges
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, bin_lo double, bin_hi double, n long")
    width = (hi - lo) / bins
    b = (F.lit(0) if hi == lo else F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(bins - 1))).cast("int")
    counts = df.where(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_lo"),
                         (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("bin_hi"), "n")


def infer_frequency(df: DataFrame, key: list[str], ts: str) -> DataFrame:
    """Series frequency when there are >= 3 distinct timestamps at a regular
    spacing: month starts one month apart -> ``MS``; a constant step of one
    day / hour / minute / second -> ``D`` / ``h`` / ``min`` / ``s``, k of them
    -> ``kD`` etc., seven days -> ``W``; otherwise null."""
    d = df.select(*key, F.col(ts).cast("timestamp").alias("_t")).where(F.col("_t").isNotNull()).distinct()
    w = Window.partitionBy(*key).orderBy("_t")
    steps = (d.withColumn("_prev", F.lag("_t").over(w))
             .withColumn("_sec", F.unix_micros("_t") - F.unix_micros("_prev"))
             .withColumn("_mon", F.months_between("_t", "_prev")))
    agg = steps.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.min("_sec").alias("smin"), F.max("_sec").alias("smax"),
        F.min("_mon").alias("mmin"), F.max("_mon").alias("mmax"),
        F.min(F.dayofmonth("_t")).alias("dmin"), F.max(F.dayofmonth("_t")).alias("dmax"),
        F.max(F.date_format("_t", "HH:mm:ss.SSSSSS")).alias("tmax"),
        F.min(F.date_format("_t", "HH:mm:ss.SSSSSS")).alias("tmin"))
    s = F.col("smin")
    unit = (F.when(s % 86_400_000_000 == 0, F.when(s == 7 * 86_400_000_000, F.lit("W"))
                   .when(s == 86_400_000_000, F.lit("D"))
                   .otherwise(F.concat((s / 86_400_000_000).cast("long").cast("string"), F.lit("D"))))
            .when(s % 3_600_000_000 == 0, F.when(s == 3_600_000_000, F.lit("h"))
                  .otherwise(F.concat((s / 3_600_000_000).cast("long").cast("string"), F.lit("h"))))
            .when(s % 60_000_000 == 0, F.when(s == 60_000_000, F.lit("min"))
                  .otherwise(F.concat((s / 60_000_000).cast("long").cast("string"), F.lit("min"))))
            .when(s % 1_000_000 == 0, F.when(s == 1_000_000, F.lit("s"))
                  .otherwise(F.concat((s / 1_000_000).cast("long").cast("string"), F.lit("s")))))
    monthly = ((F.col("dmin") == 1) & (F.col("dmax") == 1) & (F.col("mmin") == 1) & (F.col("mmax") == 1)
               & (F.col("tmin") == F.col("tmax")))
    freq = (F.when(F.col("n") < 3, F.lit(None)).when(monthly, F.lit("MS"))
            .when(F.col("smin") == F.col("smax"), unit))
    return agg.select(*key, "n", freq.alias("freq"))


def is_datetime_column(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """A column is datetime when its name holds date/time/timestamp, or it is a
    text column whose non-null values parse as timestamps more than 70 % of
    the time."""
    cols = cols or df.columns
    kinds = {f.name: f.dataType for f in df.schema.fields}
    aggs = []
    for c in cols:
        if isinstance(kinds[c], T.StringType):
            aggs += [F.count(parse_datetime(strip_ws(F.col(c)))).alias(f"{c}__ok"),
                     F.count(F.col(c)).alias(f"{c}__nn")]
    row = df.agg(*aggs).first() if aggs else None
    out = []
    for c in cols:
        by_name = any(k in c for k in DATETIME_NAME_KEYS)
        by_parse = False
        if row is not None and f"{c}__ok" in row.asDict():
            by_parse = row[f"{c}__ok"] / max(row[f"{c}__nn"], 1) > DATETIME_PARSE_SHARE
        out.append((c, bool(by_name or by_parse or isinstance(kinds[c], (T.TimestampType, T.DateType)))))
    return df.sparkSession.createDataFrame(out, "column string, is_datetime boolean")


def numeric_if_majority(df: DataFrame, cols: list[str] | None = None, share: float = NUMERIC_MAJORITY) -> DataFrame:
    """Cast text columns to double when more than ``share`` of their non-null
    values parse after removing ``,`` ``$`` ``%`` (one counting pass)."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    cols = [c for c in (cols or df.columns) if isinstance(kinds[c], T.StringType)]
    parsed = {c: F.regexp_replace(strip_ws(F.col(c)), r"[,$%]", "").try_cast("double") for c in cols}
    if not cols:
        return df
    row = df.agg(*[F.count(parsed[c]).alias(f"{c}__ok") for c in cols],
                 *[F.count(F.col(c)).alias(f"{c}__nn") for c in cols]).first()
    flip = {c for c in cols if row[f"{c}__nn"] and row[f"{c}__ok"] / row[f"{c}__nn"] > share}
    return df.select(*[parsed[c].alias(c) if c in flip else F.col(c) for c in df.columns])


def profile_table(df: DataFrame, exact_scale: int | None = None) -> DataFrame:
    """One-call profile in long form: per column its type, null %, distinct
    count (approximate, HLL), and numeric min/mean/max; rows/columns on every
    row. One aggregation pass."""
    cols = df.columns
    nums = set(numeric_columns(df))
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for c in cols:
        aggs += [F.count_if(F.col(c).isNull()).alias(f"{c}__nulls"),
                 F.approx_count_distinct(c).alias(f"{c}__distinct")]
        if c in nums:
            x = F.col(c).cast("double")
            mean = F.avg(x) if exact_scale is None else (
                F.sum(F.round(x * 10 ** exact_scale).cast("long")) / F.count(x) / 10 ** exact_scale)
            aggs += [F.min(x).alias(f"{c}__min"), mean.alias(f"{c}__mean"),
                     F.max(F.col(c).cast("double")).alias(f"{c}__max")]
        else:
            aggs += [F.lit(None).cast("double").alias(f"{c}__min"), F.lit(None).cast("double").alias(f"{c}__mean"),
                     F.lit(None).cast("double").alias(f"{c}__max")]
    row = df.agg(*aggs)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    for c in cols:
        row = (row.withColumn(f"{c}__dtype", F.lit(types[c]))
               .withColumn(f"{c}__null_pct",
                           F.bround(F.col(f"{c}__nulls") / F.greatest(F.col("__rows"), F.lit(1)) * 100, 1))
               .withColumn(f"{c}__row_count", F.col("__rows"))
               .withColumn(f"{c}__column_count", F.lit(len(cols))))
    return _unpivot(row, cols, ["dtype", "null_pct", "distinct", "min", "mean", "max", "row_count", "column_count"])
