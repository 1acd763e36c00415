"""Loose CSV reading and multi-section (gaps-and-islands) detection.

A CSV file is read in splits, by as many tasks as it has. Where a row begins
depends on whether a quoted cell is open, which a split cannot know of its own
start; so each split is summed up for both cases (does it end inside quotes, how
many rows begin in it), the few summaries of a file are chained (a prefix scan
over its splits), and each split then numbers its lines by itself. Lines that
are whole rows are parsed where they are; only the lines of rows with line
breaks in them are gathered, per row.

Everything after that is joins keyed by (file, row): a section is an island
that starts at a title row; its header is looked up among the next few rows with
an equi-join (no row x row pairs, no window over the rows of a file).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import clean_column_name, strip_ws
from ..session import materialize

# FIXED VALUES — section title pattern and thresholds
SECTION_TITLE = r"(?i)^\s*(EXHIBIT|SHEET|TABLE|SECTION|APPENDIX|SCHEDULE|PART)\s*\d*\s*[:\-.\s]"
TITLE_MAX_SHARE = 0.3        # a title row has at most max(3, 30 % of width) filled cells
HEADER_MIN_SHARE = 0.3       # a header row has at least max(2, 30 % of width) filled cells
HEADER_SCAN = 4              # rows looked at after a title
SINGLE_HEADER_SCAN = 5       # rows looked at in a one-table file
TITLE_CHARS = 120
MULTI_TABLE_KEYWORDS = ["EXHIBIT", "SHEET", "TABLE"]


# codes of a line: an all-blank row, a whole row, part of a row over several lines
_BLANK, _WHOLE, _PART = 0, 1, 2


def _closing(line: bytes, at: int) -> int:
    """Place after the quote that closes a quoted cell whose text goes on at ``at``; -1: none."""
    while True:
        q = line.find(b'"', at)
        if q < 0 or line[q + 1:q + 2] != b'"':
            return q + 1 if q >= 0 else -1
        at = q + 2


def ends_open(line: bytes, is_open: bool) -> bool:
    """Is a quoted cell open at the line's end? Quotes count at a cell's start
    only; doubled ones inside a quoted cell are text."""
    at = 0
    if is_open:
        at = _closing(line, 0)
        if at < 0:
            return True
        at = line.find(b",", at) + 1
        if not at:
            return False
    while True:
        q = line.find(b'"', at)
        if q < 0:
            return False
        after = q
        if q == at or line[q - 1] == 0x2C:
            after = _closing(line, q + 1)
            if after < 0:
                return True
        at = line.find(b",", after) + 1
        if not at:
            return False


class _Split:
    """What is known of a split after some of its lines, for a start outside (0)
    and inside (1) of a quoted cell: open now, rows begun, lines of longer rows."""

    def __init__(self, key):
        self.key, self.open, self.rows, self.parts, self.lines = key, [False, True], [0, 0], [0, 0], 0
        self.width, self.utf8 = 1, True

    def add(self, lines: pa.Array):
        """(rows begun, code) of every line in both cases."""
        n = len(lines)
        commas, size = np.asarray(pc.count_substring(lines, ",")), np.asarray(pc.binary_length(lines))
        self.width = max(self.width, int(commas.max(initial=0)) + 1)
        quoted = np.flatnonzero(np.asarray(pc.match_substring(lines, '"')))
        states = [[self.open[0]], [self.open[1]]]
        for line in lines.take(pa.array(quoted)).to_pylist():
            was = [s[-1] for s in states]
            first = ends_open(line, was[0])
            states[0].append(first)
            states[1].append(first if was[1] == was[0] else ends_open(line, was[1]))
        out, each = [], np.diff(np.concatenate([[0], quoted + 1, [n]]))
        for k in (0, 1):
            before = np.repeat(np.array(states[k]), each)       # up to a quoted line, and from the next one on
            ends = before.copy()
            ends[quoted] = states[k][1:]
            code = np.where(before | ends, _PART, np.where(commas == size, _BLANK, _WHOLE))
            begun = self.rows[k] + np.cumsum(~before & (code != _BLANK))
            self.rows[k] = int(begun[-1]) if n else self.rows[k]
            self.parts[k] += int((code == _PART).sum())
            self.open[k] = states[k][-1]
            out += [begun, code.astype(np.int8)]
        self.lines += n
        return out


def _by_split(batches):
    """(split, lines, valid UTF-8?) of each run of lines of one split."""
    now = None
    for b in batches:
        files, blocks = b.column(0), np.asarray(b.column(1))
        names = files.dictionary_encode().indices.to_numpy(zero_copy_only=False) if b.num_rows else np.zeros(0)
        cut = np.flatnonzero(np.concatenate([[True], (blocks[1:] != blocks[:-1]) | (names[1:] != names[:-1])])) if b.num_rows else []
        for lo, hi in zip(cut, [*cut[1:], b.num_rows]):
            key = files[lo].as_py(), int(blocks[lo])
            if now is None or now.key != key:
                if now is not None:
                    yield now, None, None
                now = _Split(key)
            yield now, b.column(2).slice(lo, hi - lo), b.column(3).slice(lo, hi - lo)
    if now is not None:
        yield now, None, None


def _lines(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("blk"),
                      F.col("value").cast("binary").alias("line"), F.is_valid_utf8("value").alias("utf8"))


def split_summaries(lines: DataFrame) -> DataFrame:
    """One row per split: (file, blk, open_0, open_1, rows_0, rows_1, parts_0, parts_1, width, utf8)."""

    def run(batches):
        for split, part, utf8 in _by_split(batches):
            if part is not None:
                split.add(part)
                split.utf8 &= bool(np.asarray(utf8).all())
                continue
            yield pa.RecordBatch.from_pylist([{"file": split.key[0], "blk": split.key[1], **{f"{c}_{k}": getattr(split, c)[k] for c in ("open", "rows", "parts") for k in (0, 1)},
                                               "width": split.width, "utf8": split.utf8}], schema)

    kinds = {"open": pa.bool_(), "rows": pa.int64(), "parts": pa.int64()}
    schema = pa.schema([("file", pa.string()), ("blk", pa.int64()), *[(f"{c}_{k}", t) for c, t in kinds.items() for k in (0, 1)], ("width", pa.int64()), ("utf8", pa.bool_())])
    return lines.mapInArrow(run, "file string, blk long, open_0 boolean, open_1 boolean, rows_0 long, rows_1 long, parts_0 long, parts_1 long, width long, utf8 boolean")


def chained(splits: DataFrame) -> DataFrame:
    """(file, blk, is_open, first_row, parts, width, utf8): each split's start,
    from those before it. A split leaves the state as it is, flips it or (with a
    quote that closes) sets it; the state is that of the last one that set it,
    flipped as often as since. ``utf8`` holds for the whole file."""
    before = Window.partitionBy("file").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    flips = F.when(F.col("open_0") & ~F.col("open_1"), 1).otherwise(0)
    s = splits.withColumn("flips", F.coalesce(F.sum(flips).over(before), F.lit(0)))
    s = s.withColumn("fixed", F.last(F.when(F.col("open_0") == F.col("open_1"), F.struct("open_0", "flips")), ignorenulls=True).over(before))
    flipped = (F.col("flips") - F.coalesce("fixed.flips", F.lit(0))) % 2 == 1
    s = s.withColumn("is_open", F.coalesce("fixed.open_0", F.lit(False)) != flipped)
    rows, parts = (F.when(F.col("is_open"), F.col(f"{c}_1")).otherwise(F.col(f"{c}_0")) for c in ("rows", "parts"))
    s = s.withColumn("rows", rows)
    return s.select("file", "blk", "is_open", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first_row"), parts.alias("parts"), "width",
                    F.min("utf8").over(Window.partitionBy("file")).alias("utf8"))


def _numbered(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """(file, blk, ix, row_ix, code, text) of every line that is not a blank row."""

    def run(batches):
        for split, part, _ in _by_split(batches):
            if part is None or not len(part):
                continue
            first = split.lines
            found = split.add(part)
            yield pa.RecordBatch.from_arrays([pa.array([split.key[0]] * len(part)), pa.array(np.full(len(part), split.key[1])), pa.array(np.arange(first, first + len(part))),
                                              part.cast(pa.binary()), *[pa.array(x) for x in found]], names=["file", "blk", "ix", "line", "begun_0", "code_0", "begun_1", "code_1"])

    got = lines.mapInArrow(run, "file string, blk long, ix long, line binary, begun_0 long, code_0 byte, begun_1 long, code_1 byte")
    # a split's lines stay where they are if Spark finds the summaries small enough to send
    both = got.join(starts, ["file", "blk"])
    begun, code = (F.when(F.col("is_open"), F.col(f"{c}_1")).otherwise(F.col(f"{c}_0")) for c in ("begun", "code"))
    text = F.when(F.col("utf8"), F.col("line").cast("string")).otherwise(F.decode("line", "ISO-8859-1"))
    return both.select("file", "blk", "ix", (F.col("first_row") + begun - 1).alias("row_ix"), code.alias("code"), text.alias("text")).where(F.col("code") != _BLANK)


def read_csv_loose(spark: SparkSession, path: str) -> DataFrame:
    """Header-less, all-string read. Rows may be shorter or longer than the
    first one (the table is as wide as its widest row), cells may hold line
    breaks and doubled quotes; files that are not valid UTF-8 are read as
    latin-1. BOM removed; all-blank rows and all-blank columns (per file) dropped.
    Output: file, row_ix (0-based, after blank rows are dropped), cells."""
    lines = _lines(spark, path)
    starts = materialize(chained(split_summaries(lines)), "csv-splits")
    width, parts = starts.agg(F.coalesce(F.max("width"), F.lit(1)), F.coalesce(F.sum("parts"), F.lit(0))).first()
    numbered = _numbered(lines, starts.drop("parts", "width"))
    rows = numbered.where(F.col("code") == _WHOLE).select("file", "row_ix", "text")
    if parts:
        several = (numbered.where(F.col("code") == _PART).groupBy("file", "row_ix")
                   .agg(F.array_sort(F.collect_list(F.struct("blk", "ix", "text"))).alias("lines")))
        rows = rows.unionByName(several.select("file", "row_ix", F.array_join(F.transform("lines", lambda x: x["text"]), "\n").alias("text")))
    cols = [f"_c{i}" for i in range(width)]
    parsed = F.from_csv("text", ", ".join(f"{c} string" for c in cols), {"mode": "PERMISSIVE", "escape": '"', "maxColumns": str(width + 1)})
    rows = rows.select("file", "row_ix", parsed.alias("_r"))
    r = rows.select("file", "row_ix", F.array(*[F.regexp_replace(F.col(f"_r.{c}"), "^\ufeff", "") if i == 0 else F.col(f"_r.{c}") for i, c in enumerate(cols)]).alias("cells"))
    keep = r.groupBy("file").agg(*[F.max(F.col("cells")[i].isNotNull()).alias(f"k{i}") for i in range(len(cols))])
    keep = keep.select("file", F.array(*[F.col(f"k{i}") for i in range(len(cols))]).alias("keep"))
    return (r.join(keep, "file")
            .select("file", "row_ix", F.filter("cells", lambda x, i: F.element_at("keep", i + 1)).alias("cells")))


def _nonnull(cells: Column) -> Column:
    return F.size(F.filter(cells, lambda x: x.isNotNull()))


def _is_numeric(s: Column) -> Column:
    return F.regexp_replace(s, r"[,$%]", "").try_cast("double").isNotNull()


def row_flags(raw: DataFrame) -> DataFrame:
    """Adds width, is_title and is_header per row."""
    width = F.size("cells")
    cell0 = strip_ws(F.coalesce(F.col("cells")[0], F.lit("")))
    nn = _nonnull(F.col("cells"))
    is_title = ((cell0 != "") & (F.lower(cell0) != "nan") & cell0.rlike(SECTION_TITLE)
                & (nn <= F.greatest(F.lit(3.0), width * TITLE_MAX_SHARE)))
    first5 = F.slice(F.filter("cells", lambda x: x.isNotNull()), 1, 5)
    vals = F.filter(F.transform(first5, lambda x: strip_ws(x)), lambda x: x != "")
    alpha = F.size(F.filter(vals, lambda x: ~_is_numeric(x)))
    is_header = (nn >= F.greatest(F.lit(2.0), width * HEADER_MIN_SHARE)) & (alpha >= 2)
    return raw.select("file", "row_ix", "cells", width.alias("width"), is_title.alias("is_title"),
                      is_header.alias("is_header"), F.substring(cell0, 1, TITLE_CHARS).alias("title"))


def header_columns(cells: Column) -> Column:
    """Cleaned names, trailing blanks dropped; all blank -> col_0..col_{n-1}."""
    names = F.transform(cells, lambda v: F.when(
        v.isNull() | (strip_ws(v) == "") | (F.lower(strip_ws(v)) == "nan"), F.lit("")).otherwise(clean_column_name(v)))
    # index of the last non-blank name (0 when none)
    last = F.aggregate(F.transform(names, lambda x, i: F.when(x != "", i + 1).otherwise(0)), F.lit(0),
                       lambda a, x: F.greatest(a, x))
    generic = F.transform(cells, lambda x, i: F.concat(F.lit("col_"), i.cast("string")))
    return F.when(last == 0, generic).otherwise(F.slice(names, 1, last))


def csv_sections(raw: DataFrame) -> DataFrame:
    """Sections per file: index, name, title/header/data row positions,
    columns and row count. Files without a title row are one ``data`` section."""
    flags = materialize(row_flags(raw).drop("cells", "width"), "csv-flags")
    n = flags.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    titles = flags.where("is_title").select("file", F.col("row_ix").alias("title_row_idx"), F.col("title").alias("name"))
    wt = Window.partitionBy("file").orderBy("title_row_idx")
    titles = (titles.join(n, "file")
              .withColumn("index", (F.row_number().over(wt) - 1).cast("int"))
              .withColumn("data_end_idx", F.coalesce(F.lead("title_row_idx").over(wt), F.col("n"))))
    no_title = n.join(titles.select("file").distinct(), "file", "left_anti")
    single = no_title.select("file", F.lit(0).cast("int").alias("index"), F.lit("data").alias("name"),
                             F.lit(0).cast("long").alias("title_row_idx"), F.col("n").alias("data_end_idx"), "n",
                             F.lit(SINGLE_HEADER_SCAN).alias("_limit"), F.lit(0).cast("long").alias("_start"))
    multi = titles.select("file", "index", "name", "title_row_idx", "data_end_idx", "n",
                          F.greatest(F.least(F.lit(HEADER_SCAN), F.col("data_end_idx") - F.col("title_row_idx") - 1),
                                     F.lit(1)).alias("_limit"),
                          (F.col("title_row_idx") + 1).alias("_start"))
    secs = multi.unionByName(single)
    cand = (secs.select("file", "index", "_start", "n", F.explode(F.sequence(F.lit(0), F.col("_limit") - 1)).alias("_o"))
            .withColumn("row_ix", F.col("_start") + F.col("_o")).where(F.col("row_ix") < F.col("n"))
            .join(flags.select("file", "row_ix", "is_header"), ["file", "row_ix"])
            .where("is_header").groupBy("file", "index").agg(F.min("row_ix").alias("_hdr")))
    s = secs.join(cand, ["file", "index"], "left").withColumn("_h", F.coalesce("_hdr", "_start"))
    is_multi = F.col("name") != "data"
    hdr = (F.when(is_multi & (F.col("_h") >= F.col("data_end_idx")),
                  F.when(F.col("title_row_idx") + 1 < F.col("data_end_idx"), F.col("title_row_idx") + 1)
                  .otherwise(F.col("title_row_idx")))
           .otherwise(F.col("_h")))
    s = s.withColumn("header_row_idx", hdr.cast("long"))
    s = s.withColumn("_crow", F.least(F.col("header_row_idx"), F.col("n") - 1))
    cells = raw.select("file", F.col("row_ix").alias("_crow"), "cells")
    s = s.join(cells, ["file", "_crow"], "left").withColumn("columns", header_columns(F.col("cells")))
    return s.select("file", "index", "name", "title_row_idx", "header_row_idx",
                    (F.col("header_row_idx") + 1).alias("data_start_idx"), F.col("data_end_idx").cast("long"),
                    "columns",
                    F.greatest(F.col("data_end_idx") - F.col("header_row_idx") - 1, F.lit(0)).cast("long")
                    .alias("row_count"))


def load_section(raw: DataFrame, sections: DataFrame, file: str, index: int) -> DataFrame:
    """One section as a table: header promoted to column names (blank names
    dropped), all-blank rows/columns removed, majority-numeric columns cast, in file order."""
    from ..operators.profile import numeric_if_majority
    sec = sections.where((F.col("file") == file) & (F.col("index") == index)).first()
    rows = raw.where((F.col("file") == file) & (F.col("row_ix") >= sec["data_start_idx"])
                     & (F.col("row_ix") < sec["data_end_idx"]))
    names = list(sec["columns"])
    width = len(rows.first()["cells"]) if rows.first() else len(names)
    names = names[:width] + [f"col_{i}" for i in range(width - len(names))] if len(names) < width else names[:width]
    keep = [(i, c) for i, c in enumerate(names) if c not in ("nan", "none", "")]
    t = rows.select("row_ix", *[F.col("cells")[i].alias(c) for i, c in keep])
    t = t.where(F.exists(F.array(*[F.col(c) for _, c in keep]), lambda x: x.isNotNull()))
    return numeric_if_majority(t, [c for _, c in keep]).orderBy("row_ix").drop("row_ix")


INVENTORY_BLOCK = 4096      # rows that share a block key when rows meet their section


def section_inventory(raw: DataFrame, sections: DataFrame) -> DataFrame:
    """(file, table_name, ordinal, column_name, data_type) of every section's
    columns: ``double`` where more than half of the non-blank cells are numbers
    (after removing ``, $ %``), else ``text``. Rows meet their section by blocks
    of row numbers; a column without a cell is ``text``."""
    block = F.floor(F.col("row_ix") / INVENTORY_BLOCK)
    spans = sections.select("file", "index", F.col("name").alias("table_name"), "columns", "data_start_idx", "data_end_idx")
    used = spans.where(F.col("data_end_idx") > F.col("data_start_idx")).select("file", "index", "data_start_idx", "data_end_idx", F.explode(
        F.sequence(F.floor(F.col("data_start_idx") / INVENTORY_BLOCK), F.floor((F.col("data_end_idx") - 1) / INVENTORY_BLOCK))).alias("_b"))
    rows = raw.select("file", "row_ix", "cells", block.alias("_b")).join(used, ["file", "_b"]).where("row_ix >= data_start_idx and row_ix < data_end_idx")
    cells = rows.select("file", "index", F.posexplode("cells").alias("pos", "cell")).where(F.col("cell").isNotNull())
    kinds = cells.groupBy("file", "index", "pos").agg((F.count_if(_is_numeric(strip_ws(F.col("cell")))) > F.count(F.lit(1)) * 0.5).alias("number"))
    cols = spans.select("file", "index", "table_name", F.posexplode("columns").alias("pos", "column_name")).where("column_name <> ''")
    return cols.join(kinds, ["file", "index", "pos"], "left").select(
        "file", "table_name", F.col("pos").alias("ordinal"), "column_name", F.when(F.col("number"), "double").otherwise("text").alias("data_type"))


def section_manifest(sections: DataFrame) -> DataFrame:
    """Text manifest per file (bounded: at most 2500 characters; only the first
    sections that fit are gathered)."""
    def cols(k):
        more = F.when(F.size("columns") > k, F.format_string(" (+%d more)", F.size("columns") - k)).otherwise("")
        return F.concat(F.array_join(F.slice("columns", 1, k), ", "), more)
    nsec = Window.partitionBy("file")
    s = sections.withColumn("_ns", F.count(F.lit(1)).over(nsec))
    one = F.concat(F.lit("Single-table CSV — columns: "), cols(10), F.lit(" ("), F.col("row_count").cast("string"),
                   F.lit(" rows)"))
    line = F.format_string('Section %d (row %d): "%s"\n  Columns: %s\n  Data rows: %d-%d (%d rows)',
                           "index", "title_row_idx", "name", cols(8), "data_start_idx",
                           F.col("data_end_idx") - 1, "row_count")
    s = s.withColumn("_line", F.when(F.col("_ns") == 1, one).otherwise(line)).where(F.col("index") < 2500 // 40 + 1)
    agg = s.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("index", "_line"))).alias("_l"))
    return agg.select("file", F.substring(F.array_join(F.transform("_l", lambda x: x["_line"]), "\n\n"), 1, 2500)
                      .alias("manifest"))


def looks_multi_table(raw: DataFrame) -> DataFrame:
    """A file whose first row (taken as header) names more than half of its
    columns blank/``unnamed``, plus its rows whose first cell mentions
    EXHIBIT / SHEET / TABLE."""
    first = raw.where(F.col("row_ix") == 0).select(
        "file", F.size(F.filter("cells", lambda x: x.isNull() | (strip_ws(x) == ""))).alias("_blank"),
        F.size("cells").alias("_w"))
    marks = raw.where(F.col("row_ix") > 0).where(F.exists(F.array(*[F.lit(k) for k in MULTI_TABLE_KEYWORDS]),
                               lambda k: F.instr(F.upper(F.coalesce(F.col("cells")[0], F.lit(""))), k) > 0))
    nmarks = marks.groupBy("file").agg(F.count(F.lit(1)).alias("section_markers"))
    return (first.join(nmarks, "file", "left")
            .select("file", (F.col("_blank") > F.col("_w") * 0.5).alias("is_multi_table"),
                    F.coalesce("section_markers", F.lit(0)).alias("section_markers")))
