"""CSV fixtures: multi-section, BOM, messy headers, single table."""

from pyspark.sql import functions as F

from xcheck.sources import csvio as CV

MULTI = ("TABLE 1: Sales,,\nProduct,Revenue,Units\nA,100,1\nB,200,2\nC,300,3\n"
         "EXHIBIT 2: Costs,,\nItem,Cost,Qty\nX,10,1\nY,20,2\n")
SIMPLE = "product,revenue,units,date\nA,100,1,2024-01-01\nB,200,2,2024-02-01\nC,300,3,2024-03-01\n"
BOM = "﻿name,value\nx,1\ny,2\n"
MESSY = '  Product Name ,  Revenue , Notes\nWidget,"1,000",ok\nGadget,"2,500","has, comma"\n'


def _write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text, encoding="utf-8")
    return str(p)


def test_multi_section(spark, tmp_path):
    raw = CV.read_csv_loose(spark, _write(tmp_path, "multi.csv", MULTI))
    s = [r.asDict() for r in CV.csv_sections(raw).orderBy("index").collect()]
    assert len(s) == 2
    assert (s[0]["name"], s[0]["title_row_idx"], s[0]["header_row_idx"], s[0]["data_start_idx"],
            s[0]["data_end_idx"], s[0]["row_count"]) == ("TABLE 1: Sales", 0, 1, 2, 5, 3)
    assert s[0]["columns"] == ["product", "revenue", "units"]
    assert (s[1]["name"], s[1]["title_row_idx"], s[1]["header_row_idx"], s[1]["row_count"]) == \
        ("EXHIBIT 2: Costs", 5, 6, 2)
    assert s[1]["columns"] == ["item", "cost", "qty"]
    t = CV.load_section(raw, CV.csv_sections(raw), s[1]["file"], 1)
    assert t.columns == ["item", "cost", "qty"]
    assert [tuple(r) for r in t.collect()] == [("X", 10.0, 1.0), ("Y", 20.0, 2.0)]
    m = CV.looks_multi_table(raw).first()
    assert m["is_multi_table"] is True and m["section_markers"] == 1


def test_single_bom_messy(spark, tmp_path):
    raw = CV.read_csv_loose(spark, _write(tmp_path, "simple.csv", SIMPLE))
    s = CV.csv_sections(raw).first()
    assert (s["name"], s["header_row_idx"], s["row_count"]) == ("data", 0, 3)
    assert s["columns"] == ["product", "revenue", "units", "date"]
    raw = CV.read_csv_loose(spark, _write(tmp_path, "bom.csv", BOM))
    assert CV.csv_sections(raw).first()["columns"] == ["name", "value"]
    raw = CV.read_csv_loose(spark, _write(tmp_path, "messy.csv", MESSY))
    s = CV.csv_sections(raw).first()
    assert s["columns"] == ["product_name", "revenue", "notes"] and s["row_count"] == 2


def test_ragged_multiline_quotes_latin1(spark, tmp_path):
    text = ('TABLE 1: Sales\nProduct,Revenue,Notes\nA,100,"two\nlines"\nB,200\nC,300,"say ""hi"""\nTABLE 2: Costs\n'
            'Item,Cost,Qty\nX,10,1,extra\n')
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a b.csv").write_text(text, encoding="utf-8")
    (tmp_path / "in" / "old.csv").write_bytes("name,city\nx,Zürich\n".encode("latin-1"))
    raw = CV.read_csv_loose(spark, str(tmp_path / "in"))
    rows = {}
    for r in raw.orderBy("file", "row_ix").collect():
        rows.setdefault("old" if "old.csv" in r["file"] else "new", []).append([c for c in r["cells"] if c is not None])
    assert rows["new"] == [["TABLE 1: Sales"], ["Product", "Revenue", "Notes"], ["A", "100", "two\nlines"], ["B", "200"],
                           ["C", "300", 'say "hi"'], ["TABLE 2: Costs"], ["Item", "Cost", "Qty"], ["X", "10", "1", "extra"]]
    assert rows["old"] == [["name", "city"], ["x", "Zürich"]]
    s = CV.csv_sections(raw.where(F.col("file").contains("old.csv") == F.lit(False))).orderBy("index").collect()
    assert [(r["name"], r["row_count"]) for r in s] == [("TABLE 1: Sales", 3), ("TABLE 2: Costs", 1)]


def _plain(text):
    import csv
    import io
    rows = [r for r in csv.reader(io.StringIO(text)) if any(c != "" for c in r)]
    return [[c for c in r] for r in rows]


def test_many_splits_equal_one(spark, tmp_path):
    """Rows with line breaks, doubled and stray quotes and blank rows, cut into splits of a few bytes."""
    import random
    r = random.Random(7)
    cell = ["", "a", "b c", '"x, y"', '"say ""hi"""', '"two\nlines"', '"a\n\n""\n,b"', "12.5", 'in"side', "é"]
    for k in range(2):
        lines = [",".join(r.choice(cell) for _ in range(r.randint(1, 5))) for _ in range(400)]
        text = "head,of,the,file,x\n" + "\n".join(lines) + ("\n" if k else "")
        (tmp_path / f"f{k}.csv").write_text(text, encoding="utf-8")
        want = _plain(text)
        old = spark.conf.get("spark.sql.files.maxPartitionBytes")
        try:
            spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
            raw = CV.read_csv_loose(spark, str(tmp_path / f"f{k}.csv"))
            got = raw.orderBy("row_ix").collect()
            assert CV._lines(spark, str(tmp_path / f"f{k}.csv")).select("blk").distinct().count() > 3
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        assert [x.row_ix for x in got] == list(range(len(want)))
        assert [[c or "" for c in x.cells][:len(w)] for x, w in zip(got, want)] == want


def test_split_states():
    from xcheck.sources.csvio import ends_open
    assert not ends_open(b'a,"b",c', False) and ends_open(b'a,"b', False) and not ends_open(b'b",c', True)
    assert ends_open(b'b"",c', True) and ends_open(b'x","y', True) and not ends_open(b'5" pipe,3', False)
    assert not ends_open(b'""', False) and ends_open(b'"""', False) and not ends_open(b"", False) and ends_open(b"", True)
