import zipfile

import pytest

from prepweave.errors import PlanError
from prepweave.sources.catalog import FolderConfig, assert_unchanged, classify_batch, fingerprint, scan_folder
from prepweave.sources.discovery import Overrides, choose, classify, discover, flatten, header_candidates, memory_risk, profile, read_table, roles
from prepweave.sources.grid import read_grid, read_source, sniff
from prepweave.sources.xlsx import list_sheets, read_sheet, signature, write_workbook
from prepweave.streaming.incremental import ingest_new_files


def put(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_grid(spark, tmp_path):
    p = put(tmp_path / "a.csv", "﻿a;b\n1;\"x;y\"\n2\n3;q;r\n")
    d = sniff(spark, p)
    assert (d.delimiter, d.encoding, d.multi_line) == (";", "UTF-8", False)
    rows = [tuple(r) for r in read_grid(spark, p).orderBy("__rn").collect()]
    assert rows[0][:3] == (1, "a", "b") and rows[1][:3] == (2, "1", "x;y") and rows[2][:3] == (3, "2", None) and rows[3][:4] == (4, "3", "q", "r")
    p = put(tmp_path / "b.csv", "é€,1\nb,2\n", "cp1252")
    assert sniff(spark, p).encoding == "windows-1252" and read_grid(spark, p).first()["_c0"] == "é€"
    p = put(tmp_path / "late.csv", "a,1\n" * 500 + "é€,2\n", "cp1252")
    assert sniff(spark, p).encoding == "windows-1252" and read_grid(spark, p).filter("__rn = 501").first()["_c0"] == "é€"
    p = put(tmp_path / "c.csv", 'a,b\n"x\ny",2\n')
    assert read_grid(spark, p).count() == 2
    p = put(tmp_path / "d.csv", "")
    assert read_grid(spark, p).count() == 0
    with pytest.raises(PlanError, match="SOURCE_UNSUPPORTED_TYPE"):
        read_source(spark, "x.pdf")


def test_numbers_over_splits(spark, tmp_path):
    p = put(tmp_path / "big.csv", "".join(f"{i},v{i}\n" for i in range(20000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        g = read_grid(spark, p)
        assert g.filter("__rn <> cast(_c0 as long) + 1").count() == 0 and g.count() == 20000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


CSV = "Report,,,\n,,,\nCode,Name,Hours,\n007,ann,8,\nCode,Name,Hours,\n008,bob,9.5,\nGrand Total,,17.5,\nGenerated by x,,,\n,,,\n,,,\nItem,Quantity,,\nA,1,,\nB,2,,\n"


def test_discovery_of_many_regions(spark, tmp_path):
    grid = read_grid(spark, put(tmp_path / "many.csv", "".join(f"Code{i},Name{i}\n{i},ann\n,\n" for i in range(130))))
    tables = discover(grid)
    assert len(tables) == 130 and [t.header.labels for t in tables] == [(f"Code{i}", f"Name{i}") for i in range(130)]
    last = tables[-1].region
    given = discover(grid, Overrides(table_id=last.table_id, header_rows=(last.first_row,)))
    assert given[0].header.labels == ("Code129", "Name129")
    given = discover(grid, Overrides(header_rows=(last.first_row,)))
    assert given[-1].header.labels == ("Code129", "Name129") and given[-1].header.confidence == 1.0


def test_discovery(spark, tmp_path):
    grid = read_grid(spark, put(tmp_path / "t.csv", CSV))
    tables = discover(grid)
    assert [t.region.table_id for t in tables] == ["r1-1c1-1", "r3-8c1-3", "r11-13c1-2"]
    t = choose(tables, "largest")
    assert t.header.labels == ("Code", "Name", "Hours") and t.header.rows == (3,)
    data = read_table(grid, t)
    assert data.orderBy("__row_id").first()["Code"] == "007"
    kinds = [r["__row_class"] for r in classify(data, t.header.labels).orderBy("__row_id").collect()]
    assert kinds == ["data", "repeated_header", "data", "grand_total", "generated_footer"]
    facts = {r["column"]: r for r in profile(data.filter("__row_id in (1, 3)")).collect()}
    assert (facts["Code"]["data_type"], facts["Hours"]["data_type"], facts["Code"]["key_candidate"]) == ("text", "decimal", True)
    assert choose(tables, table_id="r11-13c1-2").header.labels == ("Item", "Quantity")
    with pytest.raises(PlanError, match="TABLE_NOT_FOUND"):
        discover(grid, Overrides(table_id="zz"))
    with pytest.raises(PlanError, match="HEADER_OVERRIDE_OUTSIDE_TABLE"):
        discover(grid, Overrides(table_id="r3-8c1-3", header_rows=(1,)))
    with pytest.raises(PlanError, match="HEADER_ROWS_INVALID"):
        Overrides(header_rows=(1, 3))


def test_header_levels(spark, tmp_path):
    grid = read_grid(spark, put(tmp_path / "h.csv", "Identity,,Performance,\nCode,Name,Target,Actual\n1,a,2,3\n2,b,3,4\n"))
    (t,) = discover(grid)
    assert t.header.labels == ("Identity.Code", "Identity.Name", "Performance.Target", "Performance.Actual")
    assert flatten([["A", "", "A"], ["x", "x", "A"]]) == ("A.x", "A.x_2", "A") and flatten([["", "b"]]) == ("unnamed_1", "b")


def test_types_and_roles(spark):
    df = spark.createDataFrame([("1", "2026-01-01", "yes", "1,000", "x", "01/02/2026"), ("2", "", "no", "2.5", "3", "a")], "i string, d string, b string, m string, t string, s string")
    got = {r["column"]: (r["data_type"], r["warnings"]) for r in profile(df).collect()}
    assert {k: v[0] for k, v in got.items()} == {"i": "integer", "d": "date", "b": "boolean", "m": "decimal", "t": "text", "s": "text"}
    assert got["t"][1] == ["MIXED_TYPES"] and got["s"][1] == ["AMBIGUOUS_DATES"]
    assert "identifier" in roles("Employee ID", "text") and "amount" in roles("Total Price", "decimal")
    assert [memory_risk(1, 1, 1, 1000), memory_risk(1000, 1, 1, 1000)] == ["low", "block"]


def test_workbooks(spark, tmp_path):
    p = str(tmp_path / "w.xlsx")
    names = write_workbook({"a/b": spark.createDataFrame([("=1+1", 2, None), ("<x>", 3, 1.5)], "t string, n int, d double"), "x" * 40: spark.range(2)}, p)
    assert list(names.values()) == ["a_b", "x" * 31]
    rows = [tuple(r) for r in read_sheet(spark, p, "a_b").orderBy("__rn").collect()]
    assert rows == [(1, "t", "n", "d"), (2, "'=1+1", "2", None), (3, "<x>", "3", "1.5")]
    assert [s.state for s in list_sheets(spark, p)] == ["visible", "visible"]
    assert [s[2] for s in signature(open(p, "rb").read())] == [3, 3]
    with pytest.raises(PlanError, match="SHEET_NOT_FOUND"):
        read_sheet(spark, p, "zz")
    with pytest.raises(PlanError, match="SOURCE_CORRUPT"):
        list_sheets(spark, put(tmp_path / "bad.xlsx", "no zip"))


def test_catalog(spark, tmp_path):
    for name, text in (("a.csv", "1"), ("B.csv", "1"), ("c.csv", "2"), ("d.csv", "3"), ("e.txt", "4")):
        put(tmp_path / name, text)
    (tmp_path / "sub").mkdir()
    put(tmp_path / "sub" / "f.csv", "5")
    found = scan_folder(spark, FolderConfig(str(tmp_path)))
    assert [r["relative_path"] for r in found.collect()] == ["a.csv", "B.csv", "c.csv", "d.csv"]
    assert scan_folder(spark, FolderConfig(str(tmp_path), recursive=True, exclude=["a*"])).count() == 4
    before = found.filter("relative_path = 'c.csv'").select("sha256")
    failed = spark.createDataFrame([("d.csv", "X")], "relative_path string, reason string")
    states = {r["relative_path"]: r["state"] for r in classify_batch(found, before, failed).collect()}
    assert states == {"a.csv": "eligible", "B.csv": "duplicate", "c.csv": "unchanged", "d.csv": "quarantined"}
    with pytest.raises(PlanError, match="FOLDER_TOO_MANY_FILES"):
        scan_folder(spark, FolderConfig(str(tmp_path), maximum_files=1))
    h = fingerprint(spark, str(tmp_path / "a.csv"))
    assert_unchanged(spark, str(tmp_path / "a.csv"), h)
    put(tmp_path / "a.csv", "changed")
    with pytest.raises(PlanError, match="SOURCE_CHANGED"):
        assert_unchanged(spark, str(tmp_path / "a.csv"), h)


def test_incremental(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    spark.range(3).write.parquet(str(src))
    args = (spark, str(src), "id long", str(tmp_path / "cp"), out)
    assert ingest_new_files(*args) == 3 and ingest_new_files(*args) == 0
    spark.range(2).write.mode("append").parquet(str(src))
    assert ingest_new_files(*args) == 2


def test_scan_folder_filters_before_its_limit(spark, tmp_path):
    for i in range(40):
        put(tmp_path / f"other{i}.csv", "x" * 500)
    for name in ("want1.csv", "want2.csv", "want[3.csv", "wanted.csv"):
        put(tmp_path / name, "a")
    names = lambda **k: [r["relative_path"] for r in scan_folder(spark, FolderConfig(str(tmp_path), maximum_files=2, **k)).collect()]
    assert names(include=["want[0-9].csv"]) == ["want1.csv", "want2.csv"]
    assert names(include=["want*"], exclude=["*[[]*", "want[!0-9]?.csv"]) == ["want1.csv", "want2.csv"]
    with pytest.raises(PlanError, match="FOLDER_TOO_MANY_FILES"):
        names(include=["want*"], exclude=["*[[]*"])


def test_header_levels_and_row_classes(spark):
    assert flatten([["Q1", "", "Q2", ""], ["a", "b", "", "d"]]) == ("Q1.a", "Q1.b", "Q2.b", "Q2.d")
    top = [(1, ["Q1", "", "Q2", ""]), (2, ["a", "b", "a", "b"]), (3, ["1", "2", "3", "4"])]
    best = header_candidates(top, Overrides(max_header_levels=2))[0]
    assert best.rows == (1, 2) and best.labels == ("Q1.a", "Q1.b", "Q2.a", "Q2.b")
    # one label alone does not group columns
    assert all(len(h.rows) == 1 for h in header_candidates([(1, ["Title", "", ""]), (2, ["a", "b", "c"]), (3, ["1", "2", "3"])], Overrides()))
    rows = [("Q1.a", "Q1.b"), ("a", "b"), ("the grand  total", "7"), ("Sub total", "1"), ("report prepared by", "me"), ("x", "approved by me"), ("Note: x", ""), ("note", ""), ("total", "9"), ("", "")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "__row_id long, x string, y string")
    kinds = [r["__row_class"] for r in classify(df, ("Q1.a", "Q1.b"), ("a", "b")).orderBy("__row_id").collect()]
    assert kinds == ["repeated_header", "repeated_header", "grand_total", "subtotal", "generated_footer", "signature", "note", "data", "data", "data"]


def test_types_and_roles_of_columns(spark):
    rows = [("007", "2026-7-1", "5%", "007", "1/2/26", "x"), ("8", "2026-10-31", "7.5%", "1.5", "b", "3")]
    facts = {r["column"]: r for r in profile(spark.createDataFrame(rows, "zeros string, day string, share string, mixed string, odd string, both string")).collect()}
    assert {c: r["data_type"] for c, r in facts.items()} == {"zeros": "text", "day": "date", "share": "text", "mixed": "decimal", "odd": "text", "both": "text"}
    assert {c: r["warnings"] for c, r in facts.items() if r["warnings"]} == {"zeros": ["LEADING_ZEROS"], "odd": ["AMBIGUOUS_DATES"], "both": ["MIXED_TYPES"]}
    assert facts["share"]["percentages"] and roles("Share", "text", True) == ["percentage"]
    assert roles("Ref Note", "text") == ["identifier"] and roles("paid", "decimal") == ["identifier", "amount"] and roles("Order type", "date") == ["date", "category"]


def test_workbook_dates(spark, tmp_path):
    head = '<?xml version="1.0"?>'
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    parts = {
        "xl/workbook.xml": f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="s" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet {main}><numFmts count="2"><numFmt numFmtId="164" formatCode="[Red]yyyy\\-mm\\-dd"/><numFmt numFmtId="165" formatCode="0.00&quot;days&quot;"/></numFmts><cellXfs count="4"><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet {main}><sheetData><row r="1"><c r="A1" s="1"><v>46220</v></c><c r="B1" s="2"><v>46220.75</v></c><c r="C1" s="3"><v>46220.5</v></c><c r="D1" s="1"><v>0.25</v></c><c r="E1"><v>7</v></c></row></sheetData></worksheet>',
    }
    with zipfile.ZipFile(tmp_path / "d.xlsx", "w") as z:
        for name, text in parts.items():
            z.writestr(name, head + text)
    row = read_source(spark, str(tmp_path / "d.xlsx")).first()
    assert row[1:] == ("2026-07-17 00:00:00", "2026-07-17 18:00:00", "46220.5", "06:00:00", "7")
