"""Workbooks by the standard library: a Spark data source that reads sheets, and a bounded writer.

A workbook is one archive, so it is one input partition; big data should come as delimited files or Parquet.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prepweave.errors import PlanError
from prepweave.sources.grid import ROW
from prepweave.tables import written

#: The format's namespaces and limits.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"
SHEET_ROWS, SHEET_NAME = 1_048_576, 31
#: Numbers of built-in formats for dates and times.
BUILT_IN_TIMES = {*range(14, 23), *range(45, 48)}


@dataclass(frozen=True)
class Sheet:
    name: str
    state: str
    part: str


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheets_of(data: bytes) -> list[Sheet]:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            book = ET.fromstring(z.read("xl/workbook.xml"))
            links = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels")).iter(f"{PACKAGE}Relationship")}
    except (zipfile.BadZipFile, KeyError, ET.ParseError) as e:
        raise PlanError("SOURCE_CORRUPT", str(e)) from e
    out = []
    for s in book.iter(f"{MAIN}sheet"):
        target = links[s.get(f"{RELS}id")]
        out.append(Sheet(s.get("name"), s.get("state", "visible"), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    return out


def _times(code: str) -> bool:
    """Whether a number format shows dates or times: letters for them stand outside quotes, escapes and brackets."""
    return bool(re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\\.|_.|\[[^\]]*\]', "", code.lower()).replace("general", "")))


def _dated(z: zipfile.ZipFile) -> tuple[set[int], dt.datetime]:
    """The styles of cells that hold dates or times, and the day that they count from."""
    book = ET.fromstring(z.read("xl/workbook.xml"))
    options = book.find(f"{MAIN}workbookPr")
    later = options is not None and options.get("date1904") in ("1", "true")
    start = dt.datetime(1904, 1, 1) if later else dt.datetime(1899, 12, 30)
    if "xl/styles.xml" not in z.namelist():
        return set(), start
    styles = ET.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(f"{MAIN}numFmt")}
    formats = styles.find(f"{MAIN}cellXfs")
    ids = [int(x.get("numFmtId", 0)) for x in formats] if formats is not None else []
    return {i for i, n in enumerate(ids) if n in BUILT_IN_TIMES or _times(own.get(n, ""))}, start


def _moment(serial: float, start: dt.datetime) -> str:
    """A day with its time, or a time alone where the number counts no day."""
    at = start + dt.timedelta(milliseconds=round(serial * 86_400_000))
    return str(at.time() if 0 <= serial < 1 else at)


def rows_of(data: bytes, part: str) -> Iterator[tuple[int, list[str | None]]]:
    """The rows of a sheet, values only: (row number from 1, cells)."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            for _, item in ET.iterparse(z.open("xl/sharedStrings.xml")):
                if item.tag == f"{MAIN}si":
                    shared.append("".join(t.text or "" for t in item.iter(f"{MAIN}t")))
                    item.clear()
        dated, start = _dated(z)
        place = 0
        for _, row in ET.iterparse(z.open(part)):
            if row.tag != f"{MAIN}row":
                continue
            place = int(row.get("r", place + 1))
            cells: list[str | None] = []
            for c in row.iter(f"{MAIN}c"):
                at = _column(c.get("r")) if c.get("r") else len(cells)
                cells += [None] * (at + 1 - len(cells))
                kind, value = c.get("t"), c.find(f"{MAIN}v")
                if kind == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
                elif value is not None and value.text is not None:
                    text = value.text
                    if kind in (None, "n") and int(c.get("s", 0)) in dated:
                        cells[at] = _moment(float(text), start)
                        continue
                    cells[at] = shared[int(text)] if kind == "s" else ("true" if text == "1" else "false") if kind == "b" else re.sub(r"\.0$", "", text)
            yield place, cells
            row.clear()


def _content(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def list_sheets(spark: SparkSession, path: str) -> list[Sheet]:
    """The sheets of a workbook, which an executor opens: only their names reach the driver."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            for content in frame["content"]:
                try:
                    found = [(s.name, s.state, s.part, None) for s in sheets_of(content)]
                except PlanError as e:
                    found = [(None, None, None, e.detail)]
                yield pd.DataFrame(found, columns=["name", "state", "part", "fault"])

    rows = _content(spark, path).mapInPandas(run, "name string, state string, part string, fault string").collect()  # a row a sheet
    if not rows:
        raise PlanError("SOURCE_NOT_FOUND", path)
    if rows[0]["fault"] is not None:
        raise PlanError("SOURCE_CORRUPT", rows[0]["fault"])
    return [Sheet(r["name"], r["state"], r["part"]) for r in rows]


def read_sheet(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """The grid of one sheet, the first visible one if none is named. The workbook is read once, on an
    executor, and its rows are written."""
    found = list_sheets(spark, path)
    chosen = next((s for s in found if s.name == sheet), None) if sheet else next((s for s in found if s.state == "visible"), None)
    if chosen is None:
        raise PlanError("SHEET_NOT_FOUND", sheet or "")
    part = chosen.part

    def run(frames):
        import pandas as pd

        for frame in frames:
            for content in frame["content"]:
                held = []
                for row in rows_of(content, part):
                    held.append(row)
                    if len(held) == 10_000:
                        yield pd.DataFrame(held, columns=[ROW, "cells"])
                        held = []
                yield pd.DataFrame(held, columns=[ROW, "cells"])

    long = written(_content(spark, path).mapInPandas(run, f"{ROW} long, cells array<string>"), "sheet")
    width = long.agg(F.max(F.size("cells"))).first()[0] or 1
    return long.select(ROW, *[F.get("cells", F.lit(i)).alias(f"_c{i}") for i in range(width)])


def sheet_name(name: str, taken: set[str]) -> str:
    """At most 31 characters, none that a workbook forbids, different from those taken."""
    base = re.sub(r"[\[\]:*?/\\]", "_", name).strip("'") or "Sheet"
    out, n = base[:SHEET_NAME], 2
    while out.casefold() in taken:
        tail = f"_{n}"
        out, n = base[: SHEET_NAME - len(tail)] + tail, n + 1
    taken.add(out.casefold())
    return out


def _cell(ref: str, value, style: int) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)) and abs(value) < 1e15:
        return f'<c r="{ref}"><v>{value}</v></c>'
    text = str(value)
    if text[:1] in "=+-@" and text:
        text = "'" + text
    text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", text)
    return f'<c r="{ref}" t="inlineStr" s="{style}"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def _letters(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def write_workbook(tables: dict[str, DataFrame], path: str | io.BytesIO) -> dict[str, str]:
    """Bounded tables as sheets with a styled, frozen and filtered header; returns each table's sheet name.

    Rows stream through the driver; a table beyond a sheet's rows is an error. Text that could be a formula is guarded.
    """
    taken: set[str] = set()
    names = {k: sheet_name(k, taken) for k in tables}
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    main, rel = MAIN.strip("{}"), RELS.strip("{}")
    stamp = (1980, 1, 1, 0, 0, 0)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        put = lambda name, text: z.writestr(zipfile.ZipInfo(name, stamp), head + text)
        put("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(tables) + 1)) + "</Types>")
        put("_rels/.rels", f'<Relationships xmlns="{PACKAGE.strip("{}")}"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        put("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names.values(), 1)) + "</sheets></workbook>")
        put("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PACKAGE.strip("{}")}">' + "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(tables) + 1)) + f'<Relationship Id="rId{len(tables) + 1}" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
        put("xl/styles.xml", f'<styleSheet xmlns="{main}"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>')
        for i, (name, df) in enumerate(tables.items(), 1):
            columns = df.columns
            with z.open(zipfile.ZipInfo(f"xl/worksheets/sheet{i}.xml", stamp), "w", force_zip64=True) as out:
                write = lambda s: out.write(s.encode())  # noqa: E731, B023
                write(f'{head}<worksheet xmlns="{main}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews><sheetData><row r="1">' + "".join(_cell(f"{_letters(j)}1", c, 1) for j, c in enumerate(columns)) + "</row>")
                n = 1
                for n, row in enumerate(df.toLocalIterator(), 2):
                    if n > SHEET_ROWS:
                        raise PlanError("SHEET_TOO_LARGE", name)
                    write(f'<row r="{n}">' + "".join(_cell(f"{_letters(j)}{n}", v, 0) for j, v in enumerate(row)) + "</row>")
                write(f'</sheetData><autoFilter ref="A1:{_letters(max(0, len(columns) - 1))}{n}"/></worksheet>')
    return names


def signature(data: bytes) -> list[tuple]:
    """A workbook's structure, for comparisons: each sheet's name, state, rows and first row."""
    out = []
    for s in sheets_of(data):
        rows = list(rows_of(data, s.part))
        out.append((s.name, s.state, len(rows), tuple(rows[0][1]) if rows else ()))
    return out
