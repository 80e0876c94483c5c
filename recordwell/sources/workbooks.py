"""Workbooks (.xlsx) as rows of texts: files are dealt by Spark, a task reads one after the other."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from decimal import Decimal
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..deploy import ship

ROWS = "path string, sheet string, row_no int, cells array<string>, error string"
MOST_BYTES = 200_000_000
#: Built-in number formats that show dates.
DATE_FORMATS = {*range(14, 23), 45, 46, 47}


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """The first visible sheet of each workbook; a file that can't be read has one row with an error."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInPandas(_sheets, ROWS)


def _sheets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch.path, batch.content, strict=True):
            try:
                rows = [(path, *r, None) for r in _rows(content)]
            except (zipfile.BadZipFile, KeyError, ValueError, ElementTree.ParseError) as e:
                rows = [(path, None, None, None, str(e) or "not a workbook")]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in ROWS.split(", ")])


def _rows(content: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    book = zipfile.ZipFile(io.BytesIO(content))
    if sum(i.file_size for i in book.infolist()) > MOST_BYTES:
        raise ValueError("the workbook is too large")

    def xml(name: str) -> ElementTree.Element:
        data = book.read(name)
        if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
            raise ValueError("a workbook with entities isn't read")
        return ElementTree.fromstring(data)

    tag = lambda e: e.tag.rpartition("}")[2]
    under = lambda e, name: [x for x in e.iter() if tag(x) == name]
    main = xml("xl/workbook.xml")
    epoch = datetime(1904, 1, 1) if any(p.get("date1904") in ("1", "true") for p in under(main, "workbookPr")) else datetime(1899, 12, 30)
    sheet = next(s for s in under(main, "sheet") if s.get("state", "visible") == "visible")
    target = {r.get("Id"): r.get("Target") for r in xml("xl/_rels/workbook.xml.rels")}[next(v for k, v in sheet.items() if k.endswith("}id"))]
    names = book.namelist()
    shared = ["".join(t.text or "" for t in under(s, "t")) for s in under(xml("xl/sharedStrings.xml"), "si")] if "xl/sharedStrings.xml" in names else []
    dates: set[int] = set()
    if "xl/styles.xml" in names:
        styles = xml("xl/styles.xml")
        custom = {int(f.get("numFmtId")) for f in under(styles, "numFmt") if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")), re.I)}
        formats = next((x for x in styles if tag(x) == "cellXfs"), [])
        dates = {k for k, x in enumerate(formats) if int(x.get("numFmtId", 0)) in DATE_FORMATS | custom}
    for n, row in enumerate(under(xml(f"xl/{target.removeprefix('/xl/')}"), "row"), 1):
        cells: dict[int, str | None] = {}
        for c in (x for x in row if tag(x) == "c"):
            letters = re.match(r"[A-Z]+", c.get("r", "")) or None
            at = sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(letters[0]))) - 1 if letters else len(cells)
            cells[at] = _cell(c.get("t", "n"), next((v.text for v in under(c, "v")), None), "".join(t.text or "" for t in under(c, "t")), shared, int(c.get("s", 0)) in dates, epoch)
        yield sheet.get("name"), int(row.get("r", n)), [cells.get(k) for k in range(max(cells, default=-1) + 1)]


def _cell(kind: str, raw: str | None, inline: str, shared: list[str], is_date: bool, epoch: datetime) -> str | None:
    if kind == "s":
        return shared[int(raw)]
    if kind == "inlineStr":
        return inline
    if raw is None:
        return None
    if kind == "b":
        return "true" if raw == "1" else "false"
    if kind in ("str", "e", "d"):
        return raw
    if is_date:
        moment = epoch + timedelta(seconds=round(float(raw) * 86400))
        return moment.date().isoformat() if float(raw) == int(float(raw)) else moment.isoformat(sep=" ")
    number = Decimal(f"{Decimal(raw):.15g}")  # fifteen digits, as the program shows
    return format(number.normalize(), "f")
