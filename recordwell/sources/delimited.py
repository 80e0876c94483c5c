"""Delimited text tables, split among tasks although quoted cells may hold line breaks.

A task that starts in the middle of a file can't know whether it starts within quotes. So each split is read for both cases first: a line,
as an automaton over the quotes of its cells, leads from either state to one of the two, and a split is the composition of its
lines. A scan over the splits, a row each, then says where every split starts: its state, its first line's number, and
where the record began that is open there. With that the splits are read again, each for its one case, and records that cross
their bounds, which are pieces then, are put together by the line where they began.

Cells are cut by expressions. Quotes count at the start of a cell only, `""` within quotes is a quote, and what follows a closing
quote belongs to the cell.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..deploy import ship

#: What the older Windows encoding has where ISO 8859-1 has control characters.
WINDOWS = "".join(bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
LATIN_1 = "".join(chr(b) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
#: Lines of a file that tell its delimiter, and that its header must stand in.
HEAD = 200


class TableError(ValueError):
    """A file can't be read as a table."""


def sniff_table(head: str) -> dict[str, str]:
    """Delimiter and header of a text table by its first lines: sep= lines count, else the delimiter whose columns are steadiest."""
    lines = head.splitlines()
    if lines and (m := re.fullmatch(r"sep=(.)", lines[0].strip(), re.I)):
        return {"sep": m[1], "skip": "1"}

    def steadiness(sep: str) -> tuple[float, int]:
        widths = [len(r) for r in csv.reader(io.StringIO(head, newline=""), delimiter=sep) if r]
        common = max(set(widths), key=widths.count) if widths else 1
        return (widths.count(common) / len(widths) if widths and common > 1 else 0.0, common)

    return {"sep": max(";,\t|", key=steadiness), "skip": "0"}


def unique_headers(names: list[str]) -> list[str]:
    """Empty headers get a number, repeated ones a count."""
    out: list[str] = []
    for k, name in enumerate((n.strip() for n in names), 1):
        name = name or f"(column {k})"
        n, one = 2, name
        while one in out:
            one, n = f"{name} ({n})", n + 1
        out.append(one)
    return out


def _lines(spark: SparkSession, path: str, encoding: str | None) -> DataFrame:
    """(path, start, line) in file order within each split; start: where in its file the split begins.

    UTF-16 by its mark (such a file is one split); else UTF-8 if all bytes are; else the older Windows encoding.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))
    first = raw.where("start = 0").select(F.substring(F.col("line").cast("binary"), 1, 2).alias("b")).limit(1).first()
    if encoding is None and first and bytes(first.b) in (b"\xff\xfe", b"\xfe\xff"):
        whole = spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-16").alias("text"))
        whole = whole.where(F.length("text") > 0).withColumn("text", F.regexp_replace("text", r"\n\z", ""))
        return whole.select("path", F.lit(0).cast("long").alias("start"), F.explode(F.split("text", "\n")).alias("line"))
    if encoding is None and not raw.where(~F.is_valid_utf8("line")).isEmpty():
        return raw.withColumn("line", F.translate(F.decode(F.col("line").cast("binary"), "ISO-8859-1"), LATIN_1, WINDOWS))
    return raw if encoding is None or encoding.upper().replace("_", "-") == "UTF-8" else raw.withColumn("line", F.decode(F.col("line").cast("binary"), encoding))


def _automaton(lines: DataFrame, sep: str) -> DataFrame:
    """The lines with `from_out` and `from_in`: whether quotes are open behind the line if they weren't, or were, before it; `said`: whether it has text."""
    s = re.escape(sep)
    opens = rf'(?s)^(?:(?:"[^"]*+(?:""[^"]*+)*+"[^{s}]*+|[^"{s}][^{s}]*+|){s})*+"[^"]*+(?:""[^"]*+)*+$'
    return lines.select("path", "start", "line", F.col("line").rlike(opens).alias("from_out"), F.concat(F.lit('"'), "line").rlike(opens).alias("from_in"), F.col("line").rlike(rf'[^\s"{s}﻿]').alias("said"))


def _splits(lines: DataFrame) -> DataFrame:
    """A row a split and case `given` (0: it starts outside quotes): its lines, the state behind it, the place of the line where its
    last, open record begins (-1: before the split), and that of its first record with text (-1: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, cases = None, 0, []

        def rows() -> pa.RecordBatch:
            columns = zip(*((*key, given, n, *case) for given, case in enumerate(cases)), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 0 else pa.int64()) for k, c in enumerate(columns)], ["path", "start", "given", "n", "state", "begun", "first"])

        for batch in batches:
            for path, start, out, inside, said in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5)), strict=True):
                if key != (path, start):
                    if key:
                        yield rows()
                    key, n, cases = (path, start), 0, [[0, -1, -1], [1, -1, -1]]
                for case in cases:
                    if not case[0]:
                        case[1] = n
                        if said and case[2] < 0:
                            case[2] = n
                    case[0] = int(inside if case[0] else out)
                n += 1
        if key:
            yield rows()

    return lines.mapInArrow(run, "path string, start long, given long, n long, state long, begun long, first long")


def _plan(found: list) -> list[tuple]:
    """(path, start, state, first line's number, line of the record that is open there, the header's line, whether records cross its bounds)."""
    files: dict[str, dict[int, dict[int, object]]] = {}
    for r in found:
        files.setdefault(r.path, {}).setdefault(r.start, {})[r.given] = r
    out = []
    for path, splits in files.items():
        state, number, begun, header, mine = 0, 1, 0, None, []
        for start in sorted(splits):
            r = splits[start][state]
            if header is None and r.first >= 0:
                header = number + r.first
            mine.append([path, start, state, number, begun, bool(state or r.state)])
            if r.begun >= 0:
                begun = number + r.begun
            state, number = r.state, number + r.n
        if state:
            raise TableError(f"{path}: a quote that opens in the record at line {begun} is never closed")
        if header is None:
            raise TableError(f"{path} has no header")
        out += [(*m[:5], header, m[5]) for m in mine]
    return out


def _pieces(lines: DataFrame) -> DataFrame:
    """(path, line, at, text, whole): a record by the number of the line where it begins, or a piece of it, which begins at line `at`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, number, begun, at, held = None, 0, 0, 0, 0, []
        out: list[tuple] = []
        size = 0

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "line", "at", "text", "whole"])

        for batch in batches:
            for path, start, line, opened, inside, given, first, carried in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
                if key != (path, start):
                    if held:
                        out.append((key[0], begun, at, "\n".join(held), False))
                    key, state, number, held = (path, start), given, first, []
                    begun, at = (carried, first) if given else (first, first)
                if not held:
                    at = number
                    begun = begun if state else number
                held.append(line)
                size += len(line)
                state = int(inside if state else opened)
                number += 1
                if not state:
                    out.append((path, begun, at, "\n".join(held), begun == at))
                    held = []
                if len(out) >= 4096 or size > 4 << 20 and out:
                    yield batch_of(out)
                    out, size = [], 0
        if held:
            out.append((key[0], begun, at, "\n".join(held), False))
        if out:
            yield batch_of(out)

    return lines.mapInArrow(run, "path string, line long, at long, text string, whole boolean")


def _cells(record: Column, sep: str) -> Column:
    """A record's cells: each is behind a delimiter, one of which is put before the first."""
    s = re.escape(sep)
    cells = F.regexp_extract_all(F.concat(F.lit(sep), F.regexp_replace(record, r"\r\z", "")), F.lit(rf'(?s){s}("[^"]*+(?:""[^"]*+)*+(?:"[^{s}]*+)?|[^{s}]*+)'), F.lit(1))
    quoted = r'(?s)^"([^"]*+(?:""[^"]*+)*+)"?(.*+)$'
    bare = lambda c: F.concat(F.replace(F.regexp_extract(c, quoted, 1), F.lit('""'), F.lit('"')), F.regexp_extract(c, quoted, 2))
    return F.transform(cells, lambda c: F.when(c.startswith('"'), bare(c)).otherwise(c))


def read_table(spark: SparkSession, path: str, encoding: str | None = None, delimiter: str | None = None) -> DataFrame:
    """A delimited text table, a file or a folder of files with one header, all columns text.

    row_no is the number of the line where a row begins, in its file. `broken` and `problem` (extra-cells) mark rows with more than the header's cells, whose
    further values aren't read; cells that a row lacks are empty; empty rows are left out. Files without a header, with a quote that
    is never closed, or with another header than the first one's are refused with a TableError.
    """
    ship(spark)
    lines = _lines(spark, path, encoding)
    top = lines.where("start = 0").limit(HEAD).collect()
    if not top:
        raise TableError(f"{path} has no header")
    head = "\n".join(r.line for r in top if r.path == top[0].path).removeprefix("﻿")
    how = sniff_table(head)
    sep = delimiter or how["sep"]
    if len(sep) != 1:
        raise TableError("a delimiter is one character")
    skip = int(how["skip"])
    marked = _automaton(lines, sep)
    if skip:  # the line sep= of each file is no record, though it counts as a line
        marked = marked.withColumn("said", F.col("said") & ~F.lower("line").rlike(r"^﻿?sep=.\s*$"))
    plan = _plan(_splits(marked).collect())  # two rows a split
    records = csv.reader(io.StringIO("\n".join(head.split("\n")[skip:]) + "\n", newline=""), delimiter=sep)
    raw = next((r for r in records if any(c.strip() for c in r)), None)
    if raw is None:
        raise TableError(f"the header of {path} isn't within its first {HEAD} lines")
    places = spark.createDataFrame(plan, "path string, start long, given long, number long, carried long, header long, crossed boolean")

    def read(where: str) -> DataFrame:
        joined = marked.join(F.broadcast(places.where(where)), ["path", "start"])
        return _pieces(joined.select("path", "start", "line", "from_out", "from_in", "given", "number", "carried"))

    found = read("true").where("whole").select("path", "line", "text")
    if any(p[6] for p in plan):
        parts = read("crossed").where("not whole").groupBy("path", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x.text), "\n").alias("text"))
        found = found.unionByName(parts)
    headers = F.broadcast(places.groupBy("path").agg(F.first("header").alias("header")))
    cut = found.join(headers, "path").where("line >= header").withColumn("cells", _cells(F.when(F.col("line") == F.col("header"), F.regexp_replace("text", "^﻿", "")).otherwise(F.col("text")), sep))
    other = (F.col("line") == F.col("header")) & (F.transform("cells", lambda c: F.trim(c)) != F.array(*(F.lit(c.strip(" ")) for c in raw)))
    rows = cut.where(other | (F.col("line") > F.col("header"))).where(F.exists("cells", lambda c: c.rlike(r"\S")))
    checked = F.when(other, F.raise_error(F.concat(F.col("path"), F.lit(" has another header"))).cast("string")).otherwise("")
    extra = F.exists(F.slice("cells", len(raw) + 1, 1 << 30), lambda c: c.rlike(r"\S"))
    names = unique_headers(raw)
    return rows.select(*(F.concat(F.coalesce(F.get("cells", F.lit(k)), F.lit("")), checked if k == 0 else F.lit("")).alias(n) for k, n in enumerate(names)), F.col("line").alias("row_no"), extra.alias("broken"), F.when(extra, "extra-cells").alias("problem"))
