"""What a file is, by its first bytes and its name, and the reader that it takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .records import read_json_table, read_table
from .workbooks import read_workbooks

#: First bytes of kinds, in hex.
MAGIC = [("pdf", "^25504446"), ("png", "^89504E470D0A1A0A"), ("xls", "^D0CF11E0A1B11AE1"), ("xlsx", "^504B0304")]


def table_kind(content: Column, name: Column) -> Column:
    """xlsx, csv, json, or what is refused: xls, pdf, png, html, zip, empty. Bytes go before the name's suffix."""
    head = F.hex(F.substring(content, 1, 512))
    text = F.ltrim(F.lower(F.decode(F.substring(content, 1, 512), "ISO-8859-1")))
    out = F.when(F.length(content) == 0, "empty")
    for kind, magic in MAGIC:
        hit = head.rlike(magic)
        out = out.when(hit & F.lower(name).endswith(".xlsx"), "xlsx").when(hit, "zip") if kind == "xlsx" else out.when(hit, kind)
    return out.when(text.rlike("^(?:\u00ef\u00bb\u00bf)?<(?:!doctype html|html)"), "html").when(F.lower(name).endswith(".json") | text.rlike(r"^(?:\u00ef\u00bb\u00bf)?[\[{]"), "json").otherwise("csv")


def mail_kind(content: Column, name: Column) -> Column:
    """eml, mbox, ics, msg or unknown."""
    head = F.decode(F.substring(content, 1, 4096), "ISO-8859-1")
    header = r"(?im)^(?:from|to|date|subject|message-id|received|mime-version|return-path):"
    return (
        F.when(F.hex(F.substring(content, 1, 8)) == "D0CF11E0A1B11AE1", "msg").when(head.startswith("From "), "mbox").when(F.ltrim(head).startswith("BEGIN:VCALENDAR"), "ics")
        .when(head.rlike(header) | F.lower(name).endswith(".eml"), "eml").otherwise("unknown")
    )


def read_any_table(spark: SparkSession, path: str, plural: str | None = None, sheet: str | None = None) -> DataFrame:
    """A table file by what it is; kinds that are no table are refused."""
    kind = spark.read.format("binaryFile").load(path).select(table_kind(F.col("content"), F.col("path")).alias("k")).first().k
    if kind == "csv":
        return read_table(spark, path)
    if kind == "json":
        return read_json_table(spark, path, plural)
    if kind == "xlsx":
        rows = read_workbooks(spark, path)
        return rows if sheet is None else rows.where(F.col("sheet") == sheet)
    raise ValueError(f"{path} is {kind}, no table")
