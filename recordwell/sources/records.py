"""Sources: record and page files, change log shards, tables of text, mail and calendar files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.pages import parsed
from ..schema import ObjectType
from .change_log import EVENT, read_events  # noqa: F401
from .delimited import read_table, sniff_table  # noqa: F401


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, data, is_list, body, bad_lines) of Markdown files below a folder."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(path, wholetext=True)
    relative = F.regexp_replace(F.col("_metadata.file_path"), "^.*?" + re.escape(path.rstrip("/").rsplit("/", 1)[-1]) + "/", "")
    return parsed(files.select(relative.alias("path"), F.col("value").alias("text")))


def read_records(spark: SparkSession, path: str, of: ObjectType) -> DataFrame:
    """One row a record file, its flat properties cast to the object's scalar types; what can't be read stands in `unread`."""
    rows = read_pages(spark, path)
    first = lambda n: F.get(F.try_element_at("data", F.lit(n)), F.lit(0))
    columns: list[Column] = [F.coalesce(first("crm_id"), F.regexp_extract("path", r"([^/]+)\.md$", 1)).alias("crm_id")]
    unread: list[Column] = []
    for f in of.schema.fields:
        if f.name == "crm_id":
            continue
        if isinstance(f.dataType, T.StructType):
            part = F.struct(*(first(f"{f.name}.{s.name}").try_cast(s.dataType).alias(s.name) for s in f.dataType if not isinstance(s.dataType, T.ArrayType)))
            columns.append(part.alias(f.name))
        elif isinstance(f.dataType, T.ArrayType):
            columns.append((F.try_element_at("data", F.lit(f.name)) if isinstance(f.dataType.elementType, T.StringType) else F.lit(None).cast(f.dataType)).alias(f.name))
        else:
            value = first(f.name)
            columns.append(value.try_cast(f.dataType).alias(f.name))
            unread.append(F.when(value.isNotNull() & value.try_cast(f.dataType).isNull(), F.lit(f.name)))
    return rows.select("path", *columns, F.filter(F.array(*unread), lambda x: x.isNotNull()).alias("unread"))


def read_json_table(spark: SparkSession, path: str, plural: str | None = None) -> DataFrame:
    """Rows of a JSON file: an array, {data: {plural: [...]}}, {data: {plural: {edges: [{node}]}}} or {plural: [...]}."""
    df = spark.read.option("multiLine", True).json(path)
    if plural is None:
        return df
    at = f"data.{plural}" if "data" in df.columns else plural
    kind = df.select(F.col(at).alias("x")).schema["x"].dataType
    if isinstance(kind, T.StructType) and "edges" in kind.fieldNames():
        return df.select(F.explode(f"{at}.edges.node").alias("r")).select("r.*")
    return df.select(F.explode(at).alias("r")).select("r.*")
