"""Sinks: record and change files, CSV in two forms, JSON, junction tables, graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..context import Context
from ..functions.text import guarded
from ..functions.values import DATE_STYLES, display, number_text, value
from ..schema import COMPOSITES, Model, ObjectType
from ..operators.relations import links_of


def standard_columns(of: ObjectType) -> list[Column]:
    """One text column a scalar or part, under headers that an import maps back: `amount.amountMicros`, `company Id`."""
    out = [F.col("crm_id").alias("id")]
    for f in of.fields.values():
        if f.inverse or not f.active:
            continue
        c = F.col(f.name)
        if f.type in COMPOSITES:
            for part in COMPOSITES[f.type]:
                x = c.getField(part.name)
                out.append(guarded(F.to_json(x) if part.dataType.typeName() == "array" else x.cast("string")).alias(f"{f.name}.{part.name}"))
        elif f.type == "RELATION":
            out.append(c.id.alias(f"{f.name} Id"))
        elif f.type == "MORPH_RELATION":
            out.append(F.array_join(F.transform(c, lambda x: F.concat_ws(":", x.object, x.id)), ",").alias(f.name))
        elif f.type in ("MULTI_SELECT", "ARRAY"):
            out.append(F.to_json(c).alias(f.name))
        elif f.type == "DATE_TIME":
            out.append(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(f.name))
        else:
            out.append(guarded(c.cast("string")).alias(f.name))
    return out


def plain_columns(of: ObjectType, context: Context, style: str = "COMMAS_AND_DOT", date_style: str = "DAY_FIRST") -> list[Column]:
    """One column a field as people read it, numbers and dates in their style."""
    out = []
    for f in of.fields.values():
        if f.inverse or not f.active:
            continue
        if f.type == "DATE":
            c = F.date_format(F.col(f.name), DATE_STYLES[date_style])
        elif f.type == "DATE_TIME":
            c = F.date_format(context.local(F.col(f.name)), f"{DATE_STYLES[date_style]} HH:mm")
        elif f.type in ("NUMBER", "NUMERIC"):
            c = number_text(value(of, f.name).number, style)
        else:
            c = display(of, f.name, style)
        out.append(guarded(F.coalesce(c, F.lit(""))).alias(f.label or f.name))
    return out


def write_csv(df: DataFrame, path: str, columns: list[Column], most_rows: int = 20_000, sep: str = ",") -> None:
    """Files of at most `most_rows` rows each, written in parallel."""
    df.select(*columns).write.option("header", True).option("sep", sep).option("lineSep", "\r\n").option("maxRecordsPerFile", most_rows).option("emptyValue", "").csv(path)


def api_object(of: ObjectType) -> Column:
    """A record as one nested object; links as `<field>Id`, empty fields left out when written."""
    parts = [F.col("crm_id").alias("id"), F.col("crm_created_at").alias("createdAt"), F.col("crm_deleted_at").alias("deletedAt")]
    for f in of.fields.values():
        if not f.inverse:
            parts.append(F.col(f"{f.name}.id").alias(f"{f.name}Id") if f.type == "RELATION" else F.col(f.name))
    return F.struct(*parts)


def write_json(df: DataFrame, path: str, of: ObjectType) -> None:
    df.select(api_object(of).alias("r")).select("r.*").write.option("ignoreNullFields", True).json(path)


def record_text(of: ObjectType, extra: str = "extra", body: str = "body") -> Column:
    """A record as the text of its file: properties in the schema's order, parts by name, unknown ones (a map column) by name behind
    them, empty ones left out, then the body. Equal content gives equal bytes."""

    def scalar(key: str, c: Column, kind: str) -> Column:
        text = F.to_json(c) if kind.startswith(("array", "struct", "map")) else c.cast("string")
        plain = text.rlike(r"^[\p{L}\p{N}][\p{L}\p{N} ._/@+-]*$") & ~text.rlike(r"^\s|\s$")
        shown = F.when(plain | F.lit(kind.startswith(("array", "struct", "map"))), text).otherwise(F.regexp_replace(F.to_json(F.struct(text.alias("v"))), r'^\{"v":(.*)\}$', "$1"))
        return F.when(c.isNotNull() & (text != ""), F.concat(F.lit(f"{key}: "), shown))

    lines = []
    for f in of.schema.fields:
        if f.dataType.typeName() == "struct":
            lines += [scalar(f"{f.name}.{p.name}", F.col(f"{f.name}.{p.name}"), p.dataType.simpleString()) for p in f.dataType.fields]
        else:
            lines.append(scalar(f.name, F.col(f.name), f.dataType.simpleString()))
    more = F.transform(F.array_sort(F.map_entries(extra)), lambda e: F.concat(e.key, F.lit(": "), e.value))
    head = F.array_join(F.concat(F.filter(F.array(*lines), lambda x: x.isNotNull()), F.coalesce(more, F.array().cast("array<string>"))), "\n")
    return F.concat(F.lit("---\n"), head, F.lit("\n---\n"), F.coalesce(F.col(body), F.lit("")))


def write_records(df: DataFrame, path: str, of: ObjectType) -> None:
    """The record files as rows (path, text) of Parquet: one large file a task, where a file a record would drown any file system."""
    df.select(F.concat(F.lit(f"records/{of.name}/"), "crm_id", F.lit(".md")).alias("path"), record_text(of).alias("text")).write.parquet(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A knowledge graph as JSON lines below `path`: nodes/, links/ (both ends found) and unresolved/ (targets that don't exist)."""
    nodes.write.json(f"{path}/nodes")
    edges.where("resolved is not null").select("source", F.col("resolved").alias("target")).write.json(f"{path}/links")
    edges.where("resolved is null").select("source", "target").write.json(f"{path}/unresolved")


def junction_rows(df: DataFrame, of: ObjectType, field: str, owner: str, model: Model) -> DataFrame:
    """A row for each (owner, target) with a stable id: one target column is set, the others empty."""
    each = df.select(F.col("crm_id").alias("o"), F.explode(links_of(of, field)).alias("l"))
    digest = F.md5(F.concat_ws("|", F.lit(field), "o", "l.object", "l.id"))
    uid = F.regexp_replace(digest, r"^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", "$1-$2-5$3-a$4-$5")
    targets = [F.when(F.col("l.object") == t, F.col("l.id")).alias(f"target{t[0].upper()}{t[1:]}Id") for t in of.fields[field].targets or model.objects]
    return each.select(uid.alias("id"), F.col("o").alias(f"{owner}Id"), *targets)


def append_events(events: DataFrame, path: str) -> None:
    """Change rows into monthly shards."""
    events.withColumn("month", F.date_format("at", "yyyy-MM")).write.mode("append").partitionBy("month").json(path)


def sample_row(df_of: ObjectType) -> list[str]:
    """The headers of an import template."""
    return ["id", *(f"{f.name}.{p.name}" if f.type in COMPOSITES else f.name for f in df_of.fields.values() if not f.inverse for p in (COMPOSITES[f.type] if f.type in COMPOSITES else [None]))]
