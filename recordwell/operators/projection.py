"""Which fields are shown, and rows shaped for readers: each value as it is shown and as it is stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import display, title, value
from ..schema import ObjectType


def default_fields(of: ObjectType) -> list[str]:
    """The label field, then all active ones that store something, but long formatted texts."""
    rest = [f.name for f in of.fields.values() if f.name != of.label_field and f.active and f.type != "RICH_TEXT" and not f.inverse]
    return [*([of.label_field] if of.label_field in of.fields else []), *rest]


#: How many fields a view of a kind shows if it names none; None: all default ones.
VIEW_FIELDS = {"TABLE": None, "KANBAN": 4, "CALENDAR": 1}


def view_fields(of: ObjectType, kind: str, named: list[str] | None = None, shown_elsewhere: tuple[str, ...] = ()) -> list[str]:
    """A view's fields: those that it names, else the first default ones of its kind that don't already stand as column or day."""
    if named:
        return wanted_fields(of, ",".join(named))
    fields = [f for f in default_fields(of) if f not in shown_elsewhere]
    return fields[: VIEW_FIELDS[kind.upper()]]


def wanted_fields(of: ObjectType, text: str | None) -> list[str]:
    """Fields listed with commas, each once, each known; the default ones for nothing."""
    if not text or not text.strip():
        return default_fields(of)
    keys = list(dict.fromkeys(k.strip() for k in text.split(",") if k.strip()))
    for key in keys:
        of.resolve(key)
    return keys


def stored(of: ObjectType, key: str) -> Column:
    """A field's raw value as JSON text: numbers as numbers, lists as lists, parts by name; null for none."""
    m = of.resolve(key)
    c = F.col(m.base) if not m.sub else value(of, key).column
    return F.regexp_replace(F.to_json(F.struct(c.alias("v"))), r'^\{"v":(.*)\}$|^\{\}$', "$1")


def shaped(df: DataFrame, of: ObjectType, fields: list[str] | None = None) -> DataFrame:
    """(id, object, title, path, deleted, values): values maps a field to what is shown and what is stored."""
    keys = fields or default_fields(of)
    values = F.map_from_entries(F.array(*(F.struct(F.lit(k), F.struct(display(of, k).alias("display"), F.nullif(stored(of, k), F.lit("")).alias("raw"))) for k in keys)))
    path = F.concat(F.lit(f"records/{of.name}/"), F.col("crm_id"), F.lit(".md"))
    return df.select(F.col("crm_id").alias("id"), F.lit(of.name).alias("object"), title(of).alias("title"), path.alias("path"), F.col("crm_deleted_at").isNotNull().alias("deleted"), values.alias("values"))
