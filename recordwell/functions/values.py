"""The comparable value of a field, its text blob, and its display, as columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..context import Context
from ..schema import COMPOSITES, PRIMARY, RATINGS, ObjectType, Resolved
from .text import casefold

MONEY = "decimal(38,6)"


@dataclass(frozen=True)
class Value:
    """column, and its kind: text, number, numeric (a number kept as text), rating, bool, date, instant, list."""

    column: Column
    kind: str
    meaning: Resolved

    @property
    def empty(self) -> Column:
        if self.kind == "list":
            return self.column.isNull() | (F.size(self.column) == 0)
        if self.kind in ("text", "numeric", "rating"):
            return self.column.isNull() | (self.column == "")
        return self.column.isNull()

    @property
    def number(self) -> Column | None:
        """As a decimal; null where it is no number."""
        if self.kind in ("number", "numeric"):
            return self.column.try_cast("decimal(38,10)")
        if self.kind == "rating":
            return F.nullif(F.array_position(F.array(*map(F.lit, RATINGS)), F.coalesce(self.column, F.lit(""))), F.lit(0)).cast("decimal(38,10)")
        if self.kind == "text":
            return self.column.try_cast("decimal(38,10)")
        return None


def currency_amount(money: Column) -> Column:
    return (money.getField("amountMicros").cast("decimal(32,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast(MONEY)


def value(of: ObjectType, key: str) -> Value:
    m = of.resolve(key)
    c = F.col(m.base)
    if m.type in COMPOSITES:
        if m.type == "CURRENCY" and m.sub in ("", "amount"):
            return Value(currency_amount(c), "number", m)
        if m.type == "FULL_NAME" and not m.sub:
            name = F.trim(F.concat_ws(" ", F.nullif(F.trim(c.firstName), F.lit("")), F.nullif(F.trim(c.lastName), F.lit(""))))
            return Value(F.nullif(name, F.lit("")), "text", m)
        part = m.sub or PRIMARY[m.type]
        kind = {"array": "list", "bigint": "number", "double": "number"}.get(COMPOSITES[m.type][part].dataType.simpleString().split("<")[0], "text")
        return Value(c.getField(part), kind, m)
    kind = {
        "NUMBER": "number", "NUMERIC": "numeric", "RATING": "rating", "BOOLEAN": "bool", "DATE": "date", "DATE_TIME": "instant", "MULTI_SELECT": "list", "ARRAY": "list",
    }.get(m.type, "text")
    if m.type == "RELATION":
        return Value(F.when(c.id.isNotNull(), F.array(c.id)).otherwise(F.array().cast("array<string>")), "list", m)
    if m.type == "MORPH_RELATION":
        return Value(F.transform(c, lambda x: x.id), "list", m)
    return Value(c, kind, m)


def blob(of: ObjectType, key: str) -> Column:
    """All text that a field holds; null parts leave no trace."""
    m = of.resolve(key)
    c = F.col(m.base)
    if m.type in COMPOSITES and not m.sub:
        parts = [F.array_join(F.col(f"{m.base}.{f.name}").cast("array<string>"), " ") if f.dataType.typeName() == "array" and m.type != "LINKS" else (F.to_json(c.getField(f.name)) if f.dataType.typeName() == "array" else c.getField(f.name).cast("string")) for f in COMPOSITES[m.type]]
        return F.concat_ws(" ", *parts)
    v = value(of, key)
    if m.type == "RELATION":
        return F.concat_ws(" ", c.object, c.id, c.title)
    if m.type == "MORPH_RELATION":
        return F.array_join(F.transform(c, lambda x: F.concat_ws(" ", x.object, x.id, x.title)), " ")
    return F.coalesce(F.array_join(v.column, " ") if v.kind == "list" else v.column.cast("string"), F.lit(""))


def json_list(text: Column) -> Column:
    """The items of a JSON list as texts, those that are no text as JSON; an empty array for anything else."""
    return F.coalesce(F.when(F.trim(text).startswith("["), F.from_json(text, "array<string>")), F.array().cast("array<string>"))


def files_items(text: Column) -> Column:
    """The items of a FILES value given as JSON; entries that are no objects, and other values, are left out."""
    kind = "array<struct<name:string,ref:string,sha256:string,size:bigint,type:string>>"
    items = F.filter(json_list(text), lambda x: F.ltrim(x).startswith("{"))
    return F.transform(items, lambda x: F.from_json(x, kind.removeprefix("array<").removesuffix(">")))


def option_position(v: Value) -> Column:
    """The place of a SELECT's value among its options; null for other values."""
    options = v.meaning.field.values if v.meaning.field else []
    return F.nullif(F.array_position(F.array(*map(F.lit, options)).cast("array<string>"), F.coalesce(v.column, F.lit(""))), F.lit(0))


def folded(c: Column) -> Column:
    return casefold(c.cast("string"))


#: Fixed values: (thousands, decimal) of number styles.
NUMBER_STYLES = {"COMMAS_AND_DOT": (",", "."), "DOTS_AND_COMMA": (".", ","), "SPACES_AND_COMMA": (" ", ","), "APOSTROPHE_AND_DOT": ("'", ".")}


def number_text(number: Column, style: str = "COMMAS_AND_DOT", places: int | None = None) -> Column:
    """A number in a style; rounded half-even to places, else without trailing zeros."""
    if places is None:
        text = F.regexp_replace(F.format_number(number, 10), r"\.?0+$", "")
        text = F.when(number.cast("string").contains("."), text).otherwise(F.format_number(number, 0))
    else:
        text = F.format_number(F.bround(number, places), places)
    thousands, point = NUMBER_STYLES[style]
    return F.translate(text, ",.", thousands + point)


#: Date and time patterns by style.
DATE_STYLES = {"DAY_FIRST": "dd.MM.yyyy", "MONTH_FIRST": "MM/dd/yyyy", "YEAR_FIRST": "yyyy-MM-dd"}
TIME_STYLES = {"24": "HH:mm", "12": "hh:mm a"}


def instant_text(instant: Column, context: Context, date_style: str = "DAY_FIRST", time_style: str = "24") -> Column:
    return F.date_format(context.local(instant), f"{DATE_STYLES[date_style]} {TIME_STYLES[time_style]}")


def display(of: ObjectType, key: str, style: str = "COMMAS_AND_DOT") -> Column:
    """Readable text of a field; empty for no value."""
    m = of.resolve(key)
    v, c = value(of, key), F.col(m.base)
    none = F.lit("")
    if m.type == "CURRENCY" and not m.sub:
        return F.coalesce(F.trim(F.concat_ws(" ", number_text(v.column, style, 2), c.currencyCode)), none)
    if m.type == "ADDRESS" and not m.sub:
        parts = ("addressStreet1", "addressStreet2", "addressPostcode", "addressCity", "addressState", "addressCountry")
        return F.concat_ws(", ", *(F.nullif(c.getField(p), none) for p in parts))
    if m.type == "PHONES" and not m.sub:
        return F.coalesce(F.trim(F.concat_ws(" ", c.primaryPhoneCallingCode, F.nullif(c.primaryPhoneNumber, none))), none)
    if m.type == "RELATION":
        return F.coalesce(c.title, c.id, none)
    if m.type == "MORPH_RELATION":
        return F.coalesce(F.array_join(F.transform(c, lambda x: F.coalesce(x.title, x.id)), ", "), none)
    if m.type in ("SELECT", "MULTI_SELECT") and m.field:
        labels = F.create_map(*(F.lit(x) for o in m.field.options for x in (o.value, o.label))) if m.field.options else F.create_map().cast("map<string,string>")
        one = lambda x: F.coalesce(F.try_element_at(labels, x), x)
        return F.coalesce(F.array_join(F.transform(c, one), ", ") if m.type == "MULTI_SELECT" else one(c), none)
    if m.type == "RATING":
        return F.coalesce(F.repeat(F.lit("★"), v.number.cast("int")), none)
    if m.type == "BOOLEAN":
        return F.when(c.isNull(), none).when(c, "✓").otherwise("✗")
    if v.kind == "list":
        return F.coalesce(F.array_join(v.column, ", "), none)
    if v.kind in ("number", "numeric"):
        return F.coalesce(number_text(v.number, style), v.column.cast("string"), none)
    return F.coalesce(v.column.cast("string"), none)


def title(of: ObjectType) -> Column:
    """A record's title: its label field, else its object's label and the start of its id."""
    fallback = F.concat(F.lit(f"{of.label or of.name} "), F.substring("crm_id", 1, 8))
    return F.coalesce(F.nullif(F.trim(display(of, of.label_field)), F.lit("")), fallback)
