"""Changes of a run-time schema: the next model, what they ask of the data, and the rewritten rows."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import Field, Model, ObjectType, Option, SchemaError


def _put(model: Model, of: ObjectType) -> Model:
    return Model({**model.objects, of.name: of})


def add_object(model: Model, of: ObjectType) -> Model:
    if of.name in model.objects:
        raise SchemaError(f"{of.name} exists")
    return _put(model, of)


def add_field(model: Model, name: str, f: Field, live_records: int = 0) -> Model:
    of = model.object(name)
    if f.name in of.fields:
        raise SchemaError(f"{name}.{f.name} exists")
    if not f.nullable and f.default is None and live_records:
        raise SchemaError(f"{name}.{f.name} can't be required: there are records without it")
    return _put(model, of.with_field(f))


def update_object(model: Model, name: str, label: str | None = None, label_field: str | None = None) -> Model:
    """An object's label, or the field that names its records; its name and fields stay."""
    of = model.object(name)
    if label_field is not None and (label_field not in of.fields or of.fields[label_field].inverse):
        raise SchemaError(f"{name} has no field {label_field} to name its records by")
    return _put(model, replace(of, label=label or of.label, label_field=label_field or of.label_field))


def with_new_field(records: DataFrame, f: Field) -> DataFrame:
    """Records with the field: empty, or its default for scalars."""
    return records if f.inverse else records.withColumn(f.name, F.lit(f.default).cast(f.spark_type) if f.default is not None else F.lit(None).cast(f.spark_type))


def empty_records(records: DataFrame, column: Column) -> DataFrame:
    """Live records that keep a field from becoming required."""
    return records.where(F.col("crm_deleted_at").isNull() & (column.isNull() | (column.cast("string") == ""))).select("crm_id")


def duplicate_groups(records: DataFrame, column: Column) -> DataFrame:
    """(key, n) that keep a field from becoming unique."""
    return records.where(column.isNotNull()).groupBy(column.alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def add_option(model: Model, name: str, field: str, option: Option, position: int | None = None) -> Model:
    of = model.object(name)
    f = of.fields[field]
    if option.value in f.values or any(option.value in o.previous for o in f.options):
        raise SchemaError(f"{option.value} is or was an option")
    at = len(f.options) if position is None else position
    return _put(model, of.with_field(replace(f, options=(*f.options[:at], option, *f.options[at:]))))


def rename_option(model: Model, name: str, field: str, old: str, new: str) -> Model:
    """The option keeps its place and remembers its earlier value."""
    of = model.object(name)
    f = of.fields[field]
    if old not in f.values or new in f.values:
        raise SchemaError(f"{old} can't become {new}")
    options = tuple(replace(o, value=new, previous=(*o.previous, old)) if o.value == old else o for o in f.options)
    return _put(model, of.with_field(replace(f, options=options, default=new if f.default == old else f.default)))


def remove_option(model: Model, name: str, field: str, value: str, map_to: str | None, used: bool) -> Model:
    of = model.object(name)
    f = of.fields[field]
    if (used or f.default == value) and not map_to:
        raise SchemaError(f"{value} is in use; name the option that takes its place")
    if len(f.options) < 2 or value not in f.values or map_to == value or (map_to and map_to not in f.values):
        raise SchemaError(f"{value} can't be removed")
    gone = next(o for o in f.options if o.value == value)
    options = tuple(replace(o, previous=(*o.previous, value, *gone.previous)) if o.value == map_to else o for o in f.options if o.value != value)
    return _put(model, of.with_field(replace(f, options=options, default=map_to if f.default == value else f.default)))


def rewritten(records: DataFrame, field: Field, old: str, new: str | None) -> DataFrame:
    """An option's value replaced in every record, the trash included; lists keep each value once."""
    c = F.col(field.name)
    if field.type == "MULTI_SELECT":
        swapped = F.transform(c, lambda x: F.when(x == old, F.lit(new)).otherwise(x))
        return records.withColumn(field.name, F.array_distinct(F.filter(swapped, lambda x: x.isNotNull())))
    return records.withColumn(field.name, F.when(c == old, F.lit(new)).otherwise(c))


def migration_rows(records: DataFrame, field: str, old: str, new: str | None, at: Column) -> DataFrame:
    """Change rows of a rewrite: marked as a migration, so they count as no move."""
    hit = records.where(F.col(field) == old)
    change = F.create_map(F.lit(field), F.struct(F.lit(old).alias("old"), F.lit(new).cast("string").alias("new")))
    return hit.select(F.col("crm_id").alias("record_id"), at.alias("at"), change.alias("changes"), F.struct(F.lit("migration").alias("kind")).alias("origin"), F.lit(True).alias("schema_change"))


def set_active(model: Model, name: str, field: str | None, active: bool) -> Model:
    of = model.object(name)
    if field is None:
        return _put(model, replace(of, active=active))
    if field == of.label_field and not active:
        raise SchemaError("the label field stays active")
    return _put(model, of.with_field(replace(of.fields[field], active=active)))


def delete_field(model: Model, name: str, field: str) -> Model:
    of = model.object(name)
    if field == of.label_field or of.standard:
        raise SchemaError(f"{name}.{field} can't be deleted")
    return _put(model, of.without(field))


def delete_object(model: Model, name: str) -> Model:
    """The model without the object; relations lose it as a target, or go with it."""
    if model.object(name).standard:
        raise SchemaError(f"{name} can't be deleted")
    objects = {}
    for of in model.objects.values():
        if of.name == name:
            continue
        for f in list(of.fields.values()):
            if name in f.targets:
                left = tuple(t for t in f.targets if t != name)
                of = of.with_field(replace(f, targets=left)) if left else of.without(f.name)
        objects[of.name] = of
    return Model(objects)


def without_links_to(records: DataFrame, field: Field, name: str) -> DataFrame:
    """Stored links to a deleted object go."""
    c = F.col(field.name)
    cleared = F.filter(c, lambda x: x.object != name) if field.type == "MORPH_RELATION" else F.when(c.object != name, c)
    return records.withColumn(field.name, cleared)


def uses(documents: dict[str, dict], name: str, field: str | None = None, option: str | None = None) -> list[str]:
    """Names of views, dashboards or workflows that speak of an object, a field or an option."""

    def speaks(node, wanted: str) -> bool:
        if isinstance(node, dict):
            return any(k == wanted or speaks(v, wanted) for k, v in node.items())
        if isinstance(node, list):
            return any(speaks(v, wanted) for v in node)
        return isinstance(node, str) and (node == wanted or node.split(".")[0] == wanted)

    return sorted(k for k, d in documents.items() if all(speaks(d, w) for w in (name, field, option) if w))
