"""Run-time schemas: a model document gives objects and typed fields, which become Spark types."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LINK = T.StructType([T.StructField(n, T.StringType()) for n in ("object", "id", "title")])


def _texts(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


#: The parts of composite fields.
COMPOSITES: dict[str, T.StructType] = {
    "CURRENCY": T.StructType([T.StructField("amountMicros", T.LongType()), T.StructField("currencyCode", T.StringType())]),
    "FULL_NAME": T.StructType(_texts("firstName", "lastName")),
    "ADDRESS": T.StructType([*_texts("addressStreet1", "addressStreet2", "addressPostcode", "addressCity", "addressState", "addressCountry"), T.StructField("addressLat", T.DoubleType()), T.StructField("addressLng", T.DoubleType())]),
    "EMAILS": T.StructType([T.StructField("primaryEmail", T.StringType()), T.StructField("additionalEmails", T.ArrayType(T.StringType()))]),
    "LINKS": T.StructType([*_texts("primaryLinkUrl", "primaryLinkLabel"), T.StructField("secondaryLinks", T.ArrayType(T.StructType(_texts("url", "label"))))]),
    "PHONES": T.StructType([*_texts("primaryPhoneNumber", "primaryPhoneCountryCode", "primaryPhoneCallingCode"), T.StructField("additionalPhones", T.ArrayType(T.StringType()))]),
}
#: The part that stands for the whole in comparisons.
PRIMARY = {"CURRENCY": "amountMicros", "ADDRESS": "addressCity", "EMAILS": "primaryEmail", "LINKS": "primaryLinkUrl", "PHONES": "primaryPhoneNumber"}

SCALARS: dict[str, T.DataType] = {
    "TEXT": T.StringType(), "UUID": T.StringType(), "NUMBER": T.DecimalType(38, 10), "NUMERIC": T.StringType(), "BOOLEAN": T.BooleanType(), "DATE": T.DateType(), "DATE_TIME": T.TimestampType(),
    "SELECT": T.StringType(), "MULTI_SELECT": T.ArrayType(T.StringType()), "RATING": T.StringType(), "ARRAY": T.ArrayType(T.StringType()), "RAW_JSON": T.StringType(), "RICH_TEXT": T.StringType(),
    "FILES": T.ArrayType(T.StructType([*_texts("name", "ref", "sha256"), T.StructField("size", T.LongType()), *_texts("type")])), "RELATION": LINK, "MORPH_RELATION": T.ArrayType(LINK),
}

#: Columns that every object has.
SYSTEM: dict[str, str] = {
    "crm_id": "UUID", "crm_title": "TEXT", "crm_created_at": "DATE_TIME", "crm_updated_at": "DATE_TIME", "crm_deleted_at": "DATE_TIME",
    "crm_created_by": "TEXT", "crm_updated_by": "TEXT", "crm_created_source": "TEXT", "crm_position": "NUMBER",
}
RATINGS = [f"RATING_{k}" for k in range(1, 6)]


class SchemaError(ValueError):
    """A model, or a name looked up in it, isn't valid."""


@dataclass(frozen=True)
class Option:
    value: str
    label: str = ""
    color: str = ""
    previous: tuple[str, ...] = ()


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    label: str = ""
    nullable: bool = True
    unique: bool = False
    default: object = None
    options: tuple[Option, ...] = ()
    targets: tuple[str, ...] = ()
    inverse: bool = False
    on_delete: str = "SET_NULL"
    active: bool = True

    @property
    def values(self) -> list[str]:
        return [o.value for o in self.options]

    @property
    def spark_type(self) -> T.DataType | None:
        """None for the computed side of a relation, which stores nothing."""
        return None if self.inverse else COMPOSITES.get(self.type) or SCALARS[self.type]


@dataclass(frozen=True)
class Resolved:
    """What a key such as amount or address.addressCity means."""

    key: str
    type: str
    base: str
    sub: str
    field: Field | None


@dataclass(frozen=True)
class ObjectType:
    name: str
    label_field: str
    fields: dict[str, Field] = field(default_factory=dict)
    label: str = ""
    standard: bool = False
    active: bool = True

    def resolve(self, key: str) -> Resolved:
        if key in SYSTEM:
            return Resolved(key, SYSTEM[key], key, "", None)
        base, _, sub = key.partition(".")
        if base not in self.fields:
            raise SchemaError(f"unknown field {self.name}.{key}")
        f = self.fields[base]
        if sub and f.type in COMPOSITES and sub not in [*COMPOSITES[f.type].fieldNames(), *(["amount"] if f.type == "CURRENCY" else [])]:
            raise SchemaError(f"unknown part {self.name}.{key}")
        if sub and f.type not in COMPOSITES:
            raise SchemaError(f"{self.name}.{base} has no parts")
        return Resolved(key, f.type, base, sub, f)

    def with_field(self, f: Field) -> ObjectType:
        return replace(self, fields={**self.fields, f.name: f})

    def without(self, name: str) -> ObjectType:
        return replace(self, fields={k: v for k, v in self.fields.items() if k != name})

    @property
    def schema(self) -> T.StructType:
        system = [T.StructField(k, SCALARS[t]) for k, t in SYSTEM.items()]
        own = [T.StructField(f.name, f.spark_type, f.nullable, {"type": f.type, "label": f.label}) for f in self.fields.values() if f.spark_type is not None]
        return T.StructType([*system, *own])

    def conform(self, df: DataFrame) -> DataFrame:
        """df with every column of the schema: missing ones null, undeclared ones in a map column `extra`."""
        known = {f.name: f.dataType for f in self.schema}
        extra = [c for c in df.columns if c not in known]
        columns = [(F.col(n).cast(t) if n in df.columns else F.lit(None).cast(t)).alias(n) for n, t in known.items()]
        pairs = [x for c in extra for x in (F.lit(c), F.to_json(F.struct(c)))]
        return df.select(*columns, (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("extra"))


@dataclass(frozen=True)
class Model:
    objects: dict[str, ObjectType]

    @classmethod
    def from_document(cls, document: dict) -> Model:
        """From {"objects": {name: {"labelField", "fields": {name: {"type", ...}}}}}."""
        objects = {}
        for name, spec in document.get("objects", {}).items():
            fields = {}
            for key, f in spec.get("fields", {}).items():
                if f.get("type") not in {*SCALARS, *COMPOSITES}:
                    raise SchemaError(f"{name}.{key}: unknown type {f.get('type')!r}")
                relation = f.get("relation") or {}
                targets = relation.get("targets") or [relation["target"]] if relation else []
                options = tuple(Option(o["value"], o.get("label", o["value"]), o.get("color", ""), tuple(o.get("previousValues", ()))) for o in f.get("options", []))
                if len({o.value for o in options}) < len(options):
                    raise SchemaError(f"{name}.{key}: an option is listed twice")
                fields[key] = Field(key, f["type"], f.get("label", key), f.get("nullable", True), f.get("unique", False), f.get("default"), options, tuple(targets), relation.get("type") == "ONE_TO_MANY", relation.get("onDelete", "SET_NULL"), f.get("active", True))
            label = spec.get("labelField", "name")
            if label not in fields:
                raise SchemaError(f"{name}: its label field {label} isn't declared")
            objects[name] = ObjectType(name, label, fields, spec.get("label", name), spec.get("standard", False), spec.get("active", True))
        for o in objects.values():
            for f in o.fields.values():
                if missing := [t for t in f.targets if t not in objects]:
                    raise SchemaError(f"{o.name}.{f.name}: unknown target {missing[0]}")
        return cls(objects)

    def object(self, name: str) -> ObjectType:
        if name not in self.objects:
            raise SchemaError(f"unknown object {name}")
        return self.objects[name]

    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps(self.objects, default=lambda x: x.__dict__, sort_keys=True).encode()).hexdigest()
