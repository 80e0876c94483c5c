"""Settings, views, dashboards and roles: small JSON documents that the driver reads, and their check against the model."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from ..operators.aggregates import ORDERS, AggregateError, function_name
from ..operators.filters import problems
from ..schema import Model, ObjectType, SchemaError

#: Bytes of one document, at most; larger ones are no settings.
MOST_BYTES = 16 << 20


def read_document(spark: SparkSession, path: str) -> dict:
    """One JSON document from wherever Spark can read; its size is looked at before its content."""
    files = spark.read.format("binaryFile").load(path)
    if (size := files.select("length").first().length) > MOST_BYTES:
        raise ValueError(f"{path} has {size} bytes; settings have {MOST_BYTES} at most")
    found = json.loads(bytes(files.select("content").first().content).decode("utf-8-sig"))
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no object")
    return found


def _fields(of: ObjectType, place: str, keys: list) -> list[str]:
    out = []
    for key in keys:
        try:
            of.resolve(str(key))
        except SchemaError as e:
            out.append(f"{place}: {e}")
    return out


def view_problems(model: Model, views: dict[str, dict]) -> list[str]:
    """What is wrong with view definitions {name: {object, type, fields, filter, sorts, groupBy, dateField}}."""
    found: list[str] = []
    for name, view in views.items():
        try:
            of = model.object(view.get("object", ""))
        except SchemaError as e:
            found.append(f"{name}: {e}")
            continue
        found += _fields(of, name, [*view.get("fields", []), *(s.get("field") for s in view.get("sorts", []))])
        found += [f"{name}: {p}" for p in problems(of, view.get("filter"))]
        kind = str(view.get("type", "TABLE")).upper()
        needs = {"TABLE": None, "KANBAN": ("groupBy", ("SELECT",)), "CALENDAR": ("dateField", ("DATE", "DATE_TIME"))}
        if kind not in needs:
            found.append(f"{name}: no view is a {kind}")
        elif needs[kind]:
            key, types = needs[kind]
            if not view.get(key):
                found.append(f"{name}: a {kind} needs {key}")
            elif not (wrong := _fields(of, name, [view[key]])) and of.resolve(view[key]).type not in types:
                found.append(f"{name}: {key} is {of.resolve(view[key]).type}, not {' or '.join(types)}")
            else:
                found += wrong
    return found


def dashboard_problems(model: Model, dashboards: dict[str, dict]) -> list[str]:
    """What is wrong with dashboards {name: {widgets: [{object, kind, function, field, groupBy, orderBy, filter}]}}."""
    found: list[str] = []
    for name, board in dashboards.items():
        for k, widget in enumerate(board.get("widgets", []), 1):
            place = f"{name}.{k}"
            try:
                of = model.object(widget.get("object", ""))
                function_name(widget.get("function", "COUNT"))
            except (SchemaError, AggregateError) as e:
                found.append(f"{place}: {e}")
                continue
            found += _fields(of, place, [widget[key] for key in ("field", "groupBy") if widget.get(key)])
            if widget.get("orderBy") and widget["orderBy"] not in ORDERS:
                found.append(f"{place}: unknown order {widget['orderBy']}")
            if str(widget.get("kind", "NUMBER")).upper() in ("BAR", "LINE", "PIE") and not widget.get("groupBy"):
                found.append(f"{place}: a chart needs groupBy")
            found += [f"{place}: {p}" for p in problems(of, widget.get("filter"))]
    return found


def registry_rows(spark: SparkSession, path: str, list_name: str):
    """The rows of a registry file {list_name: [...]} (concepts, clusters, sources), read by Spark however long it is."""
    from .records import read_json_table

    return read_json_table(spark, path, list_name)
