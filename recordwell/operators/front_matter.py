"""Front matter with types: a page's properties as MAP<STRING, VARIANT>, and back to text.

The head of a page is cut into blocks, one a property: a line `key: value` and the indented, blank and comment lines below it. A value is a
scalar (text, quoted text, whole or decimal number, true, false, null), a list in one line, or, if the line ends at the colon, the
list of the items below. All of it is expressions on the page's text, linear in the head's length, so pages are read where they lie.

Defined results: a null text has null data; a page without a head has an empty map. What can't be read stands in `problems` as
kind and place, its property left out: unclosed (the head), tabs, indent (another line than a flat item), item (below a property that has a
value), key, duplicate (the first counts), quote, list, nested, block (block scalars, anchors, tags), number (not finite).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD = r"(?s)\A---\r?\n(|.*?\n)---(?:\r?\n|\z)"
#: What a property may be called, names that none may have, and the two forms of numbers.
KEY = r"^[A-Za-z0-9_][A-Za-z0-9_. -]{0,127}$"
RESERVED = ("__proto__", "constructor", "prototype")
WHOLE = r"^-?(?:0|[1-9][0-9]*)$"
DECIMAL = r"^-?(?:0|[1-9][0-9]*)\.[0-9]+(?:[eE][+-]?[0-9]+)?$"

_DOUBLE = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_SINGLE = r"'[^']*+(?:''[^']*+)*+'"
#: An item of a list in one line, behind its comma.
_ITEM = rf""",\s*+({_DOUBLE}|{_SINGLE}|[^,"'\s][^,]*+)\s*"""


def _no(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _wrong(text: Column) -> Column:
    """What is wrong with a trimmed scalar."""
    double, single = text.startswith('"'), text.startswith("'")
    return (
        F.when(text.rlike(r"^[|>&*!]"), "block").when(text.startswith("[") | text.endswith("]"), "list").when(text.startswith("{") | text.endswith("}"), "nested")
        .when(double & (~text.rlike(rf"(?s)^{_DOUBLE}$") | F.try_parse_json(text).isNull()), "quote").when(single & ~text.rlike(r"(?s)^'.*'$"), "quote")
        .when(text.rlike(DECIMAL) & F.abs(text.try_cast("double")).isin(float("inf")), "number").when(text.rlike(WHOLE) & F.abs(text.try_cast("double")).isin(float("inf")), "number")
    )


def _value(text: Column) -> Column:
    """A sound scalar as VARIANT."""
    single = F.replace(F.substring(text, F.lit(2), F.length(text) - 2), F.lit("''"), F.lit("'"))
    json = text.startswith('"') | text.rlike(WHOLE) | text.rlike(DECIMAL)
    word = F.lower(text)
    return F.when(json, F.try_parse_json(text)).when(text.startswith("'"), single.cast("variant")).when(word.isin("true", "false", "null"), F.try_parse_json(word)).when(text == "~", F.try_parse_json(F.lit("null"))).otherwise(text.cast("variant"))


def _stray(line: Column, items: bool) -> Column:
    """What is wrong with a line that isn't the first of its block."""
    fine = line.rlike(r"^\s*(?:#|$)")
    return F.when(fine, _no("string")).when(line.rlike(r"^ *\t"), F.concat(F.lit("tabs: "), line)).when(line.rlike(r"^  - ") if items else F.lit(False), _no("string")).otherwise(F.concat(F.lit("indent: "), line))


def _blocks(blocks: Column) -> Column:
    """(key, value, good, problems) of each block, in steps: what a step finds is bound once for the next."""
    none = F.array().cast("array<string>")
    steps = [
        lambda b: F.split(b, "\n"),
        lambda b: F.struct(F.get(b, F.lit(0)).alias("first"), F.slice(b, F.lit(2), F.size(b)).alias("below")),
        lambda b: F.struct(
            b["first"].alias("first"), F.substring_index(b["first"], ":", 1).alias("key"), F.trim(F.regexp_extract(b["first"], r"(?s)^[^:]*:(.*)$", 1)).alias("raw"),
            F.transform(F.filter(b.below, lambda x: x.rlike(r"^  - ")), lambda x: F.trim(F.substring(x, F.lit(5), F.length(x)))).alias("items"),
            F.filter(F.transform(b.below, lambda x: _stray(x, True)), lambda x: x.isNotNull()).alias("stray"),
        ),
        lambda b: F.struct(b["first"].alias("first"), b.key.alias("key"), b.raw.alias("raw"), b["items"].alias("items"), b.stray.alias("stray"), F.when(b.raw.rlike(r"^\[.*\]$"), F.trim(F.substring(b.raw, F.lit(2), F.length(b.raw) - 2))).alias("inner")),
        lambda b: F.struct(
            F.when(~(b["first"].contains(":") & b.key.rlike(KEY) & (b.key == F.rtrim(b.key)) & ~b.key.isin(*RESERVED)), "key").when((b.raw != "") & (F.size(b["items"]) > 0), "item")
            .when((b.inner != "") & (F.array_join(F.regexp_extract_all(F.concat(F.lit(","), b.inner), F.lit(_ITEM), F.lit(0)), "") != F.concat(F.lit(","), b.inner)), "list").alias("wrong"),
            b["first"].alias("first"), b.key.alias("key"), b.stray.alias("stray"), ((b.raw == "") | b.inner.isNotNull()).alias("many"),
            F.when(b.raw == "", b["items"]).when(b.inner == "", none).when(b.inner.isNotNull(), F.transform(F.regexp_extract_all(F.concat(F.lit(","), b.inner), F.lit(_ITEM), F.lit(1)), lambda x: F.trim(x))).otherwise(F.array(b.raw)).alias("texts"),
        ),
        lambda b: F.struct(b["first"].alias("first"), b.key.alias("key"), b.stray.alias("stray"), b.many.alias("many"), b.texts.alias("texts"), F.coalesce(b.wrong, F.get(F.filter(F.transform(b.texts, _wrong), lambda w: w.isNotNull()), F.lit(0))).alias("wrong")),
        lambda b: F.struct(
            b.key.alias("key"), b.wrong.isNull().alias("good"),
            F.when(b.wrong.isNull(), F.when(b.many, F.transform(b.texts, _value).cast("variant")).otherwise(_value(F.get(b.texts, F.lit(0))))).alias("value"),
            F.concat(F.when(b.wrong.isNotNull(), F.array(F.concat(b.wrong, F.lit(": "), F.when(b.wrong == "key", b["first"]).otherwise(b.key)))).otherwise(none), b.stray).alias("problems"),
        ),
    ]
    for step in steps:
        blocks = F.transform(blocks, step)
    return blocks


def typed(df: DataFrame, text: str = "text") -> DataFrame:
    """df with `data` (MAP<STRING, VARIANT>, in the page's order), `comments`, `body` and `problems`; columns of these names are replaced."""
    page = F.col(text)
    closed = page.rlike(HEAD)
    head = F.concat(F.lit("\n"), F.replace(F.regexp_extract(page, HEAD, 1), F.lit("\r\n"), F.lit("\n")))
    blocks = F.split(head, r"\n(?=[^\s#-])")
    names = [c for c in df.columns if c not in ("data", "comments", "body", "problems")]
    held = "front_matter"
    while held in df.columns:
        held += "_"
    parts = F.struct(_blocks(F.slice(blocks, F.lit(2), F.size(blocks))).alias("blocks"), F.split(F.get(blocks, F.lit(0)), "\n").alias("before"), F.split(head, "\n").alias("lines"))
    read = df.select(*(F.col(f"`{c}`") for c in names), parts.alias(held))
    found, before, lines = F.col(f"{held}.blocks"), F.col(f"{held}.before"), F.col(f"{held}.lines")
    keys = F.transform(F.filter(found, lambda b: b.good), lambda b: b.key)
    again = F.size(keys) > F.size(F.array_distinct(keys))
    good = F.transform(F.filter(found, lambda b: b.good), lambda b: F.struct(b.key.alias("key"), b["value"].alias("value")))
    first = F.filter(good, lambda b, k: F.array_position(keys, b.key) == k + 1)
    twice = F.transform(F.filter(F.array_distinct(keys), lambda x: F.size(F.filter(keys, lambda y: y == x)) > 1), lambda x: F.concat(F.lit("duplicate: "), x))
    none = F.array().cast("array<string>")
    unclosed = F.when(page.rlike(r"\A---\r?(?:\n|\z)") & ~closed, F.array(F.lit("unclosed"))).otherwise(none)
    stray = F.filter(F.transform(before, lambda x: _stray(x, False)), lambda x: x.isNotNull())
    problems = F.concat(unclosed, stray, F.flatten(F.transform(found, lambda b: b.problems)), F.when(again, twice).otherwise(none))
    return read.select(
        *(F.col(f"`{c}`") for c in names), F.map_from_entries(F.when(again, first).otherwise(good)).alias("data"),
        F.transform(F.filter(lines, lambda x: x.rlike(r"^\s*#")), lambda x: F.ltrim(x)).alias("comments"), F.regexp_replace(page, HEAD, "").alias("body"), problems.alias("problems"),
    )


def put(data: Column, key: str, value: Column | None) -> Column:
    """data with a property set to a VARIANT, in its place or at the end; None takes it away."""
    if value is None:
        return F.map_filter(data, lambda k, _: k != key)
    here = F.transform_values(data, lambda k, v: F.when(k == key, value).otherwise(v))
    return F.when(F.map_contains_key(data, key), here).otherwise(F.map_concat(data, F.create_map(F.lit(key), value)))


def _shown(value: Column) -> Column:
    """A scalar VARIANT as text that is read as the same value."""
    text = value.try_cast("string")
    plain = text.rlike(r"^[\p{L}\p{N}_./@(][^\x00-\x1f]*$") & ~text.rlike(r"[\s\]}]$") & ~F.lower(text).isin("true", "false", "null") & ~text.rlike(WHOLE) & ~text.rlike(DECIMAL)
    return F.when((F.schema_of_variant(value) == "STRING") & plain, text).otherwise(F.to_json(value))


def head_text(data: Column, comments: Column) -> Column:
    """The head of a page: comments first, then a line a scalar, and a line an item below the name of a list."""
    is_list = lambda v: F.schema_of_variant(v).startswith("ARRAY")
    items = lambda v: F.array_join(F.transform(v.try_cast("array<variant>"), lambda i: F.concat(F.lit("\n  - "), _shown(i))), "")
    lines = F.transform(F.map_entries(data), lambda e: F.concat(e.key, F.when(is_list(e["value"]), F.when(items(e["value"]) == "", F.lit(": []")).otherwise(F.concat(F.lit(":"), items(e["value"])))).otherwise(F.concat(F.lit(": "), _shown(e["value"])))))
    return F.concat(F.lit("---\n"), F.array_join(F.transform(F.concat(comments, lines), lambda x: F.concat(x, F.lit("\n"))), ""), F.lit("---\n"))
