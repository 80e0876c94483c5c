"""Document pages: front matter, selectors, bulk edits, claims, trust, freshness, inventory."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD = r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n?"
_entry = r"(?m)^([A-Za-z_][\w.-]*):[ \t]*(.*?)[ \t]*$((?:\n[ \t]*-[ \t]+.*$)*)"


def parsed(df: DataFrame, text: str = "text") -> DataFrame:
    """df with `data` (property to list of texts), `is_list` (property to whether it is written as a list) and `body`.

    Scalars are lists of one; nested properties aren't read and turn up in `bad_lines`.
    """
    head = F.regexp_extract(F.col(text), HEAD, 1)
    whole = F.regexp_extract_all(head, F.lit(_entry), F.lit(0))
    plain = lambda s: F.regexp_replace(F.trim(s), r"""^(["'])(.*)\1$""", "$2")
    inline = r"^\[(.*)\]$"

    def values(entry: Column) -> Column:
        first = F.regexp_extract(entry, _entry, 2)
        items = F.regexp_extract_all(F.regexp_extract(entry, _entry, 3), F.lit(r"(?m)^[ \t]*-[ \t]+(.*?)[ \t]*$"), F.lit(1))
        in_line = F.filter(F.split(F.regexp_extract(first, inline, 1), r"\s*,\s*"), lambda x: x != "")
        return F.transform(F.when(F.size(items) > 0, items).when(first.rlike(inline), in_line).when(first == "", F.array().cast("array<string>")).otherwise(F.array(first)), plain)

    key = lambda e: F.regexp_extract(e, _entry, 1)
    listed = lambda e: F.regexp_extract(e, _entry, 2).rlike(inline) | (F.length(F.regexp_extract(e, _entry, 3)) > 0)
    last = lambda pairs: F.map_from_entries(F.filter(pairs, lambda p, k: ~F.exists(F.slice(pairs, k + 2, F.size(pairs)), lambda q: q.key == p.key)))
    out = df.withColumn("entries", whole)
    return out.select(
        *df.columns, last(F.transform("entries", lambda e: F.struct(key(e).alias("key"), values(e).alias("value")))).alias("data"), last(F.transform("entries", lambda e: F.struct(key(e).alias("key"), listed(e).alias("value")))).alias("is_list"),
        F.regexp_replace(F.col(text), HEAD, "").alias("body"), F.size(F.regexp_extract_all(head, F.lit(r"(?m)^[ \t]+[^-\s].*$"), F.lit(0))).alias("bad_lines"),
    )


def property_of(name: str, path: str = "path") -> Column:
    """A property's values; __path, __folder, __filename and __extension come from the path."""
    p = F.col(path)
    derived = {"__path": p, "__folder": F.regexp_extract(p, r"^(.*?)/?[^/]*$", 1), "__filename": F.regexp_extract(p, r"([^/]*)$", 1), "__extension": F.regexp_extract(p, r"\.([^./]*)$", 1)}
    return F.array(derived[name]) if name in derived else F.try_element_at("data", F.lit(name))


def selector(spec: dict, path: str = "path") -> Column:
    """Which pages a selector takes: {kind: all | paths | filter}, the last with op and conditions {property, operator, value}."""
    if spec["kind"] == "all":
        return F.lit(True)
    if spec["kind"] == "paths":
        return F.col(path).isin(list(spec["paths"]))
    conditions = spec.get("conditions", [])
    if len(conditions) > 100:
        raise ValueError("a selector has up to 100 conditions")
    parts = [F.coalesce(_holds(c, path), F.lit(False)) for c in conditions]
    return reduce(or_ if spec.get("op", "AND").upper() == "OR" else and_, parts) if parts else F.lit(True)


def _holds(c: dict, path: str) -> Column:
    values, wanted = property_of(c["property"], path), F.lit(str(c.get("value") or ""))
    some = lambda f: F.coalesce(F.exists(values, f), F.lit(False))
    empty = values.isNull() | ~F.exists(values, lambda v: v != "")
    made = {
        "exists": lambda: values.isNotNull(), "not_exists": lambda: values.isNull(), "equals": lambda: some(lambda v: v == wanted), "not_equals": lambda: ~some(lambda v: v == wanted),
        "contains": lambda: some(lambda v: F.lower(v).contains(F.lower(wanted))), "not_contains": lambda: ~some(lambda v: F.lower(v).contains(F.lower(wanted))), "starts_with": lambda: some(lambda v: v.startswith(wanted)),
        "ends_with": lambda: some(lambda v: v.endswith(wanted)), "is_empty": lambda: empty, "is_not_empty": lambda: ~empty, "is_list": lambda: F.try_element_at("is_list", F.lit(c["property"])), "is_string": lambda: ~F.try_element_at("is_list", F.lit(c["property"])),
        "in_path": lambda: F.col(path).startswith(F.concat(F.regexp_replace(wanted, "/+$", ""), F.lit("/"))),
    }
    if c["operator"] not in made:
        raise ValueError(f"unknown operator {c['operator']!r}")
    return made[c["operator"]]()


def _swap(name: str, value: Column) -> Column:
    """data with a property set; null takes it away."""
    rest = F.map_filter("data", lambda k, _: k != name)
    return F.when(value.isNotNull(), F.map_concat(rest, F.create_map(F.lit(name), value))).otherwise(rest)


def edited(df: DataFrame, which: Column, action: dict) -> DataFrame:
    """One bulk edit of front matter: set (skip, overwrite, merge_list), delete, rename, copy, merge, normalize_values, dedupe_wikilinks."""
    kind, name = action["action"], action.get("property")
    now = F.try_element_at("data", F.lit(name)) if name else None
    if kind == "set":
        given = F.array(*map(F.lit, action["value"])) if isinstance(action["value"], list) else F.array(F.lit(str(action["value"])))
        mode = action.get("mode", "overwrite")
        data = _swap(name, given if mode == "overwrite" else F.coalesce(now, given) if mode == "skip" else F.array_union(F.coalesce(now, F.array().cast("array<string>")), given))
    elif kind == "delete":
        data = _swap(name, F.lit(None).cast("array<string>"))
    elif kind in ("rename", "copy", "merge"):
        to = action["to"]
        there = F.try_element_at("data", F.lit(to))
        taken = F.array_union(F.coalesce(there, F.array().cast("array<string>")), now) if kind == "merge" else F.coalesce(there, now) if action.get("mode") == "skip" else now
        moved = F.map_concat(F.map_filter("data", lambda k, _: ~k.isin(*([to] if kind == "copy" else [to, name]))), F.create_map(F.lit(to), taken))
        data = F.when(now.isNotNull(), moved).otherwise(F.col("data"))
    elif kind == "normalize_values":
        one = {"trim": lambda x: F.trim(x), "lowercase": F.lower, "titlecase": F.initcap, "strip_diacritics": _plain}
        value = now
        for step in action.get("steps", []):
            value = F.transform(value, one[step])
        if mapping := action.get("mapping"):
            known = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
            value = F.transform(value, lambda v: F.coalesce(F.try_element_at(known, v), v))
        data = _swap(name, F.array_distinct(value))
    elif kind == "dedupe_wikilinks":
        target = lambda v: F.lower(F.regexp_extract(v, r"^\[\[([^|\]#]+)", 1))
        kept = F.filter(now, lambda v, k: (target(v) == "") | ~F.exists(F.slice(now, 1, k), lambda u: target(u) == target(v)))
        data = _swap(name, kept)
    else:
        raise ValueError(f"unknown action {kind!r}")
    return df.withColumn("data", F.when(which, data).otherwise(F.col("data")))


def _plain(v: Column) -> Column:
    from ..functions.text import without_accents

    return without_accents(v)


CLAIM = r"(?s)<!--\s*claim\s+(.*?)-->(.*?)<!--\s*/claim\s*-->"


def claims(df: DataFrame, body: str = "body") -> DataFrame:
    """A row a claim block: its attributes and text."""
    each = df.select("path", F.explode(F.regexp_extract_all(F.col(body), F.lit(CLAIM), F.lit(0))).alias("c"))
    attribute = lambda n: F.nullif(F.regexp_extract(F.regexp_extract("c", CLAIM, 1), rf'\b{n}\s*[=:]\s*"?([^"\s]+)', 1), F.lit(""))
    listed = lambda n: F.split(attribute(n), ",")
    return each.select("path", attribute("id").alias("claim_id"), attribute("kind").alias("kind"), attribute("status").alias("status"), listed("sources").alias("sources"), listed("replaces").alias("replaces"), listed("contradicts").alias("contradicts"), F.regexp_replace(F.regexp_extract("c", CLAIM, 2), r"^\s+|\s+$", "").alias("text"))


def trust_tier(reviewer: Column) -> Column:
    return F.when(reviewer.startswith("human:"), "human-reviewed").when(reviewer.startswith("agent:") | reviewer.startswith("machine:"), "machine-confirmed").otherwise("unverified")


def review_state(due: Column, today: Column, attention: Column, soon_days: int = 14) -> Column:
    """unknown, attention-needed, overdue, due-soon or current, the first that holds."""
    return F.when(due.isNull() & ~attention, "unknown").when(attention, "attention-needed").when(due < today, "overdue").when(F.datediff(due, today) <= soon_days, "due-soon").otherwise("current")


def freshness(df: DataFrame, expires: Column, today: Column) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("pages"), F.count(expires).alias("with_expiry"), F.count_if(expires < today).alias("expired"))


def inventory(df: DataFrame) -> DataFrame:
    """(property, pages, n_lists, n_scalars, n_values): mixed spellings of one property show as drift."""
    each = df.select(F.explode("data").alias("property", "values"), "is_list").select("property", "values", F.try_element_at("is_list", F.col("property")).alias("l"))
    return each.groupBy("property").agg(F.count(F.lit(1)).alias("pages"), F.count_if("l").alias("n_lists"), F.count_if(~F.col("l")).alias("n_scalars"), F.sum(F.size("values")).alias("n_values"))
