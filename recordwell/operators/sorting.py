"""Order of records: several keys, empty values last either way, a unique last key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import Value, display, folded, option_position, value
from ..schema import ObjectType


class SortError(ValueError):
    """A sort isn't valid."""


def sort_columns(of: ObjectType, sorts: list[dict] | None, tie: str = "crm_id") -> list[Column]:
    """Columns for orderBy: {field, direction}; links by title, options by position, ratings by number."""
    out: list[Column] = []
    for s in sorts or []:
        down = str(s.get("direction", "asc")).lower()
        if down not in ("asc", "desc"):
            raise SortError(f"unknown direction {down!r}")
        for key in comparable(of, s["field"]):
            out.append(key.desc_nulls_last() if down == "desc" else key.asc_nulls_last())
    return [*out, F.col(tie).asc()]


def comparable(of: ObjectType, key: str) -> list[Column]:
    """The columns that a field is ordered by; null for an empty value."""
    v = value(of, key)
    if v.meaning.type in ("RELATION", "MORPH_RELATION"):
        return [F.nullif(folded(display(of, key)), F.lit(""))]
    if v.kind == "list":
        return [F.nullif(folded(F.get(v.column, F.lit(0))), F.lit(""))]
    if v.meaning.type == "SELECT":
        position = option_position(v)  # values that are no option come after all options
        return [F.when(~v.empty, F.coalesce(position, F.lit(1 << 30))), F.when(position.isNull() & ~v.empty, folded(v.column))]
    if v.kind == "rating":
        return [v.number]
    if v.kind in ("text", "numeric"):
        return [F.nullif(folded(v.column), F.lit(""))]
    return [v.column]


def default_order(df: DataFrame, of: ObjectType) -> DataFrame:
    """By position (none last), folded title, id."""
    return df.orderBy(F.col("crm_position").asc_nulls_last(), *comparable(of, "crm_title"), F.col("crm_id"))


def page(df: DataFrame, of: ObjectType, sorts: list[dict] | None, limit: int | None = 50, offset: int = 0) -> DataFrame:
    """One page of sorted records; a limit becomes a top-k, not a full sort."""
    if limit is not None and not 0 <= limit <= 1000:
        raise SortError("a page has up to 1000 rows")
    ordered = df.orderBy(*sort_columns(of, sorts))
    if offset:
        ordered = ordered.offset(offset)
    return ordered if limit is None else ordered.limit(limit)


def top_snippet(lines: Column, score) -> Column:
    """Of an array of lines the one with the highest score(line), the first of equals; null if none scores."""
    ranked = F.transform(lines, lambda x, k: F.struct(score(x).alias("s"), (-k).alias("k"), x.alias("line")))
    best = F.array_max(ranked)
    return F.when(best.s > 0, best.line)


__all__ = ["SortError", "Value", "comparable", "default_order", "page", "sort_columns", "top_snippet"]
