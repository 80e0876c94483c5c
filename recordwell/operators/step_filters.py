"""Filters of workflow steps. They differ from record filters: text contains is case-sensitive, dates are
compared as instants, a value that resolves to nothing turns a comparison into an emptiness test."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .filters import FilterError, operand_name


def step_condition(groups: list[dict], leaves: list[dict]) -> Column:
    """A tree given by parent ids: groups {id, parent, op}, leaves {group, left, kind, operand, right}.

    left is a column; right a literal or None.
    """
    children: dict[object, list[Column]] = {}
    for leaf in leaves:
        children.setdefault(leaf.get("group"), []).append(F.coalesce(leaf_condition(leaf["left"], leaf["kind"], leaf["operand"], leaf.get("right")), F.lit(False)))

    def build(group: dict) -> Column:
        inner = children.get(group["id"], []) + [build(g) for g in groups if g.get("parent") == group["id"]]
        return reduce(or_ if group.get("op", "AND").upper() == "OR" else and_, inner) if inner else F.lit(True)

    tops = [g for g in groups if g.get("parent") is None]
    return reduce(and_, [*(build(g) for g in tops), *(children.get(None, []))], F.lit(True))


def leaf_condition(left: Column, kind: str, operand: str, right) -> Column:
    operand = operand_name(operand)
    empty = left.isNull() | (left.cast("string") == "")
    if right in (None, "") and operand in ("IS", "IS_NOT", "CONTAINS", "DOES_NOT_CONTAIN"):
        operand = "IS_EMPTY" if operand in ("IS", "CONTAINS") else "IS_NOT_EMPTY"
    if operand == "IS_EMPTY":
        return empty
    if operand in ("IS_NOT_EMPTY", "IS_NOT_NULL"):
        return ~empty
    if kind in ("NUMBER", "NUMERIC", "CURRENCY"):
        number, bound = left.try_cast("decimal(38,10)"), F.lit(str(right)).try_cast("decimal(38,10)")
        return _compared(number, bound, operand)
    if kind in ("DATE", "DATE_TIME"):
        return _compared(left.cast("timestamp"), F.lit(str(right)).try_cast("timestamp"), operand)
    if kind == "RATING":
        return _compared(F.substring(left, -1, 1).try_cast("int"), F.lit(str(right)[-1]).try_cast("int"), operand)
    if kind == "BOOLEAN":
        same = left.cast("string") == str(right).lower()
        return same if operand == "IS" else ~same
    if kind in ("SELECT", "MULTI_SELECT", "RELATION"):
        among = [str(x) for x in (right if isinstance(right, list) else [right])]
        hit = F.arrays_overlap(left, F.array(*map(F.lit, among))) if kind == "MULTI_SELECT" else left.isin(among)
        return F.coalesce(hit, F.lit(False)) if operand in ("IS", "CONTAINS") else ~F.coalesce(hit, F.lit(False))
    if kind == "UUID":
        same = F.lower(left) == str(right).lower()
        return same if operand == "IS" else ~F.coalesce(same, F.lit(False))
    text = F.coalesce(left.cast("string"), F.lit(""))
    if operand in ("CONTAINS", "DOES_NOT_CONTAIN"):
        return text.contains(str(right)) if operand == "CONTAINS" else ~text.contains(str(right))
    return _compared(text, F.lit(str(right)), operand)


def _compared(left: Column, right: Column, operand: str) -> Column:
    if operand == "IS":
        return left == right
    if operand == "IS_NOT":
        return ~F.coalesce(left == right, F.lit(False))
    if operand in ("GREATER_THAN_OR_EQUAL", "LESS_THAN_OR_EQUAL"):
        return left >= right if operand == "GREATER_THAN_OR_EQUAL" else left <= right
    if operand in ("IS_BEFORE", "IS_AFTER"):
        return left < right if operand == "IS_BEFORE" else left > right
    raise FilterError(f"{operand} isn't for steps")


def first_branch(branches: list[tuple[str, Column]], otherwise: str | None = None) -> Column:
    """The name of the first branch whose condition holds."""
    return F.coalesce(*(F.when(c, F.lit(n)) for n, c in branches), F.lit(otherwise))
