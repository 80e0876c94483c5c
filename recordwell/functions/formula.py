"""Formulas over a row, compiled to columns: arithmetic on exact decimals, comparisons, conditions, text and date functions.

The text is read by Python's own expression parser and every node must be on the list below; nothing is ever executed.
"""

from __future__ import annotations

import ast
import operator
from collections.abc import Callable
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..context import Context

#: Limits of a formula.
MOST_CHARACTERS, MOST_NODES, MOST_DEPTH = 2000, 400, 40
EXACT = "decimal(38,12)"


#: Numbers of up to nine digits before the point keep twelve places, so products and quotients come to 17 or more; longer ones come to six.
FINE, WIDE = "decimal(21,12)", "decimal(28,8)"


def _finest(x: Column, y: Column, operation) -> Column:
    """A product or quotient with the most places that its operands leave room for, rounded to those of numbers."""
    fine = operation(x.try_cast(FINE), y.try_cast(FINE)).cast(EXACT)
    return F.coalesce(fine, operation(x.cast(WIDE), y.cast(WIDE)).cast(EXACT))


def _power(x: Column, y: Column, exponent: ast.AST) -> Column:
    """A written whole exponent up to 10 is multiplied out, any other one goes by floating point."""
    if isinstance(exponent, ast.Constant) and type(exponent.value) is int and 1 <= exponent.value <= 10:
        return reduce(lambda a, b: _finest(a, b, operator.mul), [x] * exponent.value)
    return F.pow(x.cast("double"), y.cast("double"))


class FormulaError(ValueError):
    """A formula isn't valid, or its types don't fit."""


class Typed:
    """A column with its type: number, text, bool, date, instant, list or null."""

    def __init__(self, column: Column, kind: str):
        self.column, self.kind = column, kind


_KINDS = {"string": "text", "boolean": "bool", "date": "date", "timestamp": "instant", "timestamp_ntz": "instant"}


def kind_of(data_type: str) -> str:
    if data_type.startswith(("decimal", "int", "bigint", "double", "float", "smallint", "tinyint", "long")):
        return "number"
    return "list" if data_type.startswith("array") else _KINDS.get(data_type, "text")


def compile_formula(text: str, types: dict[str, str], context: Context) -> Column:
    """The column of a formula. types: field name to Spark type name, as DataFrame.dtypes gives."""
    return compile_typed(text, {k: Typed(F.col(k), kind_of(t)) for k, t in types.items()}, context).column


def compile_typed(text: str, names: dict[str, Typed], context: Context) -> Typed:
    if len(text) > MOST_CHARACTERS:
        raise FormulaError(f"a formula has up to {MOST_CHARACTERS} characters")
    try:
        tree = ast.parse(text.strip(), mode="eval")
    except (SyntaxError, ValueError, RecursionError) as e:
        raise FormulaError(f"not a formula: {e}") from e
    if sum(1 for _ in ast.walk(tree)) > MOST_NODES or _depth(tree) > MOST_DEPTH:
        raise FormulaError("a formula this large isn't allowed")
    return _Compiler(names, context).visit(tree.body)


def compile_many(formulas: dict[str, str], types: dict[str, str], context: Context) -> dict[str, Column]:
    """Several formulas; later ones may read earlier ones by name."""
    names = {k: Typed(F.col(k), kind_of(t)) for k, t in types.items()}
    out = {}
    for name, text in formulas.items():
        names[name] = compile_typed(text, names, context)
        out[name] = names[name].column
    return out


def _depth(node: ast.AST) -> int:
    return 1 + max((_depth(c) for c in ast.iter_child_nodes(node)), default=0)


class _Compiler(ast.NodeVisitor):
    def __init__(self, names: dict[str, Typed], context: Context):
        self.names, self.context = names, context

    def generic_visit(self, node: ast.AST) -> Typed:
        raise FormulaError(f"{type(node).__name__} isn't allowed in a formula")

    def visit_Constant(self, node: ast.Constant) -> Typed:
        v = node.value
        if v is None:
            return Typed(F.lit(None), "null")
        if isinstance(v, bool):
            return Typed(F.lit(v), "bool")
        if isinstance(v, int | float):
            return Typed(F.lit(Decimal(str(v))).cast(EXACT), "number")
        if isinstance(v, str):
            return Typed(F.lit(v), "text")
        raise FormulaError("only numbers, texts and true or false are values")

    def visit_Name(self, node: ast.Name) -> Typed:
        plain = {"true": True, "false": False, "null": None}
        if node.id in plain:
            return self.visit_Constant(ast.Constant(plain[node.id]))
        if node.id not in self.names:
            raise FormulaError(f"unknown name {node.id}")
        found = self.names[node.id]
        return Typed(found.column.cast(EXACT), "number") if found.kind == "number" else found

    def visit_List(self, node: ast.List) -> Typed:
        return Typed(F.array(*(self.visit(e).column for e in node.elts)), "list")

    def visit_BinOp(self, node: ast.BinOp) -> Typed:
        a, b = self.visit(node.left), self.visit(node.right)
        op = type(node.op)
        if op is ast.Add and a.kind == b.kind == "text":
            return Typed(F.concat(a.column, b.column), "text")
        self._need(a, "number"), self._need(b, "number")
        x, y = a.column, b.column
        zero = F.when(y == 0, F.raise_error(F.lit("division by zero")).cast(EXACT)).otherwise(y)
        made = {
            ast.Add: lambda: x + y, ast.Sub: lambda: x - y, ast.Mult: lambda: _finest(x, y, operator.mul), ast.Div: lambda: _finest(x, zero, operator.truediv),
            ast.FloorDiv: lambda: F.floor(_finest(x, zero, operator.truediv)), ast.Mod: lambda: F.pmod(x, zero), ast.Pow: lambda: _power(x, y, node.right),
        }.get(op)
        if made is None:
            raise FormulaError(f"{op.__name__} isn't allowed in a formula")
        return Typed(made().cast(EXACT), "number")

    def visit_UnaryOp(self, node: ast.UnaryOp) -> Typed:
        v = self.visit(node.operand)
        if isinstance(node.op, ast.Not):
            return Typed(~self._truth(v), "bool")
        self._need(v, "number")
        return Typed(-v.column if isinstance(node.op, ast.USub) else v.column, "number")

    def visit_BoolOp(self, node: ast.BoolOp) -> Typed:
        """The operand that decides, as in the formula language; truth values where kinds differ."""
        parts = [self.visit(v) for v in node.values]
        kinds = {p.kind for p in parts} - {"null"}
        if len(kinds) > 1:
            parts = [Typed(self._truth(p), "bool") for p in parts]
        last = parts[-1]
        for p in reversed(parts[:-1]):
            truth = self._truth(p)
            last = Typed(F.when(truth, last.column).otherwise(p.column) if isinstance(node.op, ast.And) else F.when(truth, p.column).otherwise(last.column), p.kind if p.kind != "null" else last.kind)
        return last

    def visit_Compare(self, node: ast.Compare) -> Typed:
        left, parts = self.visit(node.left), []
        for op, right_node in zip(node.ops, node.comparators, strict=True):
            right = self.visit(right_node)
            parts.append(self._compared(left, op, right))
            left = right
        return Typed(reduce(lambda a, b: a & b, parts), "bool")

    def _compared(self, a: Typed, op: ast.cmpop, b: Typed) -> Column:
        if isinstance(op, ast.In | ast.NotIn):
            inside = F.array_contains(b.column, a.column) if b.kind == "list" else b.column.contains(a.column)
            inside = F.coalesce(inside, F.lit(False))
            return inside if isinstance(op, ast.In) else ~inside
        if isinstance(op, ast.Eq | ast.NotEq):  # only equal types can be equal; null equals null
            same = a.column.eqNullSafe(b.column) if a.kind == b.kind or "null" in (a.kind, b.kind) else F.lit(False)
            return same if isinstance(op, ast.Eq) else ~same
        if a.kind != b.kind:
            raise FormulaError(f"a {a.kind} and a {b.kind} have no order")
        made = {ast.Lt: a.column < b.column, ast.LtE: a.column <= b.column, ast.Gt: a.column > b.column, ast.GtE: a.column >= b.column}.get(type(op))
        if made is None:
            raise FormulaError("this comparison isn't allowed in a formula")
        return made

    def visit_IfExp(self, node: ast.IfExp) -> Typed:
        return self._choose(self.visit(node.test), self.visit(node.body), self.visit(node.orelse))

    def _choose(self, test: Typed, yes: Typed, no: Typed) -> Typed:
        if yes.kind != no.kind and "null" not in (yes.kind, no.kind):
            raise FormulaError("both results need one type")
        return Typed(F.when(self._truth(test), yes.column).otherwise(no.column), no.kind if yes.kind == "null" else yes.kind)

    def visit_Subscript(self, node: ast.Subscript) -> Typed:
        v = self.visit(node.value)
        if isinstance(node.slice, ast.Slice):
            raise FormulaError("slices aren't allowed in a compiled formula")
        k = self.visit(node.slice).column.cast("int")
        if v.kind == "list":
            return Typed(F.get(v.column, F.when(k < 0, F.size(v.column) + k).otherwise(k)), "text")
        return Typed(F.substring(v.column, F.when(k < 0, k).otherwise(k + 1), F.lit(1)), "text")

    def visit_Call(self, node: ast.Call) -> Typed:
        if not isinstance(node.func, ast.Name) or node.keywords:
            raise FormulaError("only plain function calls are allowed")
        name = node.func.id
        if name not in _CALLS:
            raise FormulaError(f"unknown function {name}")
        low, high, build = _CALLS[name]
        if not low <= len(node.args) <= high:
            raise FormulaError(f"{name} takes {low} to {high} values")
        return build(self, [self.visit(a) for a in node.args])

    @staticmethod
    def _need(v: Typed, kind: str) -> None:
        if v.kind not in (kind, "null"):
            raise FormulaError(f"a {v.kind} where a {kind} is needed")

    @staticmethod
    def _truth(v: Typed) -> Column:
        if v.kind == "bool":
            held = v.column
        elif v.kind == "number":
            held = v.column != 0
        elif v.kind == "text":
            held = v.column != ""
        elif v.kind == "list":
            held = F.size(v.column) > 0
        else:
            held = v.column.isNotNull()
        return F.coalesce(held, F.lit(False))


def as_text(v: Typed) -> Column:
    """Text of a value: numbers without trailing zeros, null as nothing."""
    if v.kind == "number":
        text = F.regexp_replace(v.column.cast("string"), r"(\.\d*?)0+$", "$1")
        return F.coalesce(F.regexp_replace(text, r"\.$", ""), F.lit(""))
    return F.coalesce(v.column.cast("string"), F.lit(""))


def _round(c: _Compiler, a: list[Typed]) -> Typed:
    c._need(a[0], "number")
    return Typed(F.round(a[0].column, a[1].column.cast("int") if len(a) > 1 else F.lit(0)).cast(EXACT), "number")


def _extreme(pick: Callable, over: Callable) -> Callable:
    def build(c: _Compiler, a: list[Typed]) -> Typed:
        if len(a) == 1 and a[0].kind == "list":
            return Typed(over(a[0].column), "number")
        return Typed(pick(*(x.column for x in a)) if len(a) > 1 else a[0].column, a[0].kind)

    return build


def _text(f: Callable) -> Callable:
    return lambda c, a: Typed(f(as_text(a[0])), "text")


def _coalesce(c: _Compiler, a: list[Typed]) -> Typed:
    kind = next((x.kind for x in a if x.kind != "null"), "null")
    return Typed(F.coalesce(*(F.nullif(x.column, F.lit("")) if x.kind == "text" else x.column for x in a)), kind)


def _add_days(c: _Compiler, a: list[Typed]) -> Typed:
    days = a[1].column.cast("int")
    if a[0].kind == "instant":
        return Typed((a[0].column.cast("timestamp") + F.make_interval(days=days)), "instant")
    return Typed(F.date_add(a[0].column.cast("date"), days), "date")


def _number(c: _Compiler, a: list[Typed]) -> Typed:
    v = a[0]
    if v.kind == "bool":
        return Typed(F.when(v.column, 1).otherwise(0).cast(EXACT), "number")
    if v.kind == "number":
        return v
    text = F.nullif(F.trim(v.column.cast("string")), F.lit(""))
    read = text.try_cast(EXACT)
    return Typed(F.when(text.isNotNull() & read.isNull(), F.raise_error(F.concat(F.lit("not a number: "), text)).cast(EXACT)).otherwise(read), "number")


def _len(c: _Compiler, a: list[Typed]) -> Typed:
    return Typed(F.coalesce(F.size(a[0].column) if a[0].kind == "list" else F.length(as_text(a[0])), F.lit(0)).cast(EXACT), "number")


def _sum(c: _Compiler, a: list[Typed]) -> Typed:
    if len(a) == 1 and a[0].kind == "list":
        return Typed(F.aggregate(a[0].column, F.lit(0).cast(EXACT), lambda s, x: (s + F.coalesce(x.try_cast(EXACT), F.lit(0).cast(EXACT))).cast(EXACT)), "number")
    return Typed(reduce(lambda x, y: (x + y).cast(EXACT), (F.coalesce(x.column, F.lit(0).cast(EXACT)) for x in a)), "number")


def _contains(c: _Compiler, a: list[Typed]) -> Typed:
    hit = F.array_contains(a[0].column, a[1].column) if a[0].kind == "list" else as_text(a[0]).contains(as_text(a[1]))
    return Typed(F.coalesce(hit, F.lit(False)), "bool")


def _literal(text: Column) -> Column:
    return F.concat(F.lit("\\Q"), text, F.lit("\\E"))


def _get(c: _Compiler, a: list[Typed]) -> Typed:
    found = F.call_function("get_json_object", a[0].column, F.concat(F.lit("$."), a[1].column))
    return Typed(F.coalesce(found, a[2].column.cast("string")) if len(a) > 2 else found, "text")


def _find(c: _Compiler, a: list[Typed]) -> Typed:
    """The first object of a JSON list whose key has the value, as JSON."""
    objects = F.from_json(a[0].column, "array<map<string,string>>")
    return Typed(F.to_json(F.get(F.filter(objects, lambda m: F.try_element_at(m, a[1].column) == as_text(a[2])), F.lit(0))), "text")


_CALLS: dict[str, tuple[int, int, Callable]] = {
    "round": (1, 2, _round),
    "abs": (1, 1, lambda c, a: Typed(F.abs(a[0].column), "number")),
    "min": (1, 50, _extreme(F.least, F.array_min)),
    "max": (1, 50, _extreme(F.greatest, F.array_max)),
    "len": (1, 1, _len),
    "lower": (1, 1, _text(F.lower)),
    "upper": (1, 1, _text(F.upper)),
    "trim": (1, 1, _text(F.trim)),
    "concat": (0, 50, lambda c, a: Typed(F.concat(F.lit(""), *map(as_text, a)), "text")),
    "if_": (2, 3, lambda c, a: c._choose(a[0], a[1], a[2] if len(a) > 2 else Typed(F.lit(None), "null"))),
    "coalesce": (1, 50, _coalesce),
    "date_add_days": (2, 2, _add_days),
    "days_between": (2, 2, lambda c, a: Typed(F.datediff(a[1].column.cast("date"), a[0].column.cast("date")).cast(EXACT), "number")),
    "today": (0, 0, lambda c, a: Typed(F.to_date(c.context.now_column()), "date")),
    "now": (0, 0, lambda c, a: Typed(c.context.now_column(), "instant")),
    "number": (1, 1, _number),
    "text": (1, 1, lambda c, a: Typed(as_text(a[0]), "text")),
    "contains": (2, 2, _contains),
    "get": (2, 3, _get),
    "find": (3, 3, _find),
    "split": (1, 2, lambda c, a: Typed(F.split(as_text(a[0]), _literal(as_text(a[1])) if len(a) > 1 else F.lit(r"\s+")), "list")),
    "join": (1, 2, lambda c, a: Typed(F.array_join(a[0].column.cast("array<string>"), "") if len(a) == 1 else F.aggregate(a[0].column.cast("array<string>"), F.lit(None).cast("string"), lambda s, x: F.when(s.isNull(), x).otherwise(F.concat(s, as_text(a[1]), x))), "text")),
    "parse_json": (1, 1, lambda c, a: Typed(F.to_json(F.parse_json(a[0].column)), "text")),
    "floor": (1, 1, lambda c, a: Typed(F.floor(a[0].column).cast(EXACT), "number")),
    "ceil": (1, 1, lambda c, a: Typed(F.ceil(a[0].column).cast(EXACT), "number")),
    "sum": (1, 50, _sum),
}
