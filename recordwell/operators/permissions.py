"""Who may do what: roles by actor, rules by object and field, as columns over planned operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rule that an action needs.
NEEDS = {"create": "update", "update": "update", "delete": "delete", "destroy": "destroy", "read": "read"}


def role_of(roles: dict, actor: Column) -> Column:
    """The actor's own role, else that of the first pattern with a final * that fits, else the default; null for none."""
    assigned = roles.get("assignments") or {}
    own = [F.when(actor == a, F.lit(r)) for a, r in assigned.items() if not a.endswith("*")]
    patterns = [F.when(actor.startswith(a[:-1]), F.lit(r)) for a, r in assigned.items() if a.endswith("*")]
    return F.coalesce(*own, *patterns, F.lit(roles.get("default_role")))


def refused(roles: dict, actor: Column, object_name: Column, action: Column, field: Column) -> Column:
    """Why an operation isn't allowed, or null: no-member, action or field.

    A role's rules of an object count, else its rules of *; without a role all is allowed, unless the roles are those of a team.
    """
    named = roles.get("roles") or {}
    role = role_of(roles, actor) if named else F.lit(None).cast("string")
    need = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in NEEDS.items() for x in pair)), action), action)

    def of_object(rules: dict) -> Column:
        may = F.array(*(F.lit(k) for k, v in rules.items() if v is True)).cast("array<string>")
        locked = F.array(*(F.lit(k) for k, v in (rules.get("fields") or {}).items() if v.get("update") is False)).cast("array<string>")
        no_field = action.isin("create", "update") & F.coalesce(F.array_contains(locked, field), F.lit(False))
        return F.when(~F.array_contains(may, need), "action").when(no_field, "field")

    def of_role(rules: dict) -> Column:
        objects = rules.get("objects") or {}
        chosen = reduce(lambda out, item: out.when(object_name == item[0], of_object(item[1])), ((k, v) for k, v in objects.items() if k != "*"), F.when(F.lit(False), F.lit(None).cast("string")))
        return chosen.otherwise(of_object(objects.get("*") or {}))

    judged = F.when(role.isNull(), F.lit("no-member" if roles.get("enforcement") == "team" else None).cast("string"))
    for name, rules in named.items():
        judged = judged.when(role == name, of_role(rules))
    return judged.otherwise(F.lit("action"))


def checked(operations: DataFrame, roles: dict) -> DataFrame:
    """operations (actor, object, action, field) with `refused`: no-member, action, field or null."""
    return operations.withColumn("refused", refused(roles, F.col("actor"), F.col("object"), F.col("action"), F.col("field")))
