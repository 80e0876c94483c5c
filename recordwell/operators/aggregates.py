"""Aggregates over records: twelve functions, group keys, filled options, money by currency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..context import Context
from ..functions.dates import bucket
from ..functions.values import Value, folded, value
from ..schema import ObjectType

#: Functions and their other names.
FUNCTIONS = "COUNT COUNT_UNIQUE_VALUES COUNT_EMPTY COUNT_NOT_EMPTY COUNT_TRUE COUNT_FALSE PERCENTAGE_EMPTY PERCENTAGE_NOT_EMPTY SUM AVG MIN MAX".split()
OTHER_NAMES = {"AVERAGE": "AVG", "MINIMUM": "MIN", "MAXIMUM": "MAX", "COUNTUNIQUE": "COUNT_UNIQUE_VALUES"}


class AggregateError(ValueError):
    """An aggregate isn't valid."""


def function_name(text: str) -> str:
    plain = text.replace("_", "").upper()
    for name in FUNCTIONS:
        if name.replace("_", "") == plain:
            return name
    if plain in OTHER_NAMES:
        return OTHER_NAMES[plain]
    raise AggregateError(f"unknown aggregate {text!r}")


def aggregate_column(function: str, v: Value | None) -> Column:
    """One aggregate; sums of nothing are 0, averages and extremes of nothing null. Exact decimals throughout."""
    function = function_name(function)
    if function == "COUNT":
        return F.count(F.lit(1))
    if v is None:
        raise AggregateError(f"{function} needs a field")
    if function == "COUNT_EMPTY":
        return F.count_if(v.empty)
    if function == "COUNT_NOT_EMPTY":
        return F.count_if(~v.empty)
    if function in ("PERCENTAGE_EMPTY", "PERCENTAGE_NOT_EMPTY"):
        hit = v.empty if function == "PERCENTAGE_EMPTY" else ~v.empty
        return F.round((F.count_if(hit).cast("decimal(20,0)") * 100).cast("decimal(24,6)") / F.nullif(F.count(F.lit(1)), F.lit(0)).cast("decimal(20,0)"), 6).cast("decimal(38,6)")
    if function in ("COUNT_TRUE", "COUNT_FALSE"):
        if v.kind != "bool":
            return F.lit(0).cast("long")
        return F.count_if(v.column) if function == "COUNT_TRUE" else F.count_if(~v.column)
    if function == "COUNT_UNIQUE_VALUES":
        if v.kind == "list":
            raise AggregateError("distinct values of a list field are counted by unique_values, over its exploded values")
        return F.countDistinct(F.when(~v.empty, folded(v.column) if v.kind in ("text", "numeric", "rating") else v.column))
    if v.kind in ("date", "instant") and function in ("MIN", "MAX"):
        return F.min(v.column) if function == "MIN" else F.max(v.column)
    number = v.number
    if number is None:
        return F.lit(0).cast("decimal(38,6)") if function == "SUM" else F.lit(None).cast("decimal(38,6)")
    exact = number.cast("decimal(38,10)")  # all places of a NUMBER; a sum past 28 digits before the point is null
    if function == "SUM":
        return F.coalesce(F.sum(exact), F.lit(0)).cast("decimal(38,6)")
    if function == "AVG":
        return F.round(F.sum(exact) / F.nullif(F.count(number), F.lit(0)).cast("decimal(20,0)"), 6).cast("decimal(38,6)")
    return (F.min(number) if function == "MIN" else F.max(number)).cast("decimal(38,6)")


def default_currency(of: ObjectType, key: str | None, workspace: str = "") -> str:
    """The currency of an amount that names none, and of an empty sum: the field's default, else the workspace's; '' for other fields."""
    f = of.resolve(key).field if key else None
    if f is None or f.type != "CURRENCY":
        return ""
    return str((f.default.get("currencyCode") if isinstance(f.default, dict) else None) or workspace or "")


def money_totals(df: DataFrame, of: ObjectType, field: str, workspace: str = "", by: list[Column] | None = None) -> DataFrame:
    """by_currency sums, and a zero in the default currency for each group (`by` columns) without any amount."""
    names = [f"g{k}" for k in range(len(by or []))]
    rows = df.withColumns(dict(zip(names, by or [], strict=True)))
    code = default_currency(of, field, workspace)
    sums = by_currency(rows, of, "SUM", field, code, [F.col(n) for n in names])
    groups = rows.select(*names).distinct() if names else df.sparkSession.range(1).select()
    none = groups.join(sums, names, "left_anti") if names else groups.join(sums.select(F.lit(1).alias("one")).limit(1), how="left_anti")
    zero = none.select(*names, F.lit(code).alias("currency"), F.lit(0).cast("decimal(38,6)").alias("value"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("code_rank"))
    return sums.unionByName(zero)


def distinct_members(groups: DataFrame, by: list[str]) -> DataFrame:
    """(by, crm_id) of records in any group of a widget, each once: combined before the shuffle."""
    return groups.select(*by, "crm_id").distinct()


def unique_values(df: DataFrame, of: ObjectType, key: str, by: list[str]) -> DataFrame:
    """COUNT_UNIQUE_VALUES of a list field by columns, distributed: values are exploded, not gathered."""
    v = value(of, key)
    each = df.select(*by, F.explode_outer(F.array_distinct(F.transform(v.column, folded))).alias("recordwell_one"))
    return each.groupBy(*by).agg(F.countDistinct(F.nullif("recordwell_one", F.lit(""))).alias("unique_values"))


def group_keys(of: ObjectType, key: str, granularity: str = "NONE", context: Context | None = None) -> Column:
    """An array of a record's group keys: several for a list field, '' for no value."""
    v = value(of, key)
    if v.kind in ("date", "instant") and granularity.upper() != "NONE":
        day = v.column if v.kind == "date" or context is None else context.local_day(v.column)
        return F.array(F.coalesce(bucket(day, granularity), F.lit("")))
    if v.kind == "list":
        return F.when(v.empty, F.array(F.lit(""))).otherwise(v.column)
    text = F.lower(v.column.cast("string")) if v.kind == "bool" else v.column.cast("string")
    return F.array(F.coalesce(text, F.lit("")))


def grouped(df: DataFrame, of: ObjectType, function: str, field: str | None, by: str, granularity: str = "NONE", context: Context | None = None, dedupe: bool = False) -> DataFrame:
    """(group_key, value): options without records are listed too; a record with several keys counts in each.

    dedupe: keys that one record repeats count once, as views do.
    """
    keys = group_keys(of, by, granularity, context)
    rows = df.withColumn("group_key", F.explode(F.array_distinct(keys) if dedupe else keys))
    v = value(of, field) if field else None
    if v is not None and v.kind == "list" and function_name(function) == "COUNT_UNIQUE_VALUES":
        out = unique_values(rows, of, field, ["group_key"]).withColumnRenamed("unique_values", "value")
    else:
        out = rows.groupBy("group_key").agg(aggregate_column(function, v).alias("value"))
    options = _options(of, by)
    if not options:
        return out
    listed = df.sparkSession.createDataFrame([(x, k) for k, x in enumerate(options)], "group_key string, position int")
    filled = out.join(F.broadcast(listed), "group_key", "full")  # a few options
    if function_name(function).startswith("COUNT") or function_name(function) == "SUM":
        filled = filled.withColumn("value", F.coalesce("value", F.lit(0).cast(out.schema["value"].dataType)))
    return filled.select("group_key", "value", "position")


def _options(of: ObjectType, key: str) -> list[str]:
    f = of.resolve(key).field
    return f.values if f and f.type in ("SELECT", "MULTI_SELECT") else []


def ordered_groups(out: DataFrame) -> DataFrame:
    """Groups in option order, then by number or folded text; the empty group last."""
    keys = [F.col("position").asc_nulls_last()] if "position" in out.columns else []
    return out.orderBy(F.col("group_key") == "", *keys, F.col("group_key").try_cast("decimal(38,10)").asc_nulls_last(), folded(F.col("group_key")), "group_key")


#: Orders of a chart's groups, and other names for them.
ORDERS = {"value": "value", "value_desc": "value", "value_asc": "value_asc", "label": "label", "label_asc": "label", "label_desc": "label_desc", "position": "position", "position_desc": "position_desc", "field_asc": "label", "field_desc": "label_desc", "field_position_asc": "position", "field_position_desc": "position_desc"}


def chart_order(out: DataFrame, of: ObjectType, by: str, order: str | None = None, granularity: str = "NONE", label: Column | None = None) -> list[Column]:
    """Sort columns for groups (group_key, value, perhaps position): by value, label or place, the group without a key last.

    Options and dates have an order of their own, which labels follow; groups without a value come last by value.
    """
    if order is not None and order not in ORDERS:
        raise AggregateError(f"unknown order {order!r}")
    way = ORDERS[order or "position"]
    key, none = F.col("group_key"), (F.col("group_key") == "").asc()
    natural = [*([F.col("position")] if "position" in out.columns else []), key.try_cast("decimal(38,10)"), folded(key), key]
    if way.startswith("value"):
        value = F.col("value").desc_nulls_last() if way == "value" else F.col("value").asc_nulls_last()
        return [value, none, *(c.asc_nulls_last() for c in natural)]
    meaning = of.resolve(by)
    own_order = bool(_options(of, by)) or (meaning.type in ("DATE", "DATE_TIME") and granularity.upper() != "NONE")
    if way.startswith("label") and not own_order:
        natural = [folded(label if label is not None else key), key]
    return [none, *(c.desc_nulls_first() if way.endswith("_desc") else c.asc_nulls_last() for c in natural)]


def by_currency(df: DataFrame, of: ObjectType, function: str, field: str, default: str, by: list[Column] | None = None) -> DataFrame:
    """Money by currency code; amounts of different codes are never added. The default code comes first (code_rank 0), no code last."""
    money = F.col(of.resolve(field).base)
    code = F.coalesce(F.nullif(money.currencyCode, F.lit("")), F.when(money.amountMicros.isNotNull(), "")).alias("currency")
    rows = df.where(money.amountMicros.isNotNull())
    out = rows.groupBy(*(by or []), code).agg(aggregate_column(function, value(of, field)).alias("value"), F.count(F.lit(1)).alias("n"))
    rank = F.when(F.col("currency") == default, 0).when(F.col("currency") == "", 2).otherwise(1)
    return out.withColumn("code_rank", rank)


def expected(df: DataFrame, of: ObjectType, amount: str, stage: str, shares: dict[str, str]) -> DataFrame:
    """Amounts weighted by their stage's share: (stage, currency, n, amount, expected); n_without_share counts stages without one."""
    money, st = F.col(of.resolve(amount).base), value(of, stage).column
    known = F.create_map(*(x for k, s in shares.items() for x in (F.lit(k), F.lit(s).cast("decimal(9,6)"))))
    share = F.try_element_at(known, st)
    plain = value(of, amount).column.cast("decimal(28,6)")
    rows = df.where(money.amountMicros.isNotNull())
    return rows.groupBy(F.coalesce(st, F.lit("")).alias("stage"), F.coalesce(money.currencyCode, F.lit("")).alias("currency")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(plain).cast("decimal(38,6)").alias("amount"), F.sum((plain * share).cast("decimal(38,6)")).cast("decimal(38,6)").alias("expected"), F.count_if(share.isNull()).alias("n_without_share"),
    )
