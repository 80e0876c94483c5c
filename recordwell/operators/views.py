"""Views and widgets: board columns, calendar days, series for charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..context import Context
from ..functions.dates import gap_filled
from ..functions.values import value
from ..schema import ObjectType
from .aggregates import aggregate_column


def table_footer(df: DataFrame, of: ObjectType, footers: dict[str, str], by: Column | None = None) -> DataFrame:
    """One aggregate a column, for each group and over all (group null)."""
    aggs = [aggregate_column(fn, value(of, key)).alias(f"{key}_{fn}".lower()) for key, fn in footers.items()]
    if by is None:
        return df.agg(*aggs)
    return df.withColumn("footer_group", by).rollup("footer_group").agg(F.grouping("footer_group").alias("is_total"), *aggs)


def board(df: DataFrame, of: ObjectType, by: str, aggregates: dict[str, Column]) -> DataFrame:
    """A row for each option of a SELECT, in option order, then one for records without; cards counted, values aggregated."""
    counted = df.groupBy(F.coalesce(value(of, by).column, F.lit("")).alias("column")).agg(F.count(F.lit(1)).alias("cards"), *(c.alias(k) for k, c in aggregates.items()))
    options = df.sparkSession.createDataFrame([(v, k) for k, v in enumerate([*of.resolve(by).field.values, ""])], "column string, position int")
    joined = F.broadcast(options).join(counted, "column", "left")  # a few options
    return joined.select("position", "column", F.coalesce("cards", F.lit(0)).alias("cards"), *aggregates)


def calendar(df: DataFrame, start: Column, context: Context, keep: list[Column], end: Column | None = None) -> DataFrame:
    """Each record on its local days; a span stands on every day that it touches."""
    first = context.local_day(start)
    if end is None:
        return df.select(*keep, first.alias("day"), F.date_format(context.local(start), "HH:mm").alias("at"))
    return df.select(*keep, F.explode(F.sequence(first, F.greatest(first, context.local_day(end)))).alias("day"))


def top_with_other(groups: DataFrame, key: str, number: str, most: int) -> DataFrame:
    """The groups with the highest numbers; the rest folded into one group 'other' (n_folded groups).

    One pass over the groups: each partition keeps its own best, which one row of an aggregate then ranks, beside totals of
    all; so neither the facts are read twice nor do all groups go to one task.
    """
    own = Window.partitionBy(F.spark_partition_id()).orderBy(F.col(number).desc(), F.col(key))
    near = groups.select(F.col(key).alias("k"), F.col(number).alias("v"), F.row_number().over(own).alias("place"))
    best = F.struct("v", "k")
    # At most `most` rows a partition are gathered; the rest only adds up.
    one = near.agg(F.collect_list(F.when(F.col("place") <= most, best)).alias("b"), F.sum(F.when(F.col("place") > most, F.col("v"))).alias("rest"), F.count_if(F.col("place") > most).alias("n"))
    before = lambda x, y: F.when((x.v > y.v) | ((x.v == y.v) & (x.k < y.k)), -1).when((x.v == y.v) & (x.k == y.k), 0).otherwise(1)
    ranked = one.withColumn("b", F.array_sort("b", before))
    kept = F.transform(F.slice("b", 1, most), lambda x: F.struct(x.k.alias(key), x.v.cast(groups.schema[number].dataType).alias(number), F.lit(0).cast("long").alias("n_folded")))
    beyond = F.slice(F.col("b"), most + 1, F.greatest(F.lit(1), F.size("b")))
    more = F.aggregate(beyond, F.lit(0).cast(groups.schema[number].dataType), lambda a, x: (a + x.v).cast(groups.schema[number].dataType))
    n = F.size(beyond).cast("long") + F.col("n")
    other = F.struct(F.lit("other").alias(key), (more + F.coalesce("rest", F.lit(0))).cast(groups.schema[number].dataType).alias(number), n.alias("n_folded"))
    return ranked.select(F.explode(F.when(n > 0, F.concat(kept, F.array(other))).otherwise(kept)).alias("r")).select("r.*")


def cumulative(groups: DataFrame, key: str, number: str, series: list[str] | None = None) -> DataFrame:
    """Running totals in key order, of each series; over aggregated buckets."""
    w = Window.partitionBy(*(series or [])).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    return groups.withColumn(f"running_{number}", F.sum(number).over(w))


def line(df: DataFrame, day: Column, grain: str, number: Column, name: str = "value") -> DataFrame:
    """A bucket a row, gaps filled with 0."""
    first = F.trunc(day, {"QUARTER": "quarter", "MONTH": "month", "YEAR": "year", "WEEK": "week"}[grain.upper()]) if grain.upper() != "DAY" else day
    buckets = df.where(day.isNotNull()).groupBy(first.cast("date").alias("bucket")).agg(number.alias(name))
    return gap_filled(buckets, "bucket", grain, {name: 0})


def two_level(df: DataFrame, first: Column, second: Column, number: Column, most: int = 8, merge: Column | None = None) -> DataFrame:
    """(first, second, value): second-level groups beyond the largest `most` - 1 fold into 'other', over their records.

    merge: an aggregate over the column `value` that gives a group's number from those of its parts, such as F.sum("value")
    for counts and sums. With it the records are read once: their groups are ranked and folded. Without it (an average, say)
    'other' is made from the records again.
    """
    rows = df.withColumns({"g1": F.coalesce(first, F.lit("")), "g2": F.coalesce(second, F.lit(""))})
    groups = rows.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("n"), number.alias("value"))
    sizes = groups.groupBy("g2").agg(F.sum("n").alias("n"))
    # One row more than may stay tells whether any is folded.
    top = sizes.orderBy(F.col("n").desc(), "g2").limit(most + 1)
    ranked = top.withColumns({"place": F.row_number().over(Window.orderBy(F.col("n").desc(), "g2")), "many": F.count(F.lit(1)).over(Window.partitionBy())})
    kept = F.broadcast(ranked.where((F.col("many") <= most) | (F.col("place") < most)).select("g2", F.lit(True).alias("own")))
    name = F.when(F.col("own"), F.col("g2")).otherwise("other").alias("g2")
    if merge is not None:
        return groups.join(kept, "g2", "left").select("g1", name, "value").groupBy("g1", "g2").agg(merge.alias("value"))
    return rows.join(kept, "g2", "left").select(*(c for c in rows.columns if c != "g2"), name).groupBy("g1", "g2").agg(number.alias("value"))
