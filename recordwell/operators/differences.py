"""What changed within nested values: both sides walked down together, level by level, over all rows at once.

Objects meet by their names and lists by their items: an item that stands on both sides, by its text, is the same one, and moved if its
place differs; those left over meet in their order. Values are compared by what they say, so 1, 1.0 and 10e-1 are equal, and 1 and "1" aren't.
There are as many rounds as the values are deep, and each takes only pairs that may still differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..deploy import kept


def _kind(v: Column, json: Column) -> Column:
    """OBJECT, ARRAY, NUMBER, STRING, BOOLEAN or VOID, null for nothing at all; by how its JSON begins, but for numbers that are written as words."""
    name = F.regexp_extract(F.schema_of_variant(v), "^([A-Z]+)", 1)
    head = F.substring(json, 1, 1)
    word = F.when(name.isin("DOUBLE", "FLOAT"), "NUMBER").otherwise("STRING")
    kind = F.when(head == "{", "OBJECT").when(head == "[", "ARRAY").when(json.isin('"Infinity"', '"-Infinity"', '"NaN"'), word).when(head == '"', "STRING").when(head.isin("t", "f"), "BOOLEAN").when(head == "n", "VOID")
    return kind.when(json.isNotNull(), "NUMBER")


def _said(v: Column, json: Column, kind: Column) -> Column:
    """A value as text that is equal for equal values: numbers without exponents or needless zeros, all else as JSON."""
    exact = F.regexp_replace(F.regexp_replace(F.try_variant_get(v, "$", "decimal(38,18)").cast("string"), r"^-?0E.*$", "0"), r"(\.\d*?)0+$", "$1")
    number = F.coalesce(F.regexp_replace(exact, r"\.$", ""), F.try_variant_get(v, "$", "double").cast("string"))
    return F.when((kind == "NUMBER") & ~json.rlike(r"^(?:0|-?[1-9]\d{0,17})$"), number).otherwise(json)


def differences(df: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """(key, path, op, old, new) of two columns of JSON text: op is added, removed, changed or moved; values as JSON.

    A path has a point before a name and an item's new place in brackets, or `[was 1]` for one that is gone; the whole value's is empty.
    Of what moved, old and new are places. A null is no value; text that isn't JSON is a string.
    """
    spark = df.sparkSession
    text = lambda c: F.coalesce(F.try_parse_json(F.col(c)), F.when(F.col(c).isNotNull(), F.variant_get(F.parse_json(F.to_json(F.struct(F.col(c).alias("t")))), "$.t", "variant")))
    # Most pairs have the same JSON, and go no further. A filter that names a column that isn't deterministic stays above what is made once.
    made = {"o_json": F.to_json("o"), "n_json": F.to_json("n"), "here": F.monotonically_increasing_id()}
    differing = lambda pairs: pairs.withColumns(made).where("here >= 0 and not (o_json <=> n_json)").drop("here")
    now = kept(differing(df.select(F.col(key).alias("d_key"), F.lit("").alias("path"), text(before).alias("o"), text(after).alias("n"))), "pairs")
    out: list[DataFrame] = []
    turn = 0
    while True:
        told = now.withColumns({f"{c}_kind": _kind(F.col(c), F.col(f"{c}_json")) for c in "on"})
        told = told.withColumns({f"{c}_said": _said(F.col(c), F.col(f"{c}_json"), F.col(f"{c}_kind")) for c in "on"})
        now = kept(told, f"pairs-{turn}").where("not (o_said <=> n_said) or not (o_kind <=> n_kind)")  # written first: each is said once
        if now.isEmpty():
            break
        both = lambda kind: (F.col("o_kind") == kind) & (F.col("n_kind") == kind)
        deep = F.coalesce(both("OBJECT") | both("ARRAY"), F.lit(False))
        op = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("changed")
        out.append(now.where(~deep).select("d_key", "path", op.alias("op"), F.col("o_json").alias("old"), F.col("n_json").alias("new")))

        def side(kind: str, c: str, now: DataFrame = now, both=both) -> DataFrame:
            rows = now.where(both(kind)).select("d_key", "path", F.col(c).alias("v"))
            each = rows.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
            return each.select("d_key", "path", F.col("pos").cast("long").alias("pos"), F.col("key").alias("name"), F.col("value").alias("v"), F.lit(c).alias("side"))

        of = lambda c: F.first(F.when(F.col("side") == c, F.col("v")), ignorenulls=True).alias(c)
        named = side("OBJECT", "o").unionByName(side("OBJECT", "n")).groupBy("d_key", "path", "name").agg(of("o"), of("n"))
        named = named.select("d_key", F.concat("path", F.lit("."), "name").alias("path"), "o", "n")

        items = side("ARRAY", "o").unionByName(side("ARRAY", "n")).withColumn("text", F.to_json("v"))
        same = Window.partitionBy("d_key", "path", "side", "text").orderBy("pos")
        items = kept(items.withColumn("nth", F.row_number().over(same)).drop("name"), f"items-{turn}")
        place = lambda c: F.max(F.when(F.col("side") == c, F.col("pos"))).alias(f"{c}_at")
        met = items.groupBy("d_key", "path", "text", "nth").agg(place("o"), place("n"))
        stayed = met.where("o_at is not null and n_at is not null")
        moved = stayed.where("o_at <> n_at")
        at = lambda c: F.concat(F.lit("["), F.col(c).cast("string"), F.lit("]"))
        out.append(moved.select("d_key", F.concat("path", at("n_at")).alias("path"), F.lit("moved").alias("op"), at("o_at").alias("old"), at("n_at").alias("new")))
        rest = items.join(stayed.select("d_key", "path", "text", "nth"), ["d_key", "path", "text", "nth"], "left_anti")
        order = Window.partitionBy("d_key", "path", "side").orderBy("pos")
        paired = rest.withColumn("k", F.row_number().over(order)).groupBy("d_key", "path", "k").agg(of("o"), of("n"), place("o"), place("n"))
        listed = paired.select("d_key", F.concat("path", F.coalesce(at("n_at"), F.concat(F.lit("[was "), F.col("o_at").cast("string"), F.lit("]")))).alias("path"), "o", "n")
        now = kept(differing(named.unionByName(listed)), f"next-{turn}")
        turn += 1
    none = df.limit(0).select(F.col(key).alias("d_key"), F.lit("").alias("path"), F.lit("").alias("op"), F.lit("").alias("old"), F.lit("").alias("new"))
    for frame in out:
        none = none.unionByName(frame)
    return none.withColumnRenamed("d_key", key)


def difference_maps(found: DataFrame, key: str) -> DataFrame:
    """(key, diff): the differences of a row as one map of path to op, old and new, in path order."""
    entry = F.struct("path", F.struct("op", "old", "new").alias("v"))
    return found.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("diff"))
