"""Links between records as edges: inverses, incoming links, two hops, orphans, cascades."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import Model, ObjectType


def links_of(of: ObjectType, field: str) -> Column:
    """A relation's stored links as an array, whichever side stores one or many."""
    f = of.fields[field]
    return F.coalesce(F.col(field), F.array()) if f.type == "MORPH_RELATION" else F.when(F.col(f"{field}.id").isNotNull(), F.array(F.col(field))).otherwise(F.array())


def edges(model: Model, records: dict[str, DataFrame], include_deleted: bool = False) -> DataFrame:
    """(source_object, field, source_id, target_object, target_id) of all stored links."""
    parts = []
    for name, df in records.items():
        of = model.object(name)
        live = df if include_deleted else df.where("crm_deleted_at is null")
        for f in of.fields.values():
            if f.type in ("RELATION", "MORPH_RELATION") and not f.inverse:
                each = live.select(F.col("crm_id").alias("source_id"), F.explode(links_of(of, f.name)).alias("l"))
                parts.append(each.select(F.lit(name).alias("source_object"), F.lit(f.name).alias("field"), "source_id", F.col("l.object").alias("target_object"), F.col("l.id").alias("target_id")))
    return reduce(DataFrame.unionByName, parts)


def inverse(targets: DataFrame, sources: DataFrame, of: ObjectType, field: str) -> DataFrame:
    """(crm_id, n_sources) of every target: its live sources over a link. No list of them is built."""
    live = sources.where("crm_deleted_at is null").select(F.explode(links_of(of, field)).alias("l"))
    counts = live.groupBy(F.col("l.id").alias("crm_id")).agg(F.count(F.lit(1)).alias("n_sources"))
    return targets.select("crm_id").join(counts, "crm_id", "left").select("crm_id", F.coalesce("n_sources", F.lit(0)).alias("n_sources"))


def with_titles(df: DataFrame, link: str, targets: DataFrame, target: str | None = None) -> DataFrame:
    """df with (title, exists, deleted) of its link's current target in `<link>_now`.

    target: the object that `targets` holds; links to another object, which may use the same ids, don't meet it.
    """
    t = targets.select(F.col("crm_id").alias("t_id"), F.col("crm_title").alias("t_title"), F.col("crm_deleted_at").isNotNull().alias("t_deleted"))
    meets = F.col(f"{link}.id") == F.col("t_id")
    found = df.join(t, meets if target is None else meets & (F.col(f"{link}.object") == target), "left")
    now = F.struct(F.coalesce("t_title", F.col(f"{link}.title")).alias("title"), F.col("t_id").isNotNull().alias("exists"), F.coalesce("t_deleted", F.lit(False)).alias("deleted"))
    return found.withColumn(f"{link}_now", F.when(F.col(f"{link}.id").isNotNull(), now)).drop("t_id", "t_title", "t_deleted")


def expanded(df: DataFrame, links: dict[str, tuple[str, DataFrame]], fields: dict[str, list[str]]) -> DataFrame:
    """df with each link replaced by the linked record: links: link column to (object, its records); fields: the columns of it that
    are shown, in a struct `<link>_record`, null where the link leads nowhere or to the trash."""
    for link, (target, records) in links.items():
        shown = F.struct("crm_id", "crm_title", *fields.get(link, []))
        there = records.where("crm_deleted_at is null").select(F.col("crm_id").alias("x_id"), shown.alias(f"{link}_record"))
        df = df.join(there, (F.col(f"{link}.id") == F.col("x_id")) & (F.col(f"{link}.object") == target), "left").drop("x_id")
    return df


def orphans(df: DataFrame, key: str, targets: DataFrame, target_key: str) -> DataFrame:
    """Rows whose key is set but has no target."""
    return df.where(F.col(key).isNotNull()).join(targets.select(F.col(target_key).alias(key)).distinct(), key, "left_anti")


def two_hops(first: DataFrame, second: DataFrame) -> DataFrame:
    """(a, c) pairs over first (a, b) and second (b, c), each once."""
    return first.select("a", "b").distinct().join(second.select("b", "c").distinct(), "b").select("a", "c").distinct()


def cascade(start: DataFrame, links: DataFrame, policy: dict[tuple[str, str], str]) -> DataFrame:
    """(object, id, action) of what destroying `start` (object, id) touches.

    policy: (source object, field) to CASCADE, SET_NULL or RESTRICT. Cascades are followed until nothing new
    turns up, however deep; records already gone are not visited again. The frontier is checkpointed, not collected.
    """
    rows = [(o, f, p) for (o, f), p in policy.items()]
    rules = F.broadcast(links.sparkSession.createDataFrame(rows, "source_object string, field string, action string"))
    ruled = links.join(rules, ["source_object", "field"], "left").withColumn("action", F.coalesce("action", F.lit("SET_NULL")))
    gone = frontier = start.select("object", "id").distinct()
    while True:
        hit = ruled.where("action = 'CASCADE'").join(frontier.withColumnsRenamed({"object": "target_object", "id": "target_id"}), ["target_object", "target_id"])
        frontier = hit.select(F.col("source_object").alias("object"), F.col("source_id").alias("id")).distinct().join(gone, ["object", "id"], "left_anti").checkpoint()
        if frontier.isEmpty():
            break
        gone = gone.union(frontier).checkpoint()
    touched = ruled.where("action <> 'CASCADE'").join(gone.withColumnsRenamed({"object": "target_object", "id": "target_id"}), ["target_object", "target_id"])
    other = touched.select(F.col("source_object").alias("object"), F.col("source_id").alias("id"), "action").distinct().join(gone, ["object", "id"], "left_anti")
    return gone.withColumn("action", F.lit("DESTROY")).union(other)
