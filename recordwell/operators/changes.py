"""Writes as transforms: create, update, upsert, delete, restore, merge, erase; each with its change log rows.

A table of records goes in, the next version comes out. A change row is (crm_id, op, changes map of field to old and
new, as text); updates that change nothing leave none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..deploy import kept
from .importing import unique_key

CHANGES = "map<string,struct<old:string,new:string>>"


def change_map(fields: list[str], old: str, new: str) -> Column:
    """The fields whose values differ, with both values as text."""
    text = lambda c: c.cast("string")
    all_ = F.map_from_entries(F.array(*(F.struct(F.lit(f), F.struct(text(F.col(f"{old}.{f}")).alias("old"), text(F.col(f"{new}.{f}")).alias("new"))) for f in fields)))
    return F.map_filter(all_, lambda _, v: ~v.old.eqNullSafe(v.new))


def upsert(records: DataFrame, rows: DataFrame, key: str, fields: list[str], stamp: Column, clear: bool = False, order: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(next version, changes). rows has key and some of fields; a null leaves a value alone unless clear. Records in the trash come back.

    Rows of one key count as one: of each field the last value by `order` (by the row's values without one) that isn't null, or with
    clear the last row. A row without a key is refused with an error.
    """
    given = [f for f in fields if f in rows.columns]
    place = order if order is not None else F.struct(*(F.col(f) for f in given)) if given else F.lit(0)
    placed = rows.select(F.when(F.col(key).isNull(), F.raise_error(F.lit("a row without a key can't be written")).cast(rows.schema[key].dataType)).otherwise(F.col(key)).alias(key), *given, place.alias("u_place"))
    last = (lambda f: F.max_by(F.struct(f), F.struct(F.col("u_place"), F.col(f)))[f]) if clear else (lambda f: F.max_by(f, F.when(F.col(f).isNotNull(), F.struct(F.col("u_place"), F.col(f)))))
    rows = placed.groupBy(key).agg(*([last(f).alias(f) for f in given] or [F.count(F.lit(1)).alias("u_n")]))
    old, new = records.select(F.col(key).alias("k_old"), F.struct("*").alias("o")), rows.select(F.col(key).alias("k_new"), F.struct("*").alias("n"))
    both = old.join(new, F.col("k_old") == F.col("k_new"), "full")
    kept = lambda f: F.col(f"o.{f}") if f not in given else (F.when(F.col("k_new").isNotNull(), F.col(f"n.{f}")).otherwise(F.col(f"o.{f}")) if clear else F.coalesce(F.col(f"n.{f}"), F.col(f"o.{f}")))
    merged = both.withColumn("next", F.struct(*(kept(f).alias(f) for f in fields)))
    changed = merged.withColumn("changes", change_map(fields, "o", "next"))
    op = F.when(F.col("k_old").isNull(), "create").when(F.col("k_new").isNotNull() & F.col("o.crm_deleted_at").isNotNull(), "restore").when(F.col("k_new").isNotNull() & (F.size("changes") > 0), "update")
    staged = changed.withColumn("op", op)
    touched = F.col("op").isNotNull()
    versions = staged.select(
        F.coalesce("k_old", "k_new").alias(key), *(F.col(f"next.{f}").alias(f) for f in fields),
        F.when(touched & (F.col("op") != "update"), F.lit(None)).otherwise(F.col("o.crm_deleted_at")).cast("timestamp").alias("crm_deleted_at"),
        F.when(touched, stamp).otherwise(F.col("o.crm_updated_at")).alias("crm_updated_at"),
    )
    return versions, staged.where(touched).select(F.coalesce("k_old", "k_new").alias(key), "op", "changes")


def delete(records: DataFrame, wanted: Column, stamp: Column) -> DataFrame:
    """Live records that are wanted go to the trash."""
    gone = F.coalesce(wanted, F.lit(False)) & F.col("crm_deleted_at").isNull()
    return records.withColumns({"crm_updated_at": F.when(gone, stamp).otherwise(F.col("crm_updated_at")), "crm_deleted_at": F.when(gone, stamp).otherwise(F.col("crm_deleted_at"))})


def restore(records: DataFrame, wanted: Column, stamp: Column) -> DataFrame:
    back = F.coalesce(wanted, F.lit(False)) & F.col("crm_deleted_at").isNotNull()
    return records.withColumns({"crm_updated_at": F.when(back, stamp).otherwise(F.col("crm_updated_at")), "crm_deleted_at": F.when(back, F.lit(None).cast("timestamp")).otherwise(F.col("crm_deleted_at"))})


def cleared_links(records: DataFrame, link: str, gone: DataFrame, gone_key: str) -> DataFrame:
    """A link to a destroyed record becomes null."""
    g = gone.select(F.col(gone_key).alias("g_key")).distinct()
    joined = records.join(g, F.col(link) == F.col("g_key"), "left")
    return joined.withColumn(link, F.when(F.col("g_key").isNull(), F.col(link))).drop("g_key")


def merge(records: DataFrame, groups: DataFrame, key: str, fields: list[str], lists: list[str] = (), most: int = 9, texts: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(records after merging, id map (old, new)). groups: (group_id, key, rank[, wins]), rank 1 survives; empty fields are filled in rank
    order, lists united, and texts joined, each different one once. wins, an array, names the fields that a record's own value decides
    before all ranks. A group of more than `most` is refused."""
    sized = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("size"), F.min_by(key, "rank").alias("survivor"))
    known = groups.join(sized, "group_id").withColumn("size", F.when(F.col("size") > most, F.raise_error(F.lit(f"more than {most} records in a merge")).cast("long")).otherwise(F.col("size"))).where("size > 1")
    wins = F.coalesce("wins", F.array().cast("array<string>")) if "wins" in groups.columns else F.array().cast("array<string>")
    members = records.join(known.select(key, "rank", "survivor", wins.alias("m_wins")), key)
    present = lambda f: F.when(F.col(f).isNotNull() & (F.col(f).cast("string") != ""), F.col(f))
    ranked = lambda f: F.array_sort(F.collect_list(F.struct("rank", F.col(f).alias("v"))))  # noqa: E731  # `most` entries
    order = lambda f: F.struct((~F.array_contains("m_wins", F.lit(f))).alias("later"), F.col("rank"))
    aggs = [F.min_by(present(f), F.when(present(f).isNotNull(), order(f))).alias(f) for f in fields]
    aggs += [F.array_join(F.array_distinct(F.filter(F.transform(ranked(f), lambda x: F.trim(x.v)), lambda v: v != "")), "\n\n").alias(f) for f in texts]
    aggs += [F.array_distinct(F.flatten(F.transform(ranked(f), lambda x: F.coalesce(x.v, F.array())))).alias(f) for f in lists]
    merged = members.groupBy(F.col("survivor").alias(key)).agg(*aggs)
    others = records.join(known.select(key), key, "left_anti").select(key, *fields, *texts, *lists)
    return others.unionByName(merged), known.select(F.col(key).alias("old"), F.col("survivor").alias("new")).where("old <> new")


def repointed(links: DataFrame, column: str, id_map: DataFrame) -> DataFrame:
    """Links to merged records point to their survivor."""
    joined = links.join(id_map, F.col(column) == F.col("old"), "left")
    return joined.withColumn(column, F.coalesce("new", column)).drop("old", "new")


#: Identifiers that stand in the plan as a pattern, at most; more of them are a table, for erase_listed.
MOST_IN_PLAN = 500
#: Letters by which a text and an identifier meet.
GRAM = 5
#: Letters of a piece of a text, but for its overlap.
PIECE = 256
#: Beginnings of identifiers up to which they are broadcast.
BROADCAST_BEGINNINGS = 100_000


def erase(df: DataFrame, texts: list[str], identifiers: list[str], mark: str = "[erased]") -> DataFrame:
    """df with every identifier (e-mails, names, numbers) taken out of its text columns, whatever their case."""
    longest = sorted({i for i in identifiers if i}, key=lambda i: (-len(i), i))
    if len(longest) > MOST_IN_PLAN:
        raise ValueError(f"more than {MOST_IN_PLAN} identifiers: give a table of them to erase_listed")
    if not longest:
        return df
    quoted = lambda i: "\\Q" + i.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    pattern = "(?iu)" + "|".join(map(quoted, longest))
    return df.withColumns({t: F.regexp_replace(t, pattern, mark) for t in texts})


def erase_listed(df: DataFrame, key: str, texts: list[str], identifiers: DataFrame, mark: str = "[erased]") -> DataFrame:
    """The same for a table (identifier) of any size; `key` names a row of df.

    Texts meet identifiers in joins. Where a text holds the first GRAM letters of any identifier, the stretches of it that are as long as one of those with
    that beginning are taken, and only a stretch that is an identifier, letter by letter, is found; so beginnings that many identifiers share cost no more than
    their different lengths. A row's own identifiers make its pattern, the longest first. Shorter identifiers go by one pattern of
    them all (there are no more of them than such words: MOST_IN_PLAN, else this is refused).
    """
    listed = identifiers.select(F.lower("identifier").alias("i")).where("i is not null and i <> ''").distinct()
    short = [r.i for r in listed.where(F.length("i") < GRAM).limit(MOST_IN_PLAN + 1).collect()]
    long = kept(listed.where(F.length("i") >= GRAM), "identifiers")
    beginnings = kept(long.groupBy(F.substring("i", 1, GRAM).alias("gram")).agg(F.collect_set(F.length("i")).alias("lengths")), "beginnings")
    if beginnings.limit(BROADCAST_BEGINNINGS + 1).count() <= BROADCAST_BEGINNINGS:
        beginnings = F.broadcast(beginnings)
    # Long texts are cut into overlapping pieces, then into letters: to count from a text's start for each place would cost the square of its length.
    every = df.select(F.col(key).alias("e_key"), F.posexplode(F.array(*(F.lower(F.col(t)) for t in texts))).alias("e_text", "text")).where(F.length("text") >= GRAM)
    pieces = every.select("e_key", "e_text", F.posexplode(F.regexp_extract_all("text", F.lit(rf"(?s)(?=(.{{1,{PIECE + GRAM - 1}}}))(?:.{{{PIECE}}}|.+)"), F.lit(1))).alias("n", "piece")).where(F.length("piece") >= GRAM)
    grams = F.transform(F.sequence(F.lit(1), F.length("piece") - GRAM + 1), lambda k: F.substring("piece", k, F.lit(GRAM)))
    begun = pieces.select("e_key", "e_text", "n", F.posexplode(grams).alias("k", "gram")).join(beginnings, "gram")
    begun = begun.groupBy("e_key", "e_text").agg(F.collect_set(F.struct((F.col("n") * PIECE + F.col("k") + 1).alias("at"), "lengths")).alias("begun"))
    asked = every.join(begun, ["e_key", "e_text"]).withColumn("letters", F.split("text", ""))
    stretches = F.transform("begun", lambda b: F.transform(b.lengths, lambda n: F.when(b.at + n - 1 <= F.size("letters"), F.array_join(F.slice("letters", b.at, n), ""))))
    each = F.flatten(stretches)
    met = asked.select("e_key", F.explode(F.array_distinct(each)).alias("i")).where("i is not null")
    held = met.join(long, "i").groupBy("e_key").agg(F.collect_set("i").alias("i"))
    quoted = F.transform(F.array_sort("i", lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)), lambda i: F.concat(F.lit("\\Q"), F.replace(i, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    pattern = F.concat(F.lit("(?iu)"), F.array_join(quoted, "|"))
    joined = df.join(held.select("e_key", pattern.alias("e_pattern")), F.col(key) == F.col("e_key"), "left")
    clean = joined.withColumns({t: F.when(F.col("e_pattern").isNull(), F.col(t)).otherwise(F.regexp_replace(F.col(t), F.col("e_pattern"), F.lit(mark))) for t in texts})
    return erase(clean.select(*(F.col(f"`{c}`") for c in df.columns)), texts, short, mark)


def erase_everywhere(tables: dict[str, DataFrame], gone: DataFrame, ids: dict[str, str], texts: dict[str, list[str]], identifiers: list[str]) -> dict[str, DataFrame]:
    """Every table without the rows of erased records, and without their identifiers in the texts that stay.

    gone: (id); ids: a table's column that names a record, for records, their events and their runs alike; texts: its text
    columns. Tables without an id column keep all their rows.
    """
    once = gone.select(F.col("id").alias("e_id")).distinct()
    kept = {name: df.join(once, F.col(ids[name]) == F.col("e_id"), "left_anti") if name in ids else df for name, df in tables.items()}
    return {name: erase(df, texts.get(name, []), identifiers) for name, df in kept.items()}


def unique_violations(records: DataFrame, key: Column, kind: str = "TEXT") -> DataFrame:
    """(key, n) of normalised keys that several records hold, those in the trash included."""


    return records.groupBy(unique_key(kind, key).alias("key")).agg(F.count(F.lit(1)).alias("n")).where("key is not null and key <> '' and n > 1")


def plan_hash(rows: DataFrame) -> DataFrame:
    """A row's canonical hash: its fields in name order as JSON, SHA-256; nulls are left out."""
    return rows.withColumn("plan_sha256", F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256))


def reverted(changes: DataFrame) -> DataFrame:
    """The changes that undo a transaction's: old and new exchanged, creates become destroys."""
    swapped = F.transform_values("changes", lambda _, v: F.struct(v.new.alias("old"), v.old.alias("new")))
    op = F.when(F.col("op") == "create", "destroy").when(F.col("op") == "delete", "restore").when(F.col("op") == "restore", "delete").otherwise(F.col("op"))
    return changes.withColumns({"changes": swapped, "op": op})


def replayed(base: DataFrame, changes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The latest value of each field after a log of changes (key, at, changes) over base values, all as text.

    Changes of one instant are in the order of the log: by its columns shard and seq, where it has them.
    """
    place = F.struct("at", *(c for c in ("shard", "seq") if c in changes.columns))
    each = changes.select(key, place.alias("place"), F.explode("changes").alias("field", "v"))
    last = each.groupBy(key, "field").agg(F.max_by(F.struct(F.col("v.new").alias("new")), "place").alias("v"))
    wide = last.groupBy(key).agg(*(F.max(F.when(F.col("field") == f, F.struct(F.lit(True).alias("set"), F.col("v.new").alias("new")))).alias(f"c_{f}") for f in fields))
    joined = base.join(wide, key, "full")
    return joined.select(key, *(F.when(F.col(f"c_{f}.set"), F.col(f"c_{f}.new")).otherwise(F.col(f).cast("string")).alias(f) for f in fields))
