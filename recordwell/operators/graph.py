"""The link graph of pages, and checks of data against rules as queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ObjectType

WIKILINK = r"\[\[([^\]|#]+)(?:#[^\]|]*)?(?:\|[^\]]*)?\]\]"


def link_edges(pages: DataFrame, body: str = "body") -> DataFrame:
    """(source, target) of wikilinks, each once; targets as written, without folder suffix."""
    each = pages.select(F.col("path").alias("source"), F.explode(F.regexp_extract_all(F.col(body), F.lit(WIKILINK), F.lit(1))).alias("target"))
    return each.select("source", F.trim("target").alias("target")).distinct()


def resolved_edges(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """(source, target, resolved): by path, else by path without extension."""
    names = pages.select(F.col("path").alias("r_name"), F.col("path").alias("resolved")).union(pages.select(F.regexp_replace("path", r"\.md$", ""), "path")).groupBy("r_name").agg(F.min("resolved").alias("resolved"))
    return edges.join(names, F.col("target") == F.col("r_name"), "left").select("source", "target", "resolved")


def nodes(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, links_out, links_in)."""
    out = edges.where("resolved is not null").groupBy(F.col("source").alias("path")).agg(F.count(F.lit(1)).alias("links_out"))
    into = edges.where("resolved is not null").groupBy(F.col("resolved").alias("path")).agg(F.count(F.lit(1)).alias("links_in"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return pages.select("path").join(out, "path", "left").join(into, "path", "left").select("path", zero("links_out"), zero("links_in"))


def orphan_pages(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """Pages that no other page links to."""
    linked = edges.where("resolved is not null and resolved <> source").select(F.col("resolved").alias("path")).distinct()
    return pages.select("path").join(linked, "path", "left_anti")


def broken_links(edges: DataFrame) -> DataFrame:
    return edges.where("resolved is null").select("source", "target")


def repeated(df: DataFrame, key: Column, rule: str) -> DataFrame:
    """(rule, subject, n): keys that several rows hold."""
    return df.groupBy(key.cast("string").alias("subject")).agg(F.count(F.lit(1)).alias("n")).where("subject is not null and n > 1").select(F.lit(rule).alias("rule"), "subject", "n")


def duplicate_groups(df: DataFrame, key: Column, id_column: str) -> DataFrame:
    """(first_id, n) of keys that several rows hold."""
    return df.groupBy(key.alias("d_key")).agg(F.min(id_column).alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("d_key")


def unknown_references(df: DataFrame, reference: Column, known: DataFrame, key: str, rule: str) -> DataFrame:
    """(rule, subject, n): references to nothing."""
    refs = df.select(reference.cast("string").alias("subject")).where("subject is not null")
    missing = refs.join(known.select(F.col(key).cast("string").alias("subject")).distinct(), "subject", "left_anti")
    return missing.groupBy("subject").agg(F.count(F.lit(1)).alias("n")).select(F.lit(rule).alias("rule"), "subject", "n")


def against_model(records: DataFrame, of: ObjectType) -> DataFrame:
    """(crm_id, problems): required fields that are empty, options that don't exist, malformed ids and ratings."""
    tests: list[Column] = []
    for f in of.fields.values():
        if f.inverse or f.name not in records.columns:
            continue
        c = F.col(f.name)
        if not f.nullable:
            tests.append(F.when(F.col("crm_deleted_at").isNull() & c.isNull(), F.lit(f"{f.name}: required")))
        if f.type == "SELECT" and f.options:
            tests.append(F.when(c.isNotNull() & ~c.isin(f.values), F.lit(f"{f.name}: no option")))
        if f.type == "MULTI_SELECT" and f.options:
            tests.append(F.when(F.exists(c, lambda x: ~x.isin(f.values)), F.lit(f"{f.name}: no option")))  # noqa: B023
        if f.type == "RATING":
            tests.append(F.when(~c.rlike("^RATING_[1-5]$"), F.lit(f"{f.name}: no rating")))
    found = F.filter(F.array(*tests), lambda x: x.isNotNull()) if tests else F.array().cast("array<string>")
    return records.select("crm_id", found.alias("problems")).where(F.size("problems") > 0)


def event_problems(events: DataFrame) -> DataFrame:
    """(rule, subject, n): events without op or object, and event ids that occur twice."""
    bad = events.where("op is null or object is null or record_id is null").groupBy(F.col("event_id").cast("string").alias("subject")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("event-format").alias("rule"), "subject", "n")
    return bad.unionByName(repeated(events, F.col("event_id"), "duplicate-event"))


def stored_files(files: DataFrame, references: DataFrame) -> DataFrame:
    """(sha256, state): unreferenced or missing; both sides by hash."""
    kept, asked = files.select("sha256").distinct(), references.select("sha256").where("sha256 is not null").distinct()
    return kept.join(asked, "sha256", "left_anti").select("sha256", F.lit("unreferenced").alias("state")).union(asked.join(kept, "sha256", "left_anti").select("sha256", F.lit("missing")))


def stale_outputs(built: DataFrame, wanted: DataFrame) -> DataFrame:
    """(path, state) of outputs by (path, hash): missing, changed, or left over."""
    both = built.select("path", F.col("hash").alias("b")).join(wanted.select("path", F.col("hash").alias("w")), "path", "full")
    return both.select("path", F.when(F.col("b").isNull(), "missing").when(F.col("w").isNull(), "left over").when(F.col("b") != F.col("w"), "changed").alias("state")).where("state is not null")


def findings(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
