"""Verdicts on URLs: host and path rules, else link-graph propagation over host edges.

Rules mark pages; a host's allowed pages are its trust seed, its blocked pages its distrust
seed. Trust flows along links (personalised PageRank); distrust flows against them, to
hosts that link to bad ones. A host without links in the direction of flow keeps its mass.
A host is blocked if its distrust exceeds its trust by more than `threshold` a page.
All of it is DataFrame work; the state has a row a host and kind. A host that very many link
to, or that links to very many, is a hub: its links are dealt among several join keys.

Defined results: a null URL, or one without ://, has an empty host and path and can fit no rule;
pages of an empty host are judged like those of any host. Repeated rows count as often as they
come and get equal verdicts. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, log
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import sized, written

#: Fixed values: (rule, verdict).
RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"""(?i)href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def lowered(text: Column) -> Column:
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def host_of(url: Column) -> Column:
    return lowered(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, else null."""

    def fits(rule: str) -> Column:
        name, _, rest = rule.partition("/")
        return ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")

    longest = sorted((r for r, _ in rules), key=lambda r: (-len(r), r))
    return F.coalesce(*(F.when(fits(r), F.lit(r)) for r in longest)) if longest else F.lit(None).cast("string")


def verdict_of(rule: Column, rules: list[tuple[str, str]]) -> Column:
    return reduce(lambda found, r: F.when(rule == r[0], F.lit(r[1])).otherwise(found), rules, F.lit(None).cast("string"))


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) of links between different hosts."""
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(F.col("html"), F.lit(_LINK), F.lit(1)))).alias("dst"))
    return links.select("src", lowered(F.col("dst")).alias("dst")).where("src <> dst").distinct()


#: Links of one host that one join key holds, about; a hub's are dealt among as many keys as that takes.
HUB = 20_000


def flows(edges: DataFrame, hosts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((kind, src, slot, dst, share): where a unit of trust or distrust goes from src; (kind, src, slots) of hubs, whose links have several slots)."""
    along = edges.select(F.lit("trust").alias("kind"), "src", "dst")
    against = edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"))
    moving = along.unionAll(against)
    counted = moving.groupBy("kind", "src").agg(F.count(F.lit(1)).alias("n"))
    degree = written(counted.select("kind", "src", (1 / F.col("n")).alias("share"), F.ceil(F.col("n") / HUB).alias("slots")), "degrees")
    kinds = hosts.select("host", F.explode(F.array(F.lit("trust"), F.lit("distrust"))).alias("kind"))
    staying = kinds.join(degree.withColumnRenamed("src", "host"), ["kind", "host"], "left_anti")
    dealt = moving.join(sized(degree), ["kind", "src"]).select("kind", "src", F.pmod(F.xxhash64("dst"), F.col("slots")).alias("slot"), "dst", "share")
    stays = staying.select("kind", F.col("host").alias("src"), F.lit(0).cast("long").alias("slot"), F.col("host").alias("dst"), F.lit(1.0).alias("share"))
    return dealt.unionByName(stays), degree.where("slots > 1").select("kind", "src", "slots")


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = 0.85, stretch: int = 5, tolerance: float = 1e-3) -> DataFrame:
    """(host, kind, mass) from seeds (host, kind, mass): every `stretch` rounds the state is written, and done if it holds still.

    Each round shrinks the sum of all shifts by `damping`, though a single host may gather many. So once that sum
    over a stretch is at most `tolerance`, whatever the total mass, no host can shift by more than
    tolerance * damping^stretch / (1 - damping^stretch) any more. The same bound gives the rounds after which it must hold.
    """
    hosts = seeds.select("host").union(edges.select("src")).union(edges.select("dst")).distinct()
    links, hubs = flows(edges, hosts)
    paths, hubs = written(links, "flows"), sized(hubs)
    start = seeds.select("host", "kind", ((1 - damping) * F.col("mass")).alias("mass"))
    total = seeds.agg(F.sum("mass")).first()[0] or 0.0
    rounds = stretch + max(0, ceil(log(max(2 * total, tolerance) / tolerance) / -log(damping)))
    state = seeds
    for _ in range(0, rounds, stretch):
        before = state
        for _ in range(stretch):
            dealt = state.withColumnRenamed("host", "src").join(hubs, ["kind", "src"], "left").withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("slots", F.lit(1).cast("long")) - 1)))
            moved = dealt.join(paths, ["kind", "src", "slot"]).select(F.col("dst").alias("host"), "kind", (damping * F.col("mass") * F.col("share")).alias("mass"))
            state = moved.unionByName(start).groupBy("host", "kind").agg(F.sum("mass").alias("mass"))
        state = written(state, "trust")
        shift = state.join(before.withColumnRenamed("mass", "was"), ["host", "kind"], "full").agg(F.sum(F.abs(F.coalesce("mass", F.lit(0.0)) - F.coalesce("was", F.lit(0.0))))).first()[0] or 0.0
        if shift <= tolerance:
            break
    return state


def judged(pages: DataFrame, rules: list[tuple[str, str]] = RULES, threshold: float = 0.25, damping: float = 0.85) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each page."""
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = parts.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules)).withColumn("ruled", verdict_of(F.col("rule"), rules))
    by_host = written(ruled.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("ruled") == "allow").cast("double").alias("trust"), F.count_if(F.col("ruled") == "block").cast("double").alias("distrust")), "hosts")
    seeds = by_host.select("host", F.explode(F.create_map(F.lit("trust"), F.col("trust"), F.lit("distrust"), F.col("distrust"))).alias("kind", "mass"))
    mass = propagate(seeds, written(host_edges(pages), "host-edges"), damping, tolerance=abs(threshold) / 250 or 1e-3)
    flat = mass.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("mass")).otherwise(-F.col("mass"))).alias("balance"))
    hosts = by_host.join(flat, "host", "left").select("host", F.when(-F.coalesce("balance", F.lit(0.0)) > threshold * F.col("pages"), "block").otherwise("allow").alias("of_host"))
    return ruled.join(sized(hosts), "host", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", "of_host").alias("verdict"))
