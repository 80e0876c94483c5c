"""Connected components of an edge table, by alternating large-star and small-star rounds.

Rows are only joined and aggregated by vertex; no vertex's neighbours are ever gathered. Each
round's edges are written to the shared folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, written

#: Edges up to which a round is written by a few tasks.
SMALL = 1_000_000


def _star(edges: DataFrame, large: bool, size: int) -> DataFrame:
    """Hang each vertex's neighbours on the least of them: the larger ones (large), or the smaller ones and itself.

    size: a bound on the edges, so on the vertices' rows too.
    """
    both = edges.union(edges.select("v", "u")) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # Written first: the join's sides then are plain shuffles, so a hub's rows can be split among tasks.
    least = written(_narrow(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), size), "least")
    joined = both.join(F.broadcast(least) if 2 * size <= BROADCAST_ROWS else least, "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def _narrow(df: DataFrame, size: int) -> DataFrame:
    """Few output tasks for few rows, however many shuffle partitions the session asks for."""
    return df.coalesce(max(8, 2 * df.sparkSession.sparkContext.defaultParallelism)) if size <= SMALL else df


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(vertex, component) of each vertex on an edge (u, v), a long each; component: its least vertex."""
    now = written(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").distinct(), "edges")
    mark = _mark(now)
    for _ in range(most_rounds):
        now = written(_narrow(_star(_star(now, True, mark[0]), False, mark[0]), mark[0]), "edges")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """The edges' number and a sum that depends on each of them."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
