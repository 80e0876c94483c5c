"""A trie over conversations: every distinct beginning is a node, with counts over the conversations that start with it.

Distributed MSD radix partitioning. Turns are dictionary-encoded first: a number for each distinct (role, text). Then a
bucket holds the conversations that agree so far, all of them at first. A bucket of more than LOCAL turns is taken as far as its
members agree, in one aggregate by depth, and split there by the next turn; so copies of a long conversation cost
one round, not one a turn. Smaller buckets are finished within tasks by multikey quicksort on the turns' numbers,
which emits the nodes as it recurses; a bucket of one conversation is a chain, whose nodes are column expressions.
Counts over subtrees go up from there, round by round, by sums per parent.

A node is known by (conv_id, depth), its smallest member's id. No bucket larger than LOCAL turns is gathered. Members that end at a
large bucket's node are hashed from stretches that many tasks join into text; only the digest itself, which is
sequential by nature, is one task a node, in constant memory. Positions within a conversation, too, are counted by
stretches of a global sort, so one conversation may hold any share of the rows.

Defined results: rows with a null conv_id are left out; a null role or text counts as empty; rows of one turn number are ordered by a
digest of role and text (repeated rows stay, as turns of their own). Turns are told apart by 128 bits of SHA-256. An empty
table gives no rows, not even a root. Other columns are ignored. conv_id % 5 has the sign of conv_id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..deploy import ship
from .shared import BROADCAST_ROWS, sized, written

#: Turns up to which a bucket of several conversations is finished by one task.
LOCAL = 4096
#: Bytes of joined ids that are handed on as one row.
STRETCH = 1 << 16
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def running(df: DataFrame, group: list[str], order: list[str], value: str, label: str) -> DataFrame:
    """df with `before`, the sum of `value` over the rows of its group that come before in `order`.

    Two passes over a global sort: sums within each range first, then what earlier ranges hold of a group that goes on
    (two rows a range). So a group may spread over any number of tasks.
    """
    columns = df.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total, opened = None, 0, True
        for batch in batches:
            if not len(batch):
                continue
            keys = [tuple(k) for k in zip(*(batch.column(columns.index(g)).to_pylist() for g in group), strict=True)]
            values = batch.column(columns.index(value)).to_pylist()
            before, begun = [], []
            for key, v in zip(keys, values, strict=True):
                if key != last:
                    opened = last is None
                    last, total = key, 0
                before.append(total)
                begun.append(opened)  # the range's first group may have begun in an earlier one
                total += v
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.int64()), pa.array(begun, pa.bool_())], [*columns, "before", "opened"])

    ranged = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    done = written(ranged.mapInArrow(sums, f"{kinds}, before long, opened boolean").withColumn("part", F.spark_partition_id()), label)
    # What each range holds of its first and of its last group.
    edges = done.groupBy("part").agg(
        F.max(F.struct(*group)).alias("last"), F.min(F.struct(*group)).alias("first"), F.max_by(F.col("before") + F.col(value), F.struct(*group, "before", value)).alias("held")
    )
    carried, open_key, total = [], None, 0
    for r in sorted(edges.collect(), key=lambda r: r.part):  # a row a range
        if tuple(r.first) != open_key:
            open_key, total = None, 0
        if total:
            carried.append((r.part, total))
        total = r.held + (total if tuple(r.last) == open_key else 0)
        open_key = tuple(r.last)
    if not carried:
        return done.select(*columns, "before")
    more = F.broadcast(df.sparkSession.createDataFrame(carried, "part int, carried long"))
    return done.join(more, "part", "left").select(*columns, (F.col("before") + F.when(F.col("opened"), F.coalesce("carried", F.lit(0))).otherwise(0)).alias("before"))


def encoded(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, code, bytes): each turn's place within its conversation, its number, and its text's length in UTF-8."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32))
    turns = written(conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"), F.lit(1).cast("long").alias("one")), "turns")
    dictionary = written(turns.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).select("digest", F.monotonically_increasing_id().alias("code")), "dictionary")
    numbered = turns.join(dictionary, "digest").select("conv_id", "turn", "digest", "code", "bytes", "one")
    return running(numbered, ["conv_id"], ["turn", "digest"], "one", "ordered").select("conv_id", F.col("before").alias("at"), "code", "bytes")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, code, bytes, length) of the rebuilt conversations; depth 0 is a start that all share, of code -1."""
    n = turns.groupBy("conv_id").agg((F.max("at") + 1).alias("n"))
    c = F.col("conv_id")
    heads = n.select(c, "n", (F.crc32(c.cast("string")) % 9).alias("h"), (c - c % 5).alias("base"))
    sizes = n.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    lent = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = written(heads.join(sizes, "base", "left").select("conv_id", "base", "h", lent.alias("lent"), (lent + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "heads")
    first = turns.where("at < 8").select(F.col("conv_id").alias("base"), "at", "code", "bytes").join(convs, "base").where("at < h")  # h < 9; a base has nine readers at most
    own = turns.join(convs, "conv_id").where("at >= h")
    start = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(-1).cast("long").alias("code"), F.lit(0).cast("long").alias("bytes"), "length")
    first = first.select("conv_id", F.col("at") + 1, "code", "bytes", "length")
    own = own.select("conv_id", F.col("lent") + F.col("at") - F.col("h") + 1, "code", "bytes", "length")
    return start.union(first).union(own)


class _Rounds:
    """What the rounds over large buckets leave: tables of the shared folder."""

    def __init__(self):
        self.spines: list[DataFrame] = []  # (rep, top, depth, parent, members, bytes): nodes down to a bucket's last shared turn
        self.forks: list[DataFrame] = []  # (rep, top, fork, parent, members, n_children, weight), a row a large bucket
        self.ended: list[DataFrame] = []  # (rep, depth, conv_id): members that end at a fork
        self.local: list[DataFrame] = []  # (conv_id, rep, top, parent)
        self.chains: list[DataFrame] = []  # the same, of single conversations


def _split(rows: DataFrame, found: _Rounds, turn: int) -> DataFrame | None:
    """One round: rows (conv_id, depth, code, bytes, length, rep, top, parent) of large buckets; returns those that stay large."""
    agreed = rows.groupBy("rep", "top", "parent", "depth").agg(F.min("code").alias("low"), F.max("code").alias("high"), F.count(F.lit(1)).alias("n"), F.max("bytes").alias("bytes"))
    agreed = written(agreed, f"agreed-{turn}")
    size = agreed.where("depth = top").select("rep", F.col("n").alias("members"))  # every member has the turn that the bucket shares
    alike = (F.col("low") == F.col("high")) & (F.col("n") == F.col("members"))
    marked = agreed.join(size, "rep").withColumn("alike", alike)
    fork = F.coalesce(F.min(F.when(~F.col("alike"), F.col("depth"))), F.max("depth") + 1) - 1
    forks = written(marked.groupBy("rep", "top", "parent", "members").agg(fork.alias("fork")), f"forks-{turn}")
    known = sized(forks.select("rep", "fork", "members"))
    spine = agreed.join(known, "rep").where("depth <= fork").select("rep", "top", "depth", "parent", "members", "bytes")
    found.spines.append(spine)
    at_fork = rows.join(known, "rep")
    found.ended.append(written(at_fork.where("depth = fork and length = fork").select("rep", F.col("fork").alias("depth"), "conv_id"), f"ended-{turn}"))
    steps = written(at_fork.where("depth = fork + 1").select("rep", "fork", "code", "conv_id", "length"), f"steps-{turn}")
    children = written(steps.groupBy("rep", "fork", "code").agg(F.min("conv_id").alias("child"), F.count(F.lit(1)).alias("n"), F.sum(F.col("length") - F.col("fork")).alias("turns")), f"children-{turn}")
    weight = spine.groupBy("rep").agg(F.sum((F.col("members") - 1) * F.col("bytes")).alias("weight"))
    kids = children.groupBy("rep").agg(F.count(F.lit(1)).alias("n_children"))
    full = forks.join(weight, "rep", "left").join(kids, "rep", "left")
    found.forks.append(written(full.select("rep", "top", "fork", "parent", "members", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("weight", F.lit(0)).alias("weight")), f"large-{turn}"))
    moved = written(steps.join(children, ["rep", "fork", "code"]).select("conv_id", F.col("child").alias("rep"), (F.col("fork") + 1).alias("top"), F.col("rep").alias("parent"), "n", "turns"), f"moved-{turn}")
    place = moved.select("conv_id", "rep", "top", "parent", "n", "turns")
    found.chains.append(place.where("n = 1").drop("n", "turns"))
    found.local.append(place.where("n > 1 and turns <= %d" % LOCAL).drop("n", "turns"))
    large = place.where("n > 1 and turns > %d" % LOCAL).drop("n", "turns")
    if large.isEmpty():
        return None
    rest = rows.drop("rep", "top", "parent").join(sized(large, BROADCAST_ROWS), "conv_id").where("depth >= top")
    return written(rest, f"rest-{turn}")


def _emit(codes: list[list[int]], sizes: list[list[int]], ids: list[int], parent: int, top: int) -> list[tuple]:
    """The nodes of one bucket: conversations that share their first turn here, at depth `top`; codes and sizes from there on.

    Multikey quicksort: a range of conversations that agree up to some depth is split in three by the next turn of a pivot, and
    the middle part, which agrees on it, is a node and goes on one turn deeper. Nodes are (conv_id, depth, parent_conv_id,
    n_convs, n_children, own saving, ended members, parent's place).
    """
    nodes: list[list] = []
    order = list(range(len(ids)))
    ends = [len(c) for c in codes]

    def node(low: int, high: int, depth: int, above: int) -> int:
        inside = order[low:high]
        least = min(ids[k] for k in inside)
        nodes.append([least, top + depth, parent if above < 0 else nodes[above][0], high - low, 0, (high - low - 1) * sizes[inside[0]][depth], [ids[k] for k in inside if ends[k] == depth + 1], above])
        if above >= 0:
            nodes[above][4] += 1
        return len(nodes) - 1

    todo = [(0, len(order), 0, node(0, len(order), 0, -1))]  # ranges that agree up to depth and stand below a node
    while todo:
        low, high, depth, above = todo.pop()
        if high - low == 1:  # a chain
            k = order[low]
            for d in range(depth + 1, ends[k]):
                above = node(low, high, d, above)
            continue
        todo.extend((a, b, depth + 1, node(a, b, depth + 1, above)) for a, b in _thirds(order, codes, ends, low, high, depth + 1))
    return nodes


def _thirds(order: list[int], codes: list[list[int]], ends: list[int], low: int, high: int, depth: int) -> list[tuple[int, int]]:
    """Sort a range by the turn at `depth`, those without one first; the parts that share one."""
    parts, todo = [], [(low, high)]
    key = lambda k: codes[k][depth] if depth < ends[k] else -2
    while todo:
        a, b = todo.pop()
        if b <= a:
            continue
        pivot = key(order[(a + b) // 2])
        less, same, more = [], [], []
        for k in order[a:b]:
            v = key(k)
            (less if v < pivot else same if v == pivot else more).append(k)
        order[a:b] = less + same + more
        x, y = a + len(less), b - len(more)
        if pivot != -2:
            parts.append((x, y))
        todo += [(a, x), (y, b)]
    return parts


def _finished(rows: DataFrame) -> DataFrame:
    """Nodes of the buckets in rows (conv_id, depth, code, bytes, rep, top, parent), each of them within one task, and `is_top`."""

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(7)), strict=True))
        out: list[tuple] = []
        for (_rep, top, parent), bucket in groupby(each, key=lambda r: r[:3]):
            codes, sizes, ids = [], [], []
            for r in bucket:
                if r[4] == top:
                    ids.append(r[3])
                    codes.append([])
                    sizes.append([])
                codes[-1].append(r[5])
                sizes[-1].append(r[6])
            nodes = _emit(codes, sizes, ids, parent, top)
            leaves, saved = [0] * len(nodes), [0] * len(nodes)
            for k in range(len(nodes) - 1, -1, -1):  # parents come before their children
                x = nodes[k]
                leaves[k] = leaves[k] or 1
                saved[k] += x[5]
                if x[7] >= 0:
                    leaves[x[7]] += leaves[k]
                    saved[x[7]] += saved[k]
                digest = hashlib.sha256(",".join(map(str, sorted(x[6]))).encode()).hexdigest() if x[6] else EMPTY
                out.append((x[0], x[1], x[2], x[3], x[4], leaves[k], saved[k], digest, x[7] < 0))
            if len(out) >= 4096:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    dealt = rows.select("rep", "top", "parent", "conv_id", "depth", "code", "bytes").repartition("rep").sortWithinPartitions("rep", "top", "conv_id", "depth")
    return dealt.mapInArrow(finish, NODE + ", is_top boolean")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in NODE.split(", ")] + ["is_top"]
    kinds = [pa.int64()] * 7 + [pa.string(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def hashed_ends(ended: DataFrame) -> DataFrame:
    """(rep, depth, ends_sha256): SHA-256 of the members' ids, ascending, joined by commas.

    Tasks of a global sort join ids into stretches of text; a node's stretches are then fed to its digest in order, one at a time.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, held, size = None, 0, [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([first], pa.int64()), pa.array([",".join(held)], pa.string())], ["rep", "depth", "first", "text"])

        for batch in batches:
            for rep, depth, conv in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if held and (key != (rep, depth) or size >= STRETCH):
                    yield row()
                    held, size = [], 0
                if not held:
                    key, first = (rep, depth), conv
                held.append(str(conv))
                size += len(held[-1]) + 1
        if held:
            yield row()

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in (0, 1, 3)), strict=True))
        for (rep, depth), texts in groupby(each, key=lambda r: r[:2]):
            digest = hashlib.sha256()
            for k, (_, _, text) in enumerate(texts):
                digest.update((("," if k else "") + text).encode())
            yield pa.RecordBatch.from_arrays([pa.array([rep], pa.int64()), pa.array([depth], pa.int64()), pa.array([digest.hexdigest()], pa.string())], ["rep", "depth", "ends_sha256"])

    ranged = ended.select("rep", "depth", "conv_id").repartitionByRange("rep", "depth", "conv_id").sortWithinPartitions("rep", "depth", "conv_id")
    stretches = ranged.mapInArrow(joined, "rep long, depth long, first long, text string")
    return stretches.repartition("rep", "depth").sortWithinPartitions("rep", "depth", "first").mapInArrow(digested, "rep long, depth long, ends_sha256 string")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _sha(c: Column) -> Column:
    return F.sha2(c.cast("string").cast("binary"), 256)


def trie(conversations: DataFrame) -> DataFrame:
    """A row a node: NODE."""
    spark = conversations.sparkSession
    ship(spark)
    turns = encoded(conversations)
    rows = written(rebuilt(turns), "rebuilt")
    smallest = rows.agg(F.min("conv_id")).first()[0]
    if smallest is None:
        return spark.createDataFrame([], NODE)
    found, turn = _Rounds(), 0
    here: DataFrame | None = rows.select("*", F.lit(smallest).alias("rep"), F.lit(0).cast("long").alias("top"), F.lit(None).cast("long").alias("parent"))
    while here is not None:
        here = _split(here, found, turn)
        turn += 1
    below = lambda places: rows.join(_union(places), "conv_id").where("depth >= top")
    local = written(_finished(below(found.local)), "local-nodes")
    chain = below(found.chains)
    last = F.col("depth") == F.col("length")
    chains = chain.select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("top"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(last, _sha(F.col("conv_id"))).otherwise(EMPTY).alias("ends_sha256"),
    )
    # What goes up to large buckets' forks: (rep, fork, leaves, saved).
    up = local.where("is_top").select(F.col("parent_conv_id").alias("rep"), (F.col("depth") - 1).alias("fork"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    up = up.union(_union(found.chains).select(F.col("parent").alias("rep"), F.col("top") - 1, F.lit(1).cast("long"), F.lit(0).cast("long")))
    sums = written(up.groupBy("rep", "fork").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), "sums")
    totals: list[DataFrame] = []
    deeper: DataFrame | None = None
    for k in range(len(found.forks) - 1, -1, -1):
        each = sums if deeper is None else sums.union(deeper)
        got = found.forks[k].join(each.groupBy("rep", "fork").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("under")), ["rep", "fork"], "left")
        got = got.select("rep", "top", "fork", "parent", "members", "n_children", "weight", F.coalesce("leaves", F.lit(1)).alias("leaves"), F.coalesce("under", F.lit(0)).alias("under"))
        totals.append(written(got, f"totals-{k}"))
        deeper = totals[-1].where("parent is not null").select(F.col("parent").alias("rep"), (F.col("top") - 1).alias("fork"), "leaves", (F.col("under") + F.col("weight")).alias("saved"))
    large = _union(totals).withColumnRenamed("parent", "above")
    cost = _union(found.spines).withColumn("cost", (F.col("members") - 1) * F.col("bytes"))
    spine = running(cost, ["rep", "top"], ["depth"], "cost", "spine").select("rep", "top", "depth", "before")
    ends = written(hashed_ends(_union(found.ended)), "ends")
    nodes = spine.join(large, ["rep", "top"]).join(ends, ["rep", "depth"], "left").select(
        F.col("rep").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("top"), F.col("above")).otherwise(F.col("rep")).alias("parent_conv_id"), F.col("members").alias("n_convs"), F.when(F.col("depth") == F.col("fork"), F.col("n_children")).otherwise(1).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"), (F.col("under") + F.col("weight") - F.col("before")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )
    return nodes.unionByName(local.drop("is_top")).unionByName(chains)
