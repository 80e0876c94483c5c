"""Near-duplicate texts: tensored MinHash banding, then exact Jaccard on full shingle sets.

Two small collections of keys, `SIDE` on each side, of `ROWS` minhashes each, are combined
into SIDE * SIDE table keys: a pair of texts meets if it agrees on some key of either side. So
2 * SIDE * ROWS minhashes do the work of SIDE * SIDE * 2 * ROWS. With 10 keys of 3 minhashes a pair
of similarity 0.8 meets with probability 0.998.

Texts with one shingle set are one class from the start. Only keys that two classes share
go on: first each side's keys, then their combinations. Classes that meet, directly or over others,
form a cluster; within a cluster all pairs are verified at once by products of 0/1 matrices.
A larger cluster is cut into blocks by set size, and pairs of blocks whose sizes allow
the similarity go to tasks of their own. Tasks return a forest of links, never all pairs.

Defined results: a text without words, or null, has an empty set and links with nothing; a text
with fewer words than a shingle is one shingle. Repeated rows have one class. A null doc_id names no
vertex: its component is null and it is kept. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..deploy import ship
from .components import components
from .shared import sized, written

SIDE, ROWS = 10, 3
#: Classes of a block: a sixteenth of its cluster, within these bounds; and shingles of a block. A task compares two blocks at most.
LEAST_BLOCK, BLOCK, BLOCK_SHINGLES = 256, 1024, 1_000_000
#: Bytes of text that are hashed at once.
TOGETHER = 1 << 20
#: Frequent shingles that are multiplied at once; shingles of up to RARE texts are counted pair by pair.
STRIP, RARE = 2048, 24

_u = np.uint64
_random = np.random.default_rng(20240229)
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
_WORD = _random.integers(1, 1 << 63, 16, dtype=np.uint64) | _u(1)
_MIX = _random.integers(1, 1 << 63, (2 * SIDE * ROWS, 2), dtype=np.uint64) | _u(1)
_PRIME, _INVERSE = _u(0x9E3779B97F4A7C15), _u(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWER = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWER["up"]) < n:
        for name, base in (("up", _PRIME), ("down", _INVERSE)):
            steps = np.full(2 * n, base, np.uint64)
            steps[0] = 1
            _POWER[name] = np.cumprod(steps)
    return _POWER["up"], _POWER["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _u(30))) * _u(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _u(27))) * _u(0x94D049BB133111EB)
    return x ^ (x >> _u(31))


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes. Texts are UTF-8; A-Z count as a-z."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    word = ~((low == 32) | ((low >= 9) & (low <= 13)))
    edge = np.flatnonzero(np.diff(np.r_[False, word, False].astype(np.int8)))
    first, last = edge[::2], edge[1::2]
    up, down = _powers(len(low) + 1)
    total = np.r_[_u(0), np.cumsum(_BYTE[low] * up[: len(low)])]
    words = mixed((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64) * _u(0xD6E8FEB86659FD93))
    bounds = np.searchsorted(first, np.r_[0, ends])
    rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        rolled += words[k : k + len(rolled)] * _WORD[k]
    rolled, out = mixed(rolled), []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:  # the whole sequence is the one shingle
            out.append(mixed((words[a:b] * _WORD[8 : 8 + b - a]).sum(dtype=np.uint64)[None]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def half_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A row a nonempty set: SIDE keys of the left collection, then SIDE of the right."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.zeros((len(sets), 2 * SIDE), np.uint64)
    for k in range(2 * SIDE):
        key = np.full(len(sets), k + 1, np.uint64)
        for r in range(ROWS):
            a, b = _MIX[k * ROWS + r]
            h = (flat ^ b) * a
            key = mixed(key * _PRIME + np.minimum.reduceat(h ^ (h >> _u(32)), starts))
        out[:, k] = key
    return out


def class_key(s: np.ndarray) -> bytes:
    """128 bits of a set."""
    return np.array([s.sum(dtype=np.uint64), mixed(s + _u(77)).sum(dtype=np.uint64)], "<u8").tobytes() if len(s) else b""


def _stretches(texts: list) -> Iterator[tuple[int, int]]:
    low, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= TOGETHER or k == len(texts) - 1:
            yield low, k + 1
            low, size = k + 1, 0


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, class, keys) of each text; class and keys are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in batch.column(1)]
            for low, high in _stretches(texts):
                sets = shingle_sets(texts[low:high], width)
                full = [s for s in sets if len(s)]
                keys = iter(half_keys(full).view(np.int64) if full else [])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_key(s) or None for s in sets], pa.binary()), pa.array([next(keys).tolist() if len(s) else None for s in sets], pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "class", "keys"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, class binary, keys array<long>")


def clusters(classes: DataFrame) -> DataFrame:
    """(vertex, component) of the classes (rep, keys) that share a table key with another, directly or over others."""
    half = classes.select("rep", F.posexplode("keys").alias("k", "key"))
    # Written first: the joins' sides then are plain shuffles, so a hot key's rows can be split among tasks.
    shared = written(half.groupBy("k", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k", "key"), "shared-keys")
    side = lambda left: F.filter("both", lambda x: (x.k < SIDE) if left else (x.k >= SIDE))
    live = half.join(shared, ["k", "key"]).groupBy("rep").agg(F.collect_list(F.struct("k", "key")).alias("both"))  # 2 * SIDE at most
    pairs = live.select("rep", F.explode(side(True)).alias("a"), side(False).alias("right")).select("rep", "a", F.explode("right").alias("b"))
    tables = written(pairs.select("rep", F.xxhash64("a.k", "a.key", "b.k", "b.key").alias("key")), "table-keys")
    heads = written(tables.groupBy("key").agg(F.min("rep").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "head"), "key-heads")
    return components(tables.join(heads, "key").where("rep <> head").select(F.col("rep").alias("u"), F.col("head").alias("v")).distinct())


def block_pairs(members: DataFrame, least: float) -> DataFrame:
    """Where each member (rep, class, n_shingles, cluster) goes: (task_a, task_b, side) of its cluster.

    Members of a large cluster are dealt to blocks by set size, so blocks whose sizes are too
    far apart for the similarity are never paired.
    """
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"), F.sum("n_shingles").alias("shingles"))
    block = F.least(F.lit(BLOCK), F.greatest(F.lit(LEAST_BLOCK), (F.col("members") / 16).cast("int")))
    large = (F.col("members") > LEAST_BLOCK) | (F.col("shingles") > BLOCK_SHINGLES)
    # Steps of a little more than the factor, so sizes two steps apart differ by more than it.
    step = F.floor(F.log(F.col("n_shingles").cast("double")) / float(1.001 * np.log(1 / least)))
    stepped = members.join(sizes, "cluster").withColumn("step", F.when(large, step).otherwise(0).cast("int"))
    cuts = F.ceil(F.greatest(F.count(F.lit(1)) / F.max(block), F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    per_step = stepped.groupBy("cluster", "step", large.alias("large")).agg(cuts.alias("cuts")).withColumn("cuts", F.when(F.col("large"), F.col("cuts")).otherwise(1))
    near = per_step.select(F.col("cluster").alias("c2"), F.col("step").alias("other"), F.col("cuts").alias("other_cuts"))
    cut = stepped.join(per_step.drop("large"), ["cluster", "step"]).withColumn("cut", F.pmod(F.xxhash64("class"), F.col("cuts")).cast("int"))
    met = cut.join(near, (F.col("cluster") == F.col("c2")) & F.col("other").between(F.col("step") - 1, F.col("step") + 1))
    each = met.withColumn("other_cut", F.explode(F.sequence(F.lit(0), F.col("other_cuts") - 1)))
    mine, its = F.struct("step", "cut"), F.struct(F.col("other").alias("step"), F.col("other_cut").alias("cut"))
    return each.select("rep", "class", "cluster", F.xxhash64(F.least(mine, its), F.greatest(mine, its)).alias("task"), F.when(mine == its, 0).when(mine < its, 1).otherwise(2).alias("side"))


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections above the diagonal."""
    n = len(sets)
    if n <= 4:
        out = np.zeros((n, n), np.int64)
        for a in range(n):
            for b in range(a + 1, n):
                out[a, b] = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        return out
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    count = np.diff(np.r_[first, len(flat)])
    each = np.repeat(count, count)
    rare = (each > 1) & (each <= RARE)
    out, f, o = np.zeros(n * n, np.int64), flat[rare], owner[rare]
    for gap in range(1, RARE):
        same = f[gap:] == f[:-gap]
        if not same.any():
            break
        out += np.bincount(o[:-gap][same] * n + o[gap:][same], minlength=n * n)
    out = out.reshape(n, n)
    column = np.repeat(np.arange(len(count)), count)[each > RARE]
    column, o = np.unique(column, return_inverse=True)[1], owner[each > RARE]
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, STRIP):
        a, b = np.searchsorted(column, (low, low + STRIP))
        m = np.zeros((n, STRIP), np.float32)
        m[o[a:b], column[a:b] - low] = 1
        out += np.triu(m @ m.T, 1).astype(np.int64)
    return out


def linked(sets: list[np.ndarray], side: np.ndarray, least: int, out_of: int) -> list[tuple[int, int]]:
    """A forest of the links with out_of * intersection >= least * union; sides 1 and 2 are compared with each other only, side 0 with all."""
    n, size = len(sets), np.array([len(s) for s in sets], np.int64)
    both = shared_counts(sets)
    hit = out_of * both >= least * (size[:, None] + size - both)
    hit &= (side[:, None] == 0) | (side[:, None] != side)
    left, right = np.nonzero(np.triu(hit, 1))
    root, forest = list(range(n)), []

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        x, y = top(a), top(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            forest.append((a, b))
    return forest


def links(docs: DataFrame, members: DataFrame, width: int, least: int, out_of: int) -> DataFrame:
    """(u, v): a forest of verified links between the members (rep, class, n_shingles, cluster)."""
    wanted = sized(members.select(F.col("rep").alias("m_rep"), F.col("class").alias("m_class")))
    texts = docs.select(F.col("doc_id").cast("long").alias("m_rep"), "text").join(wanted, "m_rep")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, wish = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in batch.column(1)], batch.column(2).to_pylist()
            for low, high in _stretches(raw):
                found = shingle_sets(raw[low:high], width)
                keep = [k for k, s in enumerate(found) if class_key(s) == wish[low + k]]
                at = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low).take(at), batch.column(2).slice(low, high - low).take(at), pa.array([found[k].tobytes() for k in keep], pa.binary())], ["rep", "class", "shingles"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(5)), b.column(5), strict=True))
        for _, group in groupby(rows, key=lambda r: r[:2]):
            one = {r[3]: (r[2], r[4], np.frombuffer(r[5].as_buffer(), np.uint64)) for r in group}  # repeated rows count once
            side, reps, found = zip(*(one[k] for k in sorted(one)), strict=True)
            if forest := linked(list(found), np.array(side), least, out_of) if len(reps) > 1 else []:
                yield pa.RecordBatch.from_arrays([pa.array([reps[x[k]] for x in forest], pa.int64()) for k in (0, 1)], ["u", "v"])

    full = texts.select("m_rep", "text", "m_class").mapInArrow(sets, "rep long, class binary, shingles binary")
    dealt = sized(written(block_pairs(members, least / out_of), "dealt"))
    tasks = full.join(dealt, ["rep", "class"]).select("cluster", "task", "side", "class", "rep", "shingles")
    return tasks.repartition("cluster", "task").sortWithinPartitions("cluster", "task").mapInArrow(verify, "u long, v long")


def near_duplicates(docs: DataFrame, width: int = 5, least: int = 80, out_of: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each document."""
    return _grouped(docs, width, least, out_of).drop("class")


def _grouped(docs: DataFrame, width: int, least: int, out_of: int) -> DataFrame:
    ship(docs.sparkSession)
    signed = written(signatures(docs, width), "signatures")
    named = signed.where(F.col("class").isNotNull() & F.col("doc_id").isNotNull())
    classes = written(named.groupBy("class").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"), F.first("n_shingles").alias("n_shingles")), "classes")
    # Rows that repeat a doc_id with other texts are one vertex: its classes share their component.
    found = clusters(classes)
    members = written(classes.select("rep", "class", "n_shingles").join(found.select(F.col("vertex").alias("rep"), F.col("component").alias("cluster")), "rep"), "members")
    whole = components(links(docs, members, width, least, out_of).union(_repeats(named, classes)))
    of_class = classes.select("class", "rep").join(whole.select(F.col("vertex").alias("rep"), "component"), "rep", "left").select("class", F.coalesce("component", "rep").alias("component"))
    rows = signed.select("doc_id", "n_shingles", "class").join(of_class, "class", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), kept(component).alias("kept"), "class")


def _repeats(named: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of one doc_id that comes with several texts."""
    several = named.groupBy("doc_id").agg(F.min("class").alias("a"), F.max("class").alias("z"), F.count(F.lit(1)).alias("n")).where("a <> z").select("doc_id")
    reps = named.join(several, "doc_id").select("doc_id", "class").distinct().join(classes.select("class", "rep"), "class")
    return reps.select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))


def kept(component: Column) -> Column:
    return F.coalesce(F.col("doc_id") == component, F.lit(True))


def deduplicated(docs: DataFrame, width: int = 5, least: int = 80, out_of: int = 100) -> DataFrame:
    """The documents, with all their columns, but one row of each group of linked texts: the one of least doc_id.

    Rows are linked by their texts alone: an id that comes with several texts joins no groups, and each of its texts stays or goes with
    its own group. Rows without an id go before others of their group, and of equal ids any one stays. Rows whose text has no words are
    linked with nothing: they stay, but one a text of those that repeat an id.
    """
    ship(docs.sparkSession)
    key = "recordwell_row"
    while key in docs.columns:
        key += "_"
    own = F.col("doc_id").cast("long")
    ids = docs.groupBy(own.alias("id")).agg(F.count(F.lit(1)).alias("n"))
    unique = ids.where("n > 1 or id is null").isEmpty()
    # Where ids don't name rows, rows get numbers, written with them so that they last.
    rows = docs.withColumn(key, own) if unique else written(docs.withColumn(key, F.monotonically_increasing_id()), "numbered")
    every = _grouped(rows.select(F.col(key).alias("doc_id"), "text"), width, least, out_of).select(F.col("doc_id").alias("row"), F.col("component_id").alias("component"), "class")
    found = every.where("class is not null").drop("class")
    if unique:
        gone = found.where("row <> component").select("row")
    else:
        found = written(found.join(rows.select(F.col(key).alias("row"), own.alias("id")), "row"), "components")
        heads = found.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "row")).alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
        gone = found.join(written(heads.select("component", F.col("head.row").alias("head")), "heads"), "component").where("row <> head").select("row")
        empty = every.where("class is null").select("row").join(rows.select(F.col(key).alias("row"), own.alias("id"), "text").where("id is not null"), "row")
        empty = written(empty, "wordless")
        first = empty.groupBy("id", "text").agg(F.min("row").alias("row")).select("row")
        gone = gone.union(empty.select("row").join(first, "row", "left_anti"))
    gone = sized(written(gone.select(F.col("row").alias(key)), "gone"))
    return rows.join(gone, key, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
