"""Nearest neighbours by a block matrix join.

Candidates and queries are dealt by a hash of their ids into square tiles. In a tile, int8
codes give every inner product with a bound on its quantisation error:
|x.y - x'.y'| <= |x'||y - y'| + |x - x'||y| for codes x', y'. Pairs whose upper bound reaches the
k-th best lower bound are recomputed in double precision from the original vectors; the
others can't be among the k best. The tiles' lists are merged by a heap a query. Products of codes are exact at any
length: they are added in slices that float32 holds exactly. Bounds allow for the rounding of their own sums; where
they aren't finite, pairs aren't pruned.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take
no part; vectors of another length than the query's aren't compared with it; rows that repeat
a vec_id count once a length (the least vector stands); equal scores go to the smaller vec_id; a score too
large for a double is infinite and compares so, and one that is no number comes last; null ids take no part; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..deploy import ship

#: Rows of a tile's side, about; and queries that are multiplied at once within it.
TILE, STRIP = 8192, 256
#: Numbers of a tile's side: long vectors get smaller tiles.
TILE_NUMBERS = 8_000_000
#: Components of a slice: 127 * 127 * SLICE is below 2^24, so float32 holds each partial sum of code products exactly.
SLICE = 1024

FOUND = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, label: str | None = None) -> DataFrame:
    """(vec_id, embedding, dim[, label]) of the vectors that take part."""
    e = F.col("embedding")
    sound = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(e, lambda x: x != 0)
    keep = [F.col("vec_id").cast("long"), e, F.size(e).alias("dim"), *([F.col(label).alias("label")] if label else [])]
    return vectors.where(F.col("vec_id").isNotNull() & e.isNotNull() & sound).select(*keep)


def matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    """A list column of equally long vectors as a matrix in double precision."""
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(rows, -1)


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes (held as float32 for products of slices), scales, norms of the coded vectors, norms of the errors."""
    scale = np.maximum(np.abs(x).max(1) / 127, np.finfo(float).tiny)  # denormal vectors get the code 0 and a true error
    codes = np.rint(x / scale[:, None])
    back = codes * scale[:, None]
    return codes.astype(np.int8).astype(np.float32), scale, np.linalg.norm(back, axis=1), np.linalg.norm(x - back, axis=1)


def code_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All inner products of codes, exact."""
    total = np.zeros((len(x), len(y)))
    for low in range(0, x.shape[1], SLICE):
        total += x[:, low : low + SLICE] @ y[:, low : low + SLICE].T
    return total


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row inner products, added from the first component to the last, so equal rows give equal sums."""
    total = np.zeros(len(x))
    for k in range(x.shape[1]):
        total += x[:, k] * y[:, k]
    return total


def best_in_tile(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query ids, candidate ids, scores), at most k a query, exact."""
    (qc, qs, qn, qe), (cc, cs, cn, ce) = coded(q), coded(c)
    cfull = np.linalg.norm(c, axis=1)
    for low in range(0, len(q), STRIP):
        at = slice(low, low + STRIP)
        with np.errstate(over="ignore", invalid="ignore"):
            near = code_products(qc[at], cc) * qs[at, None] * cs
            rounding = (qn[at] + qe[at])[:, None] * cfull * (q.shape[1] + 8) * np.finfo(float).eps
            slack = (qn[at, None] * ce + qe[at, None] * cfull) * (1 + 1e-9) + rounding + 1e-300
            own = qid[at, None] == cid
            sure = np.isfinite(near) & np.isfinite(slack)
            lower = np.where(own | ~sure, -np.inf, near - slack)
            upper = np.where(own, -np.inf, np.where(sure, near + slack, np.inf))
        if len(cid) > k:
            bar = np.partition(lower, len(cid) - k, axis=1)[:, len(cid) - k]
            row, col = np.nonzero((upper >= bar[:, None]) & ~own)
        else:
            row, col = np.nonzero(~own)
        score = np.concatenate([products(q[low + row[a : a + 100_000]], c[col[a : a + 100_000]]) for a in range(0, len(row), 100_000)] or [np.zeros(0)])
        order = np.lexsort((cid[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        first = np.searchsorted(row, np.arange(row.max() + 1 if len(row) else 0))
        keep = np.arange(len(row)) - first[row] < k if len(row) else np.zeros(0, bool)
        yield qid[low + row[keep]], cid[col[keep]], score[keep]


def once(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors; of rows with one id the least vector."""
    ids, x = t.column("vec_id").to_numpy(), matrix(t.column("embedding"), t.num_rows)
    order = np.lexsort((*x.T[::-1], ids)) if len(np.unique(ids)) < len(ids) else np.argsort(ids)
    ids, x = ids[order], x[order]
    keep = np.r_[True, ids[1:] != ids[:-1]]
    return ids[keep], x[keep]


def nearest(vectors: DataFrame, is_query, k: int = 20, tile: int = TILE) -> DataFrame:
    """The k nearest of each row for which is_query holds: (query_id, rank, vec_id, score)."""
    ship(vectors.sparkSession)
    rows = usable(vectors)
    wanted = rows.where(is_query)
    total, asked, longest = rows.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1)), F.max("dim")).first()
    tile = max(1, min(tile, TILE_NUMBERS // (longest or 1)))
    across, down = max(1, -(-total // tile)), max(1, -(-asked // tile))

    def dealt(df: DataFrame, mine: str, n: int, other: str, m: int) -> DataFrame:
        return df.withColumn(mine, F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    keys = ["dim", "c_tile", "q_tile"]
    c = dealt(rows, "c_tile", across, "q_tile", down).groupBy(*keys)
    q = dealt(wanted, "q_tile", down, "c_tile", across).groupBy(*keys)

    def tiles(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = list(best_in_tile(*once(right), *once(left), k)) if left.num_rows and right.num_rows else []
        columns = [np.concatenate([p[n] for p in parts]) if parts else np.zeros(0, t) for n, t in enumerate(("i8", "i8", "f8"))]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (x for b in batches for x in zip(*(b.column(n).to_pylist() for n in range(3)), strict=True))
        out: list[tuple] = []
        for query, found in groupby(stream, lambda x: x[0]):
            best = heapq.nsmallest(k, found, key=lambda x: (-x[2], x[1]))
            out += [(query, n, v, s) for n, (_, v, s) in enumerate(best, 1)]
            if len(out) > 50_000:
                yield listed(out)
                out = []
        if out:
            yield listed(out)

    def listed(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.float64()), strict=True)], ["query_id", "rank", "vec_id", "score"])

    found = c.cogroup(q).applyInArrow(tiles, FOUND)
    return found.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(merge, "query_id long, rank int, vec_id long, score double")
