"""Packed id matrices by best-fit decreasing, with segment bounds, as a binary table.

Each task packs the pieces of a bounded stretch of its partition (a token budget), so
memory doesn't grow with the input. Documents longer than the width are split
losslessly: whole windows first, then the rest. Pieces go, longest first, into the
row whose free space is smallest yet enough; a segment tree over the free sizes
finds it in log(width) steps.

Defined results: a null or empty text has no ids and no piece; repeated rows are packed
as often as they come; an empty table writes an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..deploy import ship
from .byte_tokens import loaded
from .shared import written

#: One row a sequence. ids: its row of the matrix, `width` ids of 2 bytes, little-endian,
#: padded with pad_id; cu_seqlens: cumulative lengths from 0; position_resets: where positions restart at 0.
SCHEMA = "sequence_id long, ids binary, used int, cu_seqlens array<int>, position_resets array<int>, pieces array<struct<doc_id:long,start:long,length:int,doc_tokens:long>>"

PIECE = pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("doc_tokens", pa.int64())])


class FreeSpace:
    """Rows by free size, in a segment tree whose nodes count the rows below them."""

    def __init__(self, width: int):
        self.leaves = 1 << width.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(width + 1)]

    def add(self, size: int, row: int) -> None:
        self.rows[size].append(row)
        self._change(size, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """The row with the smallest free size of at least `least`, and that size; the row leaves the tree."""
        node = self.leaves + least
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node == 1:
                return None
            node += 1
            while node < self.leaves:
                node *= 2
                node += not self.count[node]
        size = node - self.leaves
        self._change(size, -1)
        return self.rows[size].pop(), size

    def _change(self, size: int, by: int) -> None:
        node = self.leaves + size
        while node:
            self.count[node] += by
            node >>= 1


def best_fit(lengths: list[int], width: int) -> list[list[int]]:
    """Best-fit decreasing: the pieces' indexes, by row."""
    free, rows = FreeSpace(width), []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        row, size = free.take(lengths[k]) or (len(rows), width)
        if row == len(rows):
            rows.append([])
        rows[row].append(k)
        if size > lengths[k]:
            free.add(size - lengths[k], row)
    return rows


def packed_matrices(docs: DataFrame, vocabulary: str, width: int = 2048, pad_id: int = 0, budget: int = 8_000_000) -> DataFrame:
    """Rows of SCHEMA. budget: tokens that a task packs together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, next_id, held, gathered = loaded(vocabulary), TaskContext.get().partitionId() << 36, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal next_id
            pieces = [(key, a, ids[a : a + width], len(ids)) for key, ids in held for a in range(0, len(ids), width)]
            rows = best_fit([len(p[2]) for p in pieces], width)
            for low in range(0, len(rows), 1000):
                out: list[list] = [[] for _ in range(6)]
                for members in rows[low : low + 1000]:
                    line = np.concatenate([pieces[k][2] for k in members])
                    bounds = np.cumsum([0, *(len(pieces[k][2]) for k in members)]).tolist()
                    full = np.full(width, pad_id, "<u2")
                    full[: len(line)] = line
                    about = [{"doc_id": pieces[k][0], "start": pieces[k][1], "length": len(pieces[k][2]), "doc_tokens": pieces[k][3]} for k in members]
                    for column, value in zip(out, (next_id, full.tobytes(), len(line), bounds, bounds[:-1], about), strict=True):
                        column.append(value)
                    next_id += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(PIECE)), strict=True)], ["sequence_id", "ids", "used", "cu_seqlens", "position_resets", "pieces"])

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = tok.ids(text.as_py()).astype("<u2")
                held.append((key.as_py(), ids))
                gathered += len(ids)
                if gathered >= budget:
                    yield from flush()
                    held, gathered = [], 0
        yield from flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def write_matrices(docs: DataFrame, vocabulary: str, path: str | None = None, **how) -> DataFrame:
    """Write the matrices as Parquet (to `path`, or to the shared folder) and return them as read back."""
    ship(docs.sparkSession)
    made = packed_matrices(docs, vocabulary, **how)
    if path is None:
        return written(made, "matrices")
    made.write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def manifest(matrices: DataFrame) -> DataFrame:
    """One row a piece, with the checksum of its ids as they stand in the matrix."""
    each = matrices.select("sequence_id", "ids", F.posexplode(F.arrays_zip("pieces", F.col("position_resets").alias("offset"))).alias("k", "x"))
    piece = F.col("x.pieces")
    return each.select(
        piece.doc_id.alias("doc_id"), piece.start.alias("start"), piece.length.cast("long").alias("length"), piece.doc_tokens.alias("doc_tokens"), "sequence_id", F.col("x.offset").cast("long").alias("offset"),
        F.crc32(F.substring(F.col("ids"), F.col("x.offset") * 2 + 1, piece.length * 2)).alias("ids_crc32"),
    )
