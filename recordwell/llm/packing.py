"""Concatenate and cut: every token of the corpus gets a global offset, windows are cut from it.

Pass 1 tokenises once and writes ids, with each document's offset inside its partition.
The partition totals (one number a partition) become base offsets by a prefix sum.
Pass 2 adds the base and cuts at multiples of the width. No shuffle moves ids.

Defined results: a null or empty text is its closing id alone; repeated rows are packed
as often as they come; a null doc_id is carried through; an empty table gives no pieces;
other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..deploy import ship
from .byte_tokens import loaded
from .shared import written

#: Bytes of ids that a worker holds before it hands a batch on.
FLUSH_BYTES = 8 << 20

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, boundary boolean"


def tokenised(docs: DataFrame, vocabulary: str, closing_id: int | None = 1) -> DataFrame:
    """Rows (doc_id, part, at, n, ids): ids little-endian, 2 bytes each; at: tokens before it in its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part, at = loaded(vocabulary), TaskContext.get().partitionId(), 0
        end = np.array([] if closing_id is None else [closing_id], "<u2").tobytes()
        names, keys, ats, ns, held, size = ["doc_id", "part", "at", "n", "ids"], [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([part] * len(keys), pa.int32()), pa.array(ats, pa.int64()), pa.array(ns, pa.int64()), pa.array(held, pa.binary())], names)

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = tok.ids(text.as_py()).astype("<u2").tobytes() + end
                keys.append(key.as_py())
                ats.append(at)
                ns.append(len(ids) // 2)
                held.append(ids)
                at, size = at + len(ids) // 2, size + len(ids)
                if size >= FLUSH_BYTES:
                    yield flush()
                    keys, ats, ns, held, size = [], [], [], [], 0
        if keys:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, part int, at long, n long, ids binary")


def packed(tokens: DataFrame, width: int = 2048) -> DataFrame:
    """Pieces of `tokens` (a written table of tokenised()) in windows of `width`; ids as unsigned 32-bit, little-endian."""
    totals = sorted(tokens.groupBy("part").agg(F.sum("n").alias("n")).collect())  # a row for each partition, not for each document
    bases = [0, *accumulate(r.n for r in totals)]
    base = tokens.sparkSession.createDataFrame([(r.part, b) for r, b in zip(totals, bases, strict=False)], "part int, base long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PIECES.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        for batch in batches:
            rows, size = [], 0
            for key, first, raw in zip(*(batch.column(k).to_pylist() for k in (0, 1)), batch.column(2), strict=True):
                ids = np.frombuffer(raw.as_buffer(), "<u2").astype("<u4")
                a, n = 0, len(ids)
                while a < n:
                    window, offset = divmod(first + a, width)
                    b = min(n, a + width - offset)
                    rows.append((key, a, b - a, ids[a:b].tobytes(), n, window, offset, a > 0 or b < n))
                    a = b
                size += 4 * n
                if size >= FLUSH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    placed = tokens.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("at")).alias("first"), "ids")
    return placed.mapInArrow(cut, PIECES)


def pack_documents(docs: DataFrame, vocabulary: str, width: int = 2048, closing_id: int = 1) -> DataFrame:
    """Tokenise, write, and cut. Returns the pieces with their ids."""
    ship(docs.sparkSession)
    return packed(written(tokenised(docs, vocabulary, closing_id), "tokens"), width)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "boundary")
