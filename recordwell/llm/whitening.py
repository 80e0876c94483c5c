"""Whitening of embeddings by the eigenvectors of a covariance found in two passes.

Entries become integers, floor(256 * c), so that the first pass, of exact integer sums, gives the exact mean of
the distinct vectors (the fit list). The second centres each vector on it and sums outer products, a matrix
product a batch; the partitions' matrices are merged by treeAggregate, so the driver receives one matrix. Its symmetric
eigenproblem is solved there (d x d, bounded by the dimension); the projection goes to every row. A third
pass measures the covariance of the whitened fit list against the identity.

Defined results: a vector that is null or holds null or non-finite entries gives no row. Vectors of another length
than the commonest (of equally common ones the longest) can't share a covariance and give no row either. Repeated
rows are one vector of the fit list and a result each; a null vec_id stays null. Entries beyond the range of a long are
held at its ends; a deviation beyond it is null. A component whose eigenvalue is no more than rounding (1e-12 of the
trace) can't be scaled: whitened is null and it doesn't count in identity_error. An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..deploy import ship
from .shared import written

COMPONENTS = 4
#: Eigenvalues up to this share of the trace are rounding.
ROUNDING = 1e-12
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, e) of the vectors without null or non-finite entries, e of doubles."""
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(F.col("embedding").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))


def commonest_length(vectors: DataFrame) -> int:
    top = vectors.groupBy(F.size("e").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).first()
    return top.d if top else 0


def whole(batch: pa.RecordBatch, column: int, d: int) -> np.ndarray:
    """The batch's vectors as integers, a row each."""
    c = batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), d)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(256.0 * c)
        return np.where(x >= 2.0**63, HIGHEST, np.where(x <= -(2.0**63), LOWEST, x.astype(np.int64)))


def packed(x: np.ndarray) -> bytes:
    """A vector's bytes, two an entry where that is enough; equal for equal vectors only."""
    small = len(x) and x.min() >= -(1 << 15) and x.max() < 1 << 15
    return (b"s" + x.astype("<i2").tobytes()) if small else (b"l" + x.astype("<i8").tobytes())


def unpacked(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(v[1:], "<i2" if v[:1] == b"s" else "<i8").astype(np.int64) for v in column.to_pylist()])


def fit_list(vectors: DataFrame, d: int) -> DataFrame:
    """Each distinct integer vector once, as bytes. Copies are combined before they are shuffled."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([pa.array([packed(x) for x in whole(batch, 0, d)], pa.binary())], ["x"])

    return written(vectors.select("e").mapInArrow(pack, "x binary").distinct(), "whitening-fit")


def _merged(fit: DataFrame, of_batch, depth: int = 2):
    """The sum of of_batch(integer vectors) over the fit list: batches within tasks, then tasks by treeAggregate.

    of_batch gives an array; its rows go to the driver only as one merged array.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                one = of_batch(unpacked(batch.column(0)))
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([_sent(total)], pa.binary())], ["part"])

    parts = fit.mapInArrow(partial, "part binary").rdd.map(lambda r: _received(bytes(r.part)))
    return parts.treeAggregate(0, add, add, depth)


def _sent(a: np.ndarray) -> bytes:
    """Doubles as they are; Python integers as text."""
    return b"i" + " ".join(map(str, a)).encode() if a.dtype == object else b"d%d " % a.shape[0] + a.astype("<f8").tobytes()


def _received(b: bytes) -> np.ndarray:
    if b[:1] == b"i":
        return np.array([int(x) for x in b[1:].split()], object)
    head, _, rest = b[1:].partition(b" ")
    return np.frombuffer(rest, "<f8").reshape(int(head), -1)


def exact_sums(x: np.ndarray) -> np.ndarray:
    """The number of vectors, then the sum of each dimension, as Python integers: halves of 32 bits can't overflow."""
    high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
    return np.array([len(x), *((int(h) << 32) + int(b) for h, b in zip(high, low, strict=True))], object)


class Whitening:
    """n and total: vectors and exact sums by dimension; projection: a column a component, already divided by sqrt(e)."""

    def __init__(self, n: int, total: list[int], covariance: np.ndarray, components: int):
        self.n, self.total = n, total
        self.mean = mean_of(n, total)
        values, vectors = np.linalg.eigh(covariance)
        order = np.argsort(values, kind="stable")[::-1][:components]
        trace = float(np.trace(covariance))
        self.values, self.vectors = values[order], vectors[:, order]
        lead = self.vectors[np.abs(self.vectors).argmax(axis=0), np.arange(len(order))]
        self.vectors = self.vectors * np.where(lead < 0, -1.0, 1.0)  # one sign for every run
        self.live = self.values > max(0.0, trace * ROUNDING)
        self.projection = self.vectors / np.sqrt(np.where(self.live, self.values, 1.0))
        self.explained = [float(v) / trace if trace > 0 else None for v in self.values]
        self.identity_error: float | None = None

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.projection

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """sum((n * x - S) ** 2) of each row, exactly."""
        top, n = max(1, int(max(abs(int(x.min())), abs(int(x.max()))))), self.n
        weight = max(1, *map(abs, self.total))
        if top * max(top, weight) * x.shape[1] < 1 << 62:
            square, cross = (x * x).sum(axis=1).tolist(), (x @ np.array(self.total, np.int64)).tolist()
        else:
            whole_x = x.astype(object)
            square, cross = [sum(v * v for v in row) for row in whole_x], [sum(v * s for v, s in zip(row, self.total, strict=True)) for row in whole_x]
        fixed = sum(s * s for s in self.total)
        found = (n * n * a - 2 * n * b + fixed for a, b in zip(square, cross, strict=True))
        return [v if v <= HIGHEST else None for v in found]


def mean_of(n: int, total: list[int]) -> np.ndarray:
    return np.array([s / n for s in total])  # true division of integers: rounded once


def fit(vectors: DataFrame, d: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the usable vectors of length d; None where there are none."""
    rows = fit_list(vectors, d)
    sums = _merged(rows, exact_sums)
    if isinstance(sums, int):
        return None
    n, total = int(sums[0]), [int(s) for s in sums[1:]]
    mean = mean_of(n, total)

    def outer(x: np.ndarray) -> np.ndarray:
        centred = x - mean
        return centred.T @ centred

    model = Whitening(n, total, np.asarray(_merged(rows, outer)) / n, min(components, d))

    def spread(x: np.ndarray) -> np.ndarray:
        """Sums of the whitened vectors and of their products: the first row, and the rest."""
        w = model.whiten(x)
        return np.vstack([w.sum(axis=0), w.T @ w])

    got = np.asarray(_merged(rows, spread)) / n
    off = (got[1:] - np.outer(got[0], got[0]) - np.eye(len(model.values)))[np.ix_(model.live, model.live)]
    model.identity_error = float(np.abs(off).max()) if off.size else None
    return model


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component: RESULT."""
    spark = vectors.sparkSession
    ship(spark)
    rows = usable(vectors)
    d = commonest_length(rows)
    rows = rows.where(F.size("e") == d)
    model = fit(rows, d, components) if d else None
    if model is None:
        return spark.createDataFrame([], RESULT)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x, k, m = whole(batch, 1, d), len(model.values), len(batch)
            w = model.whiten(x)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(m), k)))
            deviation = pa.array(model.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
            values = pa.array(w.ravel(), pa.float64(), mask=np.tile(~model.live, m))
            columns = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n, np.int64)), deviation, values, pa.array(model.explained * m, pa.float64()), pa.array([model.identity_error] * (m * k), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, RESULT)
