"""Whitening of embeddings by a covariance that is summed in tiles: pairs of column blocks are
multiplied row-block by row-block, summed by tile, put together and eigendecomposed."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, stored

#: Columns of a tile's side, rows of a row-block, and bytes of tiles that a task adds up before
#: it passes them on.
TILE, BLOCK, HELD = 32, 2048, 64 << 20


def gridded(vectors: DataFrame, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """``vec_id`` and ``x``, the vector on a grid of integers: floor(scale * entry) + offset.
    Rows without a vector, or with an empty one or an entry that is null or not finite, go;
    so do rows of another width than most (of equally frequent widths, the largest stays)."""
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad)
    x = F.transform("embedding", lambda c: F.floor(F.lit(float(scale)) * c.cast("double")) + F.lit(offset).cast("long"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def column_blocks(fit: DataFrame, width: int, tile: int) -> DataFrame:
    """The fit list cut into blocks of rows and columns: ``block, col, n, data`` (integers, row
    by row) and ``sums`` (of each column).  A block is named by the partition of the written
    list and its number there, so a repeated task makes the same blocks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, k = TaskContext.get().partitionId() << 32, 0
        for b in batches_of(batches, BLOCK):
            m = _matrix(b.column(0), width)
            cols = range(0, width, tile)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([first + k] * len(cols)), pa.array([c // tile for c in cols], pa.int32()), pa.array([len(m)] * len(cols)),
                    pa.array([m[:, c : c + tile].tobytes() for c in cols], pa.binary()), pa.array([m[:, c : c + tile].sum(0).tolist() for c in cols], pa.list_(pa.int64())),
                ],
                names=["block", "col", "n", "data", "sums"],
            )
            k += 1

    return fit.select("x").mapInArrow(cut, "block long, col int, n long, data binary, sums array<long>")


def covariance(blocks: DataFrame, n: int, sums: list[int], tile: int) -> np.ndarray:
    """Covariance (divisor n) of what ``column_blocks`` cut, centred before it is multiplied.
    Only tiles reach the driver: width * width / 2 doubles."""
    width = len(sums)
    mean = np.array([s / n for s in sums])

    def centred(data: bytes, rows: int, col: int) -> np.ndarray:
        return np.frombuffer(data, np.int64).reshape(rows, -1) - mean[col * tile : (col + 1) * tile]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        part = TaskContext.get().partitionId()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in held], pa.int32()), pa.array([k[1] for k in held], pa.int32()), pa.array([part] * len(held), pa.int32()), pa.array([t.tobytes() for t in held.values()], pa.binary())],
                names=["a", "b", "part", "tile"],
            )

        for batch in batches_of(batches, 16):
            for a, b, rows, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                t = centred(x, rows, a).T @ centred(y, rows, b)
                held[a, b] = held[a, b] + t if (a, b) in held else t
            if sum(t.nbytes for t in held.values()) > HELD:
                yield out()
                held.clear()
        if held:
            yield out()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of tiles that come sorted, one at a time."""
        key, total = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["a", "b", "tile"])
        for batch in batches_of(batches, 16):
            for a, b, t in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "tile")), strict=True):
                if key != (a, b):
                    if key is not None:
                        yield row()
                    key, total = (a, b), 0
                total = total + np.frombuffer(t)
        if key is not None:
            yield row()

    left, right = blocks.select("block", F.col("col").alias("a"), "n", F.col("data").alias("x")), blocks.select("block", F.col("col").alias("b"), F.col("data").alias("y"))
    pairs = left.join(right, "block").where("a <= b").select("a", "b", "n", "x", "y")
    tiles = pairs.mapInArrow(multiply, "a int, b int, part int, tile binary").repartition("a", "b").sortWithinPartitions("a", "b", "part")
    out = np.zeros((width, width))
    for r in tiles.mapInArrow(add, "a int, b int, tile binary").collect():
        rows, cols = slice(r.a * tile, min((r.a + 1) * tile, width)), slice(r.b * tile, min((r.b + 1) * tile, width))
        out[rows, cols] = np.frombuffer(r.tile).reshape(rows.stop - rows.start, -1)
        out[cols, rows] = out[rows, cols].T
    return out / n


@dataclass
class Whitening:
    """What was fitted: ``n`` distinct vectors, their column sums, and by component the
    eigenvalue, its share of the trace and the unit eigenvector (a row)."""

    n: int
    sums: list[int]
    values: np.ndarray
    explained: np.ndarray
    vectors: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows: centred, projected, over the root of the eigenvalue."""
        return (x - np.array([s / self.n for s in self.sums])) @ (self.vectors / np.sqrt(self.values)[:, None]).T

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum over the columns of (n x - sum)^2 for each row, exact at any size."""
        high = max(max(map(abs, self.sums)), self.n * int(np.abs(x).max(initial=0)))
        if high < 1 << 61:
            d = self.n * x - np.array(self.sums, np.int64)
            if int(np.abs(d).max(initial=0)) ** 2 * d.shape[1] < 1 << 62:
                return (d * d).sum(1).tolist()
        return [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist()]


def fit(distinct: DataFrame, components: int, tile: int = TILE) -> tuple[Whitening | None, DataFrame | None]:
    """The whitening of the written list ``distinct(x)`` and its column blocks; None without rows."""
    head = distinct.select(F.size("x").alias("w")).first()
    if head is None:
        return None, None
    blocks = stored(column_blocks(distinct, head.w, tile), "column-blocks")
    at = F.posexplode("sums").alias("i", "s")
    facts = blocks.select("col", "n", at).groupBy("col", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("col", "i").collect()  # a row a column
    n, sums = int(facts[0].n), [int(r.s) for r in facts]
    cov = covariance(blocks, n, sums, tile)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:components]
    # What rounding alone can have made has no variance to divide by.
    order = order[values[order] > max(values.max(), 0) * len(sums) * np.finfo(float).eps]
    vectors = vectors[:, order].T
    if len(order):
        vectors = vectors * np.where(vectors[np.arange(len(order)), np.abs(vectors).argmax(1)] < 0, -1.0, 1.0)[:, None]
    return Whitening(n, sums, values[order], values[order] / (np.trace(cov) or 1.0), vectors), blocks


def identity_error(distinct: DataFrame, model: Whitening) -> float:
    """The largest entry of (covariance of the whitened fit list - identity), from the data."""
    k, width = len(model.values), len(model.sums)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for b in batches_of(batches, BLOCK):
            w = model.project(_matrix(b.column(0), width))
            first += w.sum(0)
            second += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array([[*first, *second.ravel()]])], names=["m"])

    sums = distinct.select("x").mapInArrow(moments, "m array<double>").select(F.posexplode("m").alias("i", "s")).groupBy("i").agg(F.sum("s").alias("s"))
    m = np.array([r.s for r in sums.orderBy("i").collect()])  # k + k * k numbers
    # The projected mean is 0 but for rounding, so this takes nothing large from anything large.
    mean = m[:k] / model.n
    return float(np.abs(m[k:].reshape(k, k) / model.n - np.outer(mean, mean) - np.eye(k)).max(initial=0))


def whiten(vectors: DataFrame, components: int = 16, tile: int = TILE) -> DataFrame:
    """Whitened components of ``vectors(vec_id, embedding)``, fitted on its distinct vectors.

    Returns per usable row and component (numbered from 1 by falling eigenvalue): ``vec_id,
    component, n`` (distinct vectors), ``deviation`` (exact, decimal(38,0)), ``whitened,
    explained, identity_error``.  See ``gridded`` for what is usable and for the integers that
    all of it is computed on.  An eigenvector's sign makes its largest entry positive.

    Equal vectors are combined before their exchange, so copies, however many, are fitted once
    and in no single task.  The driver holds width * width doubles, nothing that grows with
    the rows: widths to some thousands.  Every task of a lost executor can be run again from
    the written list and its blocks.

    Rows without vec_id and repeated rows each have their components.  Components without
    variance (of constant columns; all, where there is one distinct vector) have no row;
    neither has an empty table.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = stored(gridded(vectors), "gridded")
    widths = rows.groupBy(F.size("x").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    if widths is not None:
        rows = rows.where(F.size("x") == widths.w)
    distinct = stored(rows.select("x").distinct(), "fit-list")
    model, _ = fit(distinct, components, tile)
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return spark.createDataFrame([], schema)
    error, k, width = identity_error(distinct, model), len(model.values), len(model.sums)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, BLOCK):
            x = _matrix(b.column(1), width)
            each = np.repeat(np.arange(len(x)), k)
            far = pa.array([str(d) for d in model.deviation(x)])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), far.take(pa.array(each)), pa.array(model.project(x).ravel()), pa.array(np.tile(model.explained, len(x)))],
                names=["vec_id", "component", "deviation", "whitened", "explained"],
            )

    out = rows.select("vec_id", "x").mapInArrow(project, "vec_id long, component int, deviation string, whitened double, explained double")
    return out.select("vec_id", "component", F.lit(model.n).cast("long").alias("n"), F.col("deviation").cast("decimal(38,0)").alias("deviation"), "whitened", "explained", F.lit(error).alias("identity_error"))
