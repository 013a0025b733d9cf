"""Embedding near-duplicates: random projections decoded to points of the E8 lattice in
several tables, neighbouring cells probed, cosine verified."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, connected_components, mixed, stored

#: Tables, neighbouring cells that a vector probes in each, and the projected length that is
#: one unit of the lattice.  Vectors at cosine 0.98 meet in a table with a probability of
#: about 0.85, so all tables miss such a pair about once in a million.
TABLES, PROBES, UNIT = 8, 8, 0.8


def _neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8, times two: by rule, two coordinates of one, or all of
    a half with an even number of minus signs."""
    out = []
    for i, j in combinations(range(8), 2):
        for s, t in product((2, -2), repeat=2):
            v = [0] * 8
            v[i], v[j] = s, t
            out.append(v)
    out += [s for s in product((1, -1), repeat=8) if s.count(-1) % 2 == 0]
    return np.array(out, np.int64)


_NEAR = _neighbours()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    f = np.rint(x)
    odd = np.flatnonzero(f.sum(1) % 2 != 0)
    k = np.abs(x[odd] - f[odd]).argmax(1)
    f[odd, k] += np.where(x[odd, k] >= f[odd, k], 1, -1)
    return f


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest lattice point of each row, times two (E8 is D8 and D8 moved by a half)."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    near = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return (np.where(near[:, None], a, b) * 2).astype(np.int64)


def _keys(cells: np.ndarray, salt: np.ndarray) -> np.ndarray:
    h = salt.astype(np.uint64)
    for i in range(8):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + cells[..., i].astype(np.uint64))
    return h.view(np.int64)


def cells(vectors: np.ndarray, labels: np.ndarray, tables: int, probes: int, unit: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the home cells (rows, tables) and of the probed cells (rows, tables, probes)."""
    rng = np.random.default_rng([seed, vectors.shape[1]])
    largest = np.abs(vectors).max(1, keepdims=True)
    unit_rows = vectors / largest
    unit_rows /= np.sqrt((unit_rows**2).sum(1, keepdims=True))
    home, probe = [], []
    for t in range(tables):
        x = unit_rows @ (rng.normal(size=(vectors.shape[1], 8)) / unit) + rng.uniform(0, 1, 8)
        at = nearest_e8(x)
        salt = mixed(labels.astype(np.uint64) * np.uint64(1000003) + np.uint64(t * 7919 + vectors.shape[1]))
        home.append(_keys(at, salt))
        gain = (x - at / 2) @ _NEAR.T
        best = np.argpartition(-gain, probes - 1, 1)[:, :probes]
        probe.append(_keys(at[:, None, :] + _NEAR[best], np.repeat(salt[:, None], probes, 1)))
    return np.stack(home, 1), np.stack(probe, 1)


def _matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and double matrix of each width among the lists of a column."""
    widths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    first = np.cumsum(widths) - widths
    return [(rows, flat[first[rows][:, None] + np.arange(w)]) for w in np.unique(widths) if len(rows := np.flatnonzero(widths == w))]


def _usable(e: Column) -> Column:
    """A vector of finite components, not all zero."""
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return e.isNotNull() & ~bad & F.exists(e, lambda x: x != 0)


def near_vectors(
    vectors: DataFrame, cosine: float = 0.98, tables: int = TABLES, probes: int = PROBES, unit: float = UNIT, seed: int = 17
) -> DataFrame:
    """Links between vectors of one label whose cosine (double precision) reaches ``cosine``.

    Returns per row ``vec_id, n_links`` (other vectors linked directly, copies included),
    ``component_id`` (smallest vec_id reachable) and ``kept`` (vec_id = component_id).
    ``vectors`` needs ``vec_id, embedding, label``; other columns are ignored.

    Equal vectors of a label are one class, so copies are never expanded into pairs.  Each
    class is indexed under its home cell of every table; it looks up that cell and the
    ``probes`` lattice neighbours nearest to it.  Candidates are distinct pairs of classes,
    each verified.  Null labels, null, zero and non-finite vectors, and rows without vec_id
    link with nothing (n_links 0).  Vectors of different widths are not compared.  Rows that
    repeat a vec_id with another vector count as linked vectors of their own.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding", F.col("label").cast("long").alias("label"))
    usable = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & _usable(F.col("embedding"))
    key = F.when(usable, F.concat_ws(":", F.xxhash64("label", "embedding"), F.xxhash64(F.lit(1), "embedding", "label")))
    rows = rows.withColumn("key", key)
    classes = rows.where("key is not null").groupBy("key").agg(
        F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding")
    )
    classes = stored(classes, "classes")

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, 1000):
            labels = b.column(1).to_numpy(zero_copy_only=False)
            for at, m in _matrix(b.column(2)):
                home, probe = cells(m, labels[at], tables, probes, unit, seed)
                all_ = np.concatenate([home, probe.reshape(len(at), -1)], 1)
                own = np.zeros(all_.shape, bool)
                own[:, :tables] = True
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(np.repeat(at, all_.shape[1]))), pa.array(all_.ravel()), pa.array(own.ravel())], names=["key", "cell", "home"]
                )

    posted = stored(classes.select("key", "label", "embedding").mapInArrow(post, "key string, cell long, home boolean"), "cells")
    index = posted.where("home").select("cell", F.col("key").alias("b"))
    found = posted.select("cell", F.col("key").alias("a")).join(index, "cell").where("a <> b")
    pairs = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 2000):
            same = batch.column(2).value_lengths().to_numpy(zero_copy_only=False) == batch.column(3).value_lengths().to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(same))
            good = np.zeros(batch.num_rows, bool)
            for (at, x), (_, y) in zip(_matrix(batch.column(2)), _matrix(batch.column(3)), strict=True):
                # Scaled, so that squares of the largest and smallest doubles stay in range.
                x, y = x / np.abs(x).max(1, keepdims=True), y / np.abs(y).max(1, keepdims=True)
                dot = np.einsum("ij,ij->i", x, y)
                good[at] = dot >= cosine * np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good)) for c in batch.columns[:2]], names=["a", "b"])

    side = lambda n: classes.select(F.col("key").alias(n), F.col("embedding").alias(f"e{n}"), F.col("label").alias(f"l{n}"))
    compared = pairs.join(side("a"), "a").join(side("b"), "b").where("la = lb").select("a", "b", "ea", "eb")
    links = stored(compared.mapInArrow(verify, "a string, b string"), "links")

    both = links.union(links.select("b", "a"))
    facts = classes.select("key", "first", "copies")
    counted = both.join(facts.select(F.col("key").alias("b"), F.col("copies").alias("n"), F.col("first").alias("dst")), "b")
    counted = counted.join(facts.select(F.col("key").alias("a"), F.col("first").alias("src")), "a")
    degree = counted.groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "key")
    repeated = rows.where("key is not null").join(facts, "key").where("vec_id <> first").select(F.col("vec_id").alias("src"), F.col("first").alias("dst"))
    groups = connected_components(counted.select("src", "dst").union(repeated)).withColumnRenamed("node", "vec_id")

    out = rows.select("vec_id", "key").join(facts.select("key", "copies"), "key", "left").join(degree, "key", "left").join(groups, "vec_id", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.coalesce("component", "vec_id"))
    return out.select(
        "vec_id", (F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("n", F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
