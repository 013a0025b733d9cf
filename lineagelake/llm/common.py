"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineagelake.functions.storage import free, shared_dir, stored

__all__ = ["batches_of", "connected_components", "free", "mixed", "scratch", "shared_dir", "shingle_set", "stored", "texts_of"]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; Spark removes it when the application ends."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    return path


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of the graph ``edges(src long, dst long)`` as ``(node, component)``,
    ``component`` being the smallest node of it; nodes without an edge are not returned.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): each round is a
    grouped minimum and an equi-join.  A hub's neighbours are rows of one key of that join,
    which Spark splits where the key is large; a distinct pass stands on it.  Every round is
    written to the shared folder.  Only two numbers a round reach the driver.  More than
    ``max_rounds`` rounds are an error; nothing is left out.
    """
    now = stored(
        edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(),
        "edges",
    )
    before = None
    for _ in range(max_rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            .union(least.select("u", F.col("m").alias("v"))).distinct()
        )
        last, now = now, stored(small, "edges")
        free(last)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError("connected components did not settle")
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    found = stored(found.union(found.select(F.col("component").alias("node"), "component").distinct()), "components")
    free(now)
    return found


_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text.

    Words are runs of bytes other than space and tab..carriage return after lower-casing
    A-Z only.  Fewer words than ``words`` make one shingle of them all; no word, none.
    """
    if not text:
        return np.empty(0, np.uint64)
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(parts)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, n)
    width = min(words, n)
    out = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n - width + 1])
    return np.unique(out)


#: Rows of a batch of texts on its way to Python.
ROWS = 500
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def texts_of(df: DataFrame) -> DataFrame:
    """``df``, whose texts go to Python: batches of Spark's default size would hold some tens of
    megabytes several times over, on both sides.  A session that sets a size keeps it."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH) == "10000":
        conf.set(_BATCH, ROWS)
    return df


def batches_of(rows: Iterator, size: int):
    """Arrow batches cut to at most ``size`` rows, so that a batch of long texts stays small.
    At their end, what the task has freed goes back to the system: Spark's Python workers live
    on, and tasks of other stages follow in them."""
    for batch in rows:
        for i in range(0, batch.num_rows, size):
            yield batch.slice(i, size)
    del rows
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
