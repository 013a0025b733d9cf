"""Wide matrices as CSV text, written and read without a column for each barcode."""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineagelake.functions.storage import ship, stored
from lineagelake.operators import matrix

from . import bgzf

#: Cells that a task passes on at once.
_CELLS = 50_000


def write_wide(counts: DataFrame, path: str, block: int = matrix.BLOCK, part: int = matrix.PART) -> None:
    """The wide matrix as gzip CSV files below ``path``, each with the header and some of the
    lines, for libraries of any size: a task writes one block of columns after the other, and
    neither a line nor the header is ever held whole."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = None
        for b in batches:
            for own, line, value in zip(*(c.to_pylist() for c in b.columns), strict=True):
                first = own if first is None else first
                if line >= 0 or own == first:  # one header, if several parts came to one file
                    yield pa.RecordBatch.from_arrays([pa.array([bgzf.blocks_of(value.encode())], pa.binary())], names=["value"])

    spark = counts.sparkSession
    ship(spark)
    rows = matrix.segments(counts, block, part).repartition("part").sortWithinPartitions("part", "line", "block")
    out = rows.select("part", "line", "value").mapInArrow(packed, "value binary").select(F.col("value").cast("string").alias("value"))
    out.write.mode("overwrite").option("encoding", "ISO-8859-1").option("lineSep", bgzf.END.decode("latin-1")).text(path)
    # Spark names text files .txt; their names tell readers that they are gzip.
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in fs.globStatus(place(f"{path}/part-*.txt")) or ():
        old = found.getPath()
        if found.getLen():
            fs.rename(old, place(old.getParent(), old.getName().removesuffix(".txt") + ".csv.gz"))
        else:
            fs.delete(old, False)


def read_wide(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A wide CSV, one file or several with a header each, as ``lines(line, keys...)`` and
    ``cells(line, barcode, counts)``, zeros included.  The keys are the first columns, as far as
    they are named like keys (``sample``, ``cell``, ``replicate``, ``condition``).

    Lines are split in one scan into cells by position, and headers into names by position; the
    two meet in a join.  Only the beginning of a header reaches the driver.
    """
    ship(spark)
    text = spark.read.text(path)
    start = text.select(F.substring("value", 1, 1000).alias("v")).limit(1).collect()
    if not start:
        raise ValueError(f"{path} has no header")
    head = next(csv.reader([start[0].v]))
    keys = [c for k, c in enumerate(head) if c in matrix.META and all(x in matrix.META for x in head[:k])]
    k = len(keys)
    if not k:
        raise ValueError(f"{path} has none of the columns {', '.join(matrix.META)} first")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, file = TaskContext.get().partitionId() << 33, None
        for b in batches:
            for line, name, begin in zip(*(c.to_pylist() for c in b.columns), strict=True):
                header, file, n = name != file and not begin, name, n + 1
                row = next(csv.reader([line]), [])
                if not row:
                    continue
                if not header:
                    yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([-1], pa.int32()), pa.array([None], pa.string()), pa.array([row[:k]], pa.list_(pa.string()))], names=["line", "at", "value", "keys"])
                for i in range(k, len(row), _CELLS):
                    some = row[i : i + _CELLS]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([-1 if header else n] * len(some)), pa.array(range(i, i + len(some)), pa.int32()), pa.array(some), pa.nulls(len(some), pa.list_(pa.string()))],
                        names=["line", "at", "value", "keys"],
                    )

    rows = text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"))
    cells = stored(rows.mapInArrow(split, "line long, at int, value string, keys array<string>"), "cells")
    names = cells.where("line = -1").select("at", F.col("value").alias("barcode")).distinct()
    lines = cells.where("at = -1").select("line", *[F.col("keys")[i].alias(c) for i, c in enumerate(keys)])
    found = cells.where("line >= 0 and at >= 0").join(names, "at")
    return lines, found.select("line", "barcode", F.col("value").cast("double").cast("long").alias("counts"))
