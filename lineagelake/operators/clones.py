"""Clone assignment by the barcodes of a cell."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def mapping_table(spark: SparkSession, mapping: Mapping[str, str | list[str]]) -> DataFrame:
    """``(clone, barcodes, ord)`` of a mapping of clone to barcode or barcodes."""
    rows = []
    for i, (clone, own) in enumerate(mapping.items()):
        if not isinstance(own, str | list | tuple | set):
            raise TypeError("a clone maps to a barcode or to a list of barcodes")
        rows.append((clone, sorted({own} if isinstance(own, str) else set(own)), i))
    return spark.createDataFrame(rows, "clone string, barcodes array<string>, ord int")


def assign_clones(counts: DataFrame, mapping: DataFrame, threshold: float = 0.5, key: str = "cell", added: str = "clone") -> DataFrame:
    """``(key, clone)`` of every cell.

    Of a cell's barcodes those that any clone has count.  A clone is a candidate if it has at
    least as many barcodes as the cell; its score is the share of its barcodes that the cell
    has.  The best score wins, the first clone of equals, if it is ``threshold`` or more and
    not 0; else the cell is "Unassigned".
    """
    parts = mapping.select("clone", "ord", F.size(F.array_distinct("barcodes")).alias("size"), F.explode(F.array_distinct("barcodes")).alias("barcode"))
    held = counts.where("counts > 0").select(key, "barcode").distinct()
    known = held.join(parts.select("barcode").distinct(), "barcode", "left_semi")
    sizes = known.groupBy(key).agg(F.count("*").alias("n"))
    shared = held.join(parts, "barcode").groupBy(key, "clone", "ord", "size").agg(F.count("*").alias("k"))
    best = (
        shared.join(sizes, key).where("n <= size").withColumn("score", F.col("k") / F.col("size")).where(F.col("score") >= threshold)
        .groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("s"), "ord", "clone")).alias("b")).select(key, F.col("b.clone").alias(added))
    )
    return counts.select(key).distinct().join(best, key, "left").na.fill("Unassigned", [added])
