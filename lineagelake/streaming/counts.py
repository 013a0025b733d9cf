"""Barcode counts over files that keep arriving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineagelake.operators import counting


def streaming_counts(reads: DataFrame, barcode: Column, umi: bool = False, event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Running counts per sample (and cell) and barcode of a streaming frame of reads; with
    ``umi``, each (cell, barcode, UMI) counts once, however often and late it arrives.  With a
    column ``event_time``, repeats are known for ``delay`` only, and no longer kept after it."""
    found = counting.with_barcode(reads, barcode)
    if not umi:
        return counting.count_reads(found)
    keys = ["sample", "cell", "barcode", "umi"]
    once = found.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys) if event_time else found.dropDuplicates(keys)
    return once.groupBy("sample", "cell", "barcode").agg(F.count("*").alias("counts"))
