"""From reads to barcode counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineagelake.functions.expressions import made_once


def paired(r1: DataFrame, r2: DataFrame, keys: Sequence[str] = ("sample", "ord")) -> DataFrame:
    """Read pairs by ordinal, with ``r1`` and ``r2`` as structs; reads without a mate go."""
    rest = lambda d: [c for c in d.columns if c not in keys]
    a = r1.select(*keys, F.struct(*rest(r1)).alias("r1"))
    return a.join(r2.select(*keys, F.struct(*rest(r2)).alias("r2")), list(keys))


def whitelisted(reads: DataFrame, whitelist: DataFrame, column: str = "cell") -> DataFrame:
    """Reads whose cell is on the list.  Spark broadcasts the list if its size allows."""
    return reads.join(whitelist.select(column), column, "left_semi")


def with_barcode(reads: DataFrame, barcode: Column, keep: Column | None = None) -> DataFrame:
    """``reads`` with a ``barcode``; reads without one go."""
    out = reads.withColumn("barcode", barcode if reads.isStreaming else made_once(barcode)).where(F.length("barcode") > 0)
    return out if keep is None else out.where(keep)


def named(reads: DataFrame, names: DataFrame) -> DataFrame:
    """``reads`` whose ``barcode`` is a sequence of ``names(sequence, name)``, by its name."""
    return reads.join(names.select(F.col("sequence").alias("barcode"), "name"), "barcode").drop("barcode").withColumnRenamed("name", "barcode")


def names_table(spark: SparkSession, names: Mapping[str, str]) -> DataFrame:
    """``(sequence, name)`` of a mapping of sequence to name."""
    return spark.createDataFrame(list(names.items()), "sequence string, name string")


def count_reads(reads: DataFrame, keys: Sequence[str] = ("sample",)) -> DataFrame:
    """Reads by key and barcode."""
    return reads.groupBy(*keys, "barcode").agg(F.count("*").alias("counts"))


def count_umis(reads: DataFrame, keys: Sequence[str] = ("sample", "cell")) -> DataFrame:
    """Distinct UMIs by key and barcode."""
    return reads.dropna(subset=["umi"]).groupBy(*keys, "barcode").agg(F.countDistinct("umi").alias("counts"))


def exploded(counts: DataFrame) -> DataFrame:
    """Parallel lists ``barcode`` and ``counts`` as one row each."""
    rest = [c for c in counts.columns if c not in ("barcode", "counts")]
    return counts.select(*rest, F.inline(F.arrays_zip("barcode", "counts")))


def with_metadata(counts: DataFrame, sheet: DataFrame) -> DataFrame:
    """Counts with ``replicate`` and ``condition`` of the sample sheet; blanks are null."""
    blank = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    meta = [c for c in ("replicate", "condition") if c in sheet.columns]
    return counts.join(sheet.select("sample", *[blank(c).alias(c) for c in meta]), "sample", "left")


def without_empty_columns(df: DataFrame) -> DataFrame:
    """``df`` without the columns that are null in every row; one pass over the data."""
    held = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if held[c]])
