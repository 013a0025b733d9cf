"""Filters of low-abundance barcodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_sum(df: DataFrame, keys: list[str], name: str, of: str = "counts") -> DataFrame:
    """``df`` with the sum of ``of`` by ``keys``: partial sums and a join, so that a key with
    many rows is no single task.  Null keys have their own sum."""
    own = [F.col(k).alias(f"__{k}") for k in keys]
    sums = df.groupBy(*own).agg(F.sum(of).alias(name))
    if not keys:
        return df.crossJoin(sums)  # one row
    same = [df[k].eqNullSafe(sums[f"__{k}"]) for k in keys]
    return df.join(sums, same).select(*[df[c] for c in df.columns], name)


def with_share(counts: DataFrame, within: str = "sample") -> DataFrame:
    """``counts`` with ``relative_abundance``, in percent: of the sample's reads, or, within
    ``replicate``, of the barcode's reads in the whole replicate."""
    out = with_sum(counts, [within], "__all")
    part = F.col("counts")
    if within == "replicate":
        out, part = with_sum(out, ["replicate", "barcode"], "__part"), F.col("__part")
    return out.select(*counts.columns, (part / F.col("__all") * 100).alias("relative_abundance"))


def filter_abundance(counts: DataFrame, raw: int | None = None, relative: float | None = None, within: str = "sample") -> DataFrame:
    """Barcodes with ``raw`` counts or more; without that limit, those with ``relative`` percent
    or more.  A limit of 0 or None is none."""
    if raw:
        return counts.where(F.col("counts") >= raw)
    if relative:
        return with_share(counts, within).where(F.col("relative_abundance") >= relative).drop("relative_abundance")
    return counts
