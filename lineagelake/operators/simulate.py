"""Synthetic barcode populations, PCR errors and reads.  All chance comes from hashes of a
seed and of what the row stands for, so a task that runs again gives the same rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineagelake.functions.storage import numbered
from lineagelake.operators.abundance import with_sum
from lineagelake.operators.collapse import first_independent_set, near_pairs


def uniform(seed: int, *of: Column | str) -> Column:
    """A number in [0, 1) fixed by the seed and the columns."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *of), 11).cast("double") / float(1 << 53)


def gaussian(seed: int, *of: Column | str) -> Column:
    """A standard normal number (Box and Muller)."""
    return F.sqrt(-2 * F.log(1 - uniform(seed, *of))) * F.cos(6.283185307179586 * uniform(seed + 1, *of))


def _letters(length: Column | int, letter) -> Column:
    n = F.lit(length) if isinstance(length, int) else length
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), letter), "")).otherwise("")


def random_dna(length: Column | int, seed: int, *of: Column | str) -> Column:
    return _letters(length, lambda i: F.substring(F.lit("ACGT"), (F.pmod(F.xxhash64(F.lit(seed), *of, i), F.lit(4)) + 1).cast("int"), F.lit(1)))


def random_quality(length: Column | int, seed: int, *of: Column | str) -> Column:
    """Phred 0 to 41, uniformly, as characters from ! to J."""
    return _letters(length, lambda i: F.char(F.pmod(F.xxhash64(F.lit(seed), *of, i), F.lit(42)) + 33))


def unique_sequences(spark: SparkSession, total: int, length: int, seed: int, least_distance: int = 0) -> DataFrame:
    """``(i, seq)``: ``total`` different sequences, numbered from 0, any two of them at least
    ``least_distance`` substitutions apart.  Draws twice as many until enough are left over."""
    if total > 4**length:
        raise ValueError(f"there are fewer than {total} sequences of {length} bases")
    draw = max(16, 2 * total)
    while draw <= 4096 * max(16, total):
        drawn = spark.range(draw).select(F.col("id").alias("ord"), random_dna(length, seed, "id").alias("barcode"))
        drawn = drawn.groupBy("barcode").agg(F.min("ord").alias("prio"))
        if least_distance > 1:
            near = near_pairs(drawn.withColumn("block", F.lit("")), least_distance - 1, True)
            kept = first_independent_set(near.select("src", "dst"), drawn.select(F.col("barcode").alias("node"), "prio"))
            drawn = drawn.join(kept.withColumnRenamed("node", "barcode"), "barcode", "left_semi")
        top = drawn.orderBy("prio").limit(total)
        if top.count() == total:
            return numbered(top, ["prio"], "i").select("i", F.col("barcode").alias("seq"))
        draw *= 4
    raise ValueError("no such set of sequences was found; shorten the distance or lengthen the sequences")


@dataclass(frozen=True)
class Counts:
    """How counts are drawn: uniform (all ``count``), random (1 to ``high``), normal (``mean``,
    ``sd``) or powerlaw (Zipf's law, k with a chance in proportion to k to the power -``a``); none under ``least``, nor, if they differ,
    under ``least_percent`` of the sum."""

    kind: str = "uniform"
    count: int = 100
    high: int = 1000
    mean: float = 100.0
    sd: float = 20.0
    a: float = 2.0
    least: int = 1
    least_percent: float = 0.0

    def _zipf(self, seed: int, *of: Column | str) -> Column:
        """Rejection from a Pareto law (Devroye, 1986).  More than half of the draws are taken,
        so 64 of them leave a chance of under 2**-64 that none is."""
        b = 2.0 ** (self.a - 1)

        def draw(j: Column) -> Column:
            x = F.floor(F.pow(1 - uniform(seed, *of, j), F.lit(-1 / (self.a - 1)))).cast("double")
            t = F.pow(1 + 1 / x, F.lit(self.a - 1))
            return F.struct(x.alias("x"), (uniform(seed + 1, *of, j) * x * (t - 1) / (b - 1) <= t / b).alias("taken"))

        draws = F.transform(F.sequence(F.lit(1), F.lit(64)), draw)
        return F.coalesce(F.get(F.filter(draws, lambda d: d["taken"]), F.lit(0))["x"], F.lit(1.0))

    def column(self, seed: int, *of: Column | str) -> Column:
        if self.kind == "uniform":
            c = F.lit(self.count)
        elif self.kind == "random":
            c = F.floor(uniform(seed, *of) * self.high) + 1
        elif self.kind == "normal":
            c = F.floor(gaussian(seed, *of) * self.sd + self.mean)
        elif self.kind == "powerlaw":
            c = self._zipf(seed, *of)
        else:
            raise ValueError(f"unknown distribution {self.kind!r}: uniform, random, normal or powerlaw")
        return F.greatest(c.cast("long"), F.lit(max(1, self.least)).cast("long"))


def with_frequency(df: DataFrame, keys: Sequence[str], count: str = "count") -> DataFrame:
    """``df`` with ``frequency``, percent of the key's sum."""
    return with_sum(df, list(keys), "__sum", count).withColumn("frequency", 100 * F.col(count) / F.col("__sum")).drop("__sum")


def with_totals(df: DataFrame, keys: Sequence[str], count: str = "count") -> DataFrame:
    """``df`` with ``total_count``, the key's sum."""
    return with_sum(df, list(keys), "total_count", count)


def mutated(seq: Column, substitutions: int, seed: int, *of: Column | str) -> Column:
    """``seq`` with exactly ``substitutions`` bases, at different places, replaced by others."""
    places = F.sequence(F.lit(1), F.length(seq))
    order = F.array_sort(F.transform(places, lambda i: F.struct(F.xxhash64(F.lit(seed), *of, i).alias("h"), i.alias("i"))))
    chosen = F.transform(F.slice(order, 1, substitutions), lambda x: x["i"])
    turn = lambda i: F.pmod(F.xxhash64(F.lit(seed + 1), *of, i), F.lit(3)) + 1
    base = lambda i: F.substring(seq, i, F.lit(1))
    other = lambda i: F.substring(F.lit("ACGTACGT"), (F.instr(F.lit("ACGT"), base(i)) + turn(i)).cast("int"), F.lit(1))
    return F.array_join(F.transform(places, lambda i: F.when(F.array_contains(chosen, i), other(i)).otherwise(base(i))), "")


def with_pcr_errors(barcodes: DataFrame, chimeras: int, fraction: float, substitutions: int = 2, seed: int = 0, key: str = "sample") -> DataFrame:
    """``(key, barcode, cluster, count, total_count)``: each barcode, and ``chimeras`` mutants
    of it that share ``fraction`` of its count; mutants without a count go.  Without a
    fraction the barcodes come back as they are."""
    if not fraction or not chimeras:
        return barcodes
    own = barcodes.withColumn("cluster", F.concat(F.lit("cluster_"), (F.col("i") + 1).cast("string")))
    part = F.floor(F.greatest(F.lit(1), F.floor(F.col("count") * fraction)) / chimeras).cast("long")
    extra = own.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(chimeras)))).where(part > 0)
    extra = extra.select(key, mutated(F.col("barcode"), substitutions, seed + 11, "barcode", "k").alias("barcode"), "cluster", part.alias("count"))
    return with_totals(own.select(key, "barcode", "cluster", "count").unionByName(extra), [key, "cluster"])


def extended(seq: Column, length: int, left: str, right: str, seed: int, *of: Column | str) -> Column:
    """A barcode between its flanks, padded with random bases to ``length``; longer ones stay."""
    flanked = F.concat(F.lit(left), seq, F.lit(right))
    return F.concat(flanked, random_dna(F.greatest(F.lit(length) - F.length(flanked), F.lit(0)), seed, *of))


def dna_ground_truth(
    spark: SparkSession, samples: Sequence[str], barcodes: int = 10, length: int = 16, counts: Counts | None = None, least_distance: int = 0,
    chimeras: int = 0, fraction: float = 0.0, substitutions: int = 2, seed: int = 0,
) -> DataFrame:
    """Bulk populations: barcodes of each sample with counts, and their PCR mutants."""
    counts = counts or Counts()
    frames = None
    for k, s in enumerate(samples):
        one = unique_sequences(spark, barcodes, length, seed + 1000 * k, least_distance).withColumnRenamed("seq", "barcode").withColumn("sample", F.lit(s))
        frames = one if frames is None else frames.unionByName(one)
    if frames is None:
        raise ValueError("no sample is named")
    pop = frames.withColumn("count", counts.column(seed + 5, "sample", "barcode"))
    if counts.kind != "uniform" and counts.least_percent:
        floor = F.floor(F.col("__sum") * counts.least_percent / 100).cast("long")
        pop = with_sum(pop, ["sample"], "__sum", "count").withColumn("count", F.greatest("count", floor)).drop("__sum")
    out = with_pcr_errors(pop, chimeras, fraction, substitutions, seed)
    return out if "cluster" in out.columns else with_frequency(out.drop("i"), ["sample"])


def dna_reads(truth: DataFrame, length: int = 100, left: str = "", right: str = "", seed: int = 0) -> DataFrame:
    """One row per read: ``sample, read``; the reads of a barcode share their padding."""
    read = extended(F.col("barcode"), length, left, right, seed + 21, "sample", "barcode")
    return truth.select("sample", read.alias("read"), "count").select("sample", "read", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count")))).drop("col")


def clone_sizes(cells: int, clones: int, counts: Counts, seed: int = 0) -> list[int]:
    """Cells of each clone, in proportion to draws of ``counts``, rounded down."""
    spark = SparkSession.active()
    drawn = [r[0] for r in spark.range(clones).select(counts.column(seed, "id")).collect()]  # as many as clones
    return [c * cells // sum(drawn) for c in drawn]


def sc_molecules(
    spark: SparkSession, samples: Sequence[str], cells: int = 10, clones: int = 2, length: int = 16, cell_length: int = 16, umi_length: int = 10,
    umis_per_cell: int = 5, counts: Counts | None = None, chimeras: int = 0, fraction: float = 0.0, substitutions: int = 2, least_distance: int = 3, seed: int = 0,
) -> DataFrame:
    """``(sample, cell_bc, umi, barcode, clone)`` of single cells: a clone has a barcode, its
    cells are drawn without replacement, each has ``umis_per_cell`` molecules.  ``fraction``
    of a cell's molecules carry one of the clone barcode's ``chimeras`` mutants instead."""
    out = None
    for k, s in enumerate(samples):
        own = seed + 1000 * k
        sizes = clone_sizes(cells, clones, counts or Counts(), own)
        if sum(sizes) > cells:
            raise ValueError("the clones need more cells than there are")
        ends = [sum(sizes[: i + 1]) for i in range(clones)]
        bar = unique_sequences(spark, clones, length, own + 1, least_distance).select(F.col("i").alias("c"), F.col("seq").alias("barcode"))
        cell = unique_sequences(spark, cells, cell_length, own + 2).withColumnRenamed("seq", "cell_bc").where(F.col("i") < sum(sizes))
        cell = cell.withColumn("c", F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= F.col("i"))).cast("long"))
        rows = cell.join(bar, "c").withColumn("m", F.explode(F.sequence(F.lit(1), F.lit(umis_per_cell))))
        rows = rows.withColumn("umi", random_dna(umi_length, own + 3, "cell_bc", "m"))
        if chimeras and fraction:
            rank = F.row_number().over(Window.partitionBy("cell_bc").orderBy(uniform(own + 4, "cell_bc", "m")))
            kind = F.floor(uniform(own + 5, "cell_bc", "m") * chimeras)
            rows = rows.withColumns({"__r": rank, "__k": kind})
            rows = rows.withColumn("barcode", F.when(F.col("__r") <= int(umis_per_cell * fraction), mutated(F.col("barcode"), substitutions, own + 6, "barcode", "__k")).otherwise(F.col("barcode")))
        rows = rows.select(F.lit(s).alias("sample"), "cell_bc", "umi", "barcode", F.concat(F.lit("clone_"), (F.col("c") + 1).cast("string")).alias("clone"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no sample is named")
    return out


def sc_reads(molecules: DataFrame, length: int = 100, left: str = "", right: str = "", padding: int = 74, seed: int = 0) -> DataFrame:
    """Read pairs: cell, UMI and random bases; and the barcode between its flanks, padded."""
    one = F.concat("cell_bc", "umi", random_dna(padding, seed + 31, "cell_bc", "umi"))
    return molecules.select("sample", one.alias("read_1"), extended(F.col("barcode"), length, left, right, seed + 32, "cell_bc", "umi").alias("read_2"))
